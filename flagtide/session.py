"""Session construction and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE re-plans joins and splits skewed
# partitions at run time; the UI server stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "flagtide",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def _forget(path: str) -> None:
    with contextlib.suppress(OSError):
        os.remove(path)


# Spark's defaults for what goes to a Python worker at once (10,000 rows, 64 MB)
# are too much for rows that hold whole texts or files.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
                 "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_arrow_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has sizes of its own."""
    for name, (default, small) in ARROW_BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, small)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per context)."""
    small_arrow_batches(spark)
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    fd, archive = tempfile.mkstemp(prefix="flagtide-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    atexit.register(_forget, archive)  # executors that start later still fetch it while the application lives
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only on a local master that names none (tests) is a scratch folder set:
    elsewhere a folder of one machine would be seen by that machine alone.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="flagtide-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


class Scratch:
    """Folders written below the shared checkpoint folder while it is open."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, path: str) -> None:
        """``path`` outlives the block."""
        self.paths.remove(path)


_OPEN: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what is written by ``store``, ``materialize`` and ``shared_path`` in the
    block when it ends well, but for what is kept. After an error all stays."""
    made = Scratch()
    _OPEN.append(made)
    try:
        yield made
        done = True
    except BaseException:
        done = False
        raise
    finally:
        _OPEN.remove(made)
        if done:
            for path in made.paths:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of this library from the shared store, whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].paths.append(path)
    return path


def store(df: DataFrame) -> str:
    """Writes the rows once as a table in the shared checkpoint folder; its path."""
    path = shared_path(df.sparkSession, "tables")
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows once as a table in the shared
    checkpoint folder and reading them back.

    The expensive upstream (Python parsing) then runs exactly once (an RDD
    checkpoint of an unpersisted plan would compute it twice: once for the
    action, once for the checkpoint file), and the result survives the loss
    of any executor.
    """
    return df.sparkSession.read.parquet(store(df))
