"""Repository folders on a file system that all machines mount.

``spark.read.format("repository_tree").load(root)`` (after ``register``) and
``read_tree`` give ``source_files(repo_id, path, size, content, read_error)`` for
every child folder of ``root`` (one repository each).

Work is dealt in units: a folder with all below it, or one slice of the
entries of a folder too large for one task, whose names are dealt by their hash.
Nobody lists everything at once. The data source plans with a bounded walk: the
files it comes across are packed into partitions by their bytes, folders it does
not get to are dealt to a bounded number of further partitions. ``list_tree`` lists in rounds of Spark
jobs instead; a walk that exceeds its share hands the rest to the next round.

A file above the size limit is not read (its content is null, its size tells
why), nor does a file that cannot be read end the job (``read_error`` tells why).

Pruning follows the scanner rules (see ``operators.guards``): folders whose
exact name is ignored or starts with ``.`` are not entered (the repository
root itself is never tested); files must end in ``.py`` (case-sensitive);
hidden files are kept. Symlinked folders are not followed.
"""

from __future__ import annotations

import os
import shutil
import threading
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith)

from flagtide.operators.guards import IGNORED_DIRS, MAX_FILE_BYTES
from flagtide.session import delete, folder_there, materialize, shared_path, store

READ_TASK_BYTES = 64 << 20
#: Entries of a folder that one task goes through; a larger one is cut into slices.
FOLDER_ENTRIES, SLICES = 100_000, 64
#: Entries that the planning of the data source, and a walk of a listing round, look at.
PLANNED_ENTRIES, FIRST_WALK, WALK = 200_000, 2_000, 50_000
#: Partitions of the data source for all folders that its planning does not get to.
LEFT_PARTS = 256
#: Files of one tree of ``through_trees``, and trees it has at work at a time.
TREE_FILES, LANES = 100_000, 2
FORMAT = "repository_tree"
FILE = "repo_id string, path string, size bigint, content binary, read_error string"
_FILE_TYPES = [("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()),
               ("read_error", pa.string())]


def mounted_path(uri: str) -> str:
    """The path of a plain or ``file:`` location; other stores have no folders
    that ``os`` can list, and raise."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri} is not on a mounted file system")
    return parts.path


@dataclass(frozen=True)
class Unit:
    """A folder with all below it (``of`` = 1), or of its entries those whose hashed
    name falls into ``slice``. ``folder`` is relative to the root ("" is the root)."""
    folder: str
    slice: int = 0
    of: int = 1


@dataclass(frozen=True)
class Found:
    """A file the scanner keeps (``error`` null), or a folder that cannot be listed."""
    repo_id: str
    path: str
    size: int | None
    error: str | None = None


def walk(root: str, units: list[Unit], ignore: frozenset, most: float = float("inf")) -> Iterator[Found | Unit]:
    """The files below ``units`` breadth first. After ``most`` entries the folders not
    entered come as units; a folder too large for one task comes as its slices."""
    queue, seen = deque(units), 0
    while queue:
        unit = queue.popleft()
        if seen >= most:
            yield unit
            continue
        repo, _, inner = unit.folder.partition("/")
        mine = 0
        folders: list[Unit] = []
        files: list[Found] = []
        try:
            with os.scandir(os.path.join(root, unit.folder)) as entries:
                for e in entries:
                    mine += 1
                    if unit.of == 1 and mine > FOLDER_ENTRIES:
                        break
                    if unit.of > 1 and crc32(os.fsencode(e.name)) % unit.of != unit.slice:
                        continue
                    at = f"{unit.folder}/{e.name}" if unit.folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if not unit.folder or e.name not in ignore and not e.name.startswith("."):
                            folders.append(Unit(at))
                    elif unit.folder and e.name.endswith(".py") and e.is_file():
                        files.append(Found(repo, f"{inner}/{e.name}" if inner else e.name, e.stat().st_size))
        except OSError as error:
            if not unit.folder:
                raise
            yield Found(repo, inner, None, f"{type(error).__name__}: {error.strerror}")
        seen += mine
        if unit.of == 1 and mine > FOLDER_ENTRIES:
            for i in range(SLICES):
                yield Unit(unit.folder, i, SLICES)
            continue
        yield from files
        queue.extend(folders)


def _table(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])


def _read(root: str, found: Iterator[Found], max_file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Files with their bytes, some megabytes at a time."""
    rows, held = [], 0
    for f in found:
        data, size, error = None, f.size, f.error
        if error is None and size <= max_file_bytes:
            try:
                with open(os.path.join(root, f.repo_id, f.path), "rb") as opened:
                    data = opened.read()
                size = len(data)
            except OSError as problem:
                error = f"{type(problem).__name__}: {problem.strerror}"
        rows.append((f.repo_id, f.path, size, data, error))
        held += len(data or b"")
        if held > 8 << 20 or len(rows) >= 10_000:
            yield _table(rows, _FILE_TYPES)
            rows, held = [], 0
    if rows:
        yield _table(rows, _FILE_TYPES)


# ------------------------------------------------------------------ data source

@dataclass
class Part(InputPartition):
    """Files found by the planning, or units that the task walks itself."""
    files: tuple[Found, ...] = ()
    units: tuple[Unit, ...] = ()

    @property
    def unit(self) -> Unit | None:
        return self.units[0] if self.units else None


def plan(root: str, ignore: frozenset, wanted, most: int, part_bytes: int, max_file_bytes: int) -> list[Part]:
    """Partitions after a walk of ``most`` entries: files packed by bytes (and by a
    fixed cost each), and the units that are left, which may be as many as the entries
    looked at, dealt to ``LEFT_PARTS`` partitions at most."""
    parts, held, size, left = [], [], 0, []
    for x in walk(root, [Unit("")], ignore, most):
        if isinstance(x, Unit):
            left.append(x)
        elif wanted(x):
            cost = 4096 + (x.size if x.size is not None and x.size <= max_file_bytes else 0)
            if held and size + cost > part_bytes:
                parts.append(Part(files=tuple(held)))
                held, size = [], 0
            held.append(x)
            size += cost
    if held:
        parts.append(Part(files=tuple(held)))
    parts += [Part(units=tuple(left[i::LEFT_PARTS])) for i in range(min(len(left), LEFT_PARTS))]
    return parts or [Part()]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = mounted_path(options["path"])
        self.ignore = frozenset(n for n in options.get("ignore", "").split(",") if n) or frozenset(IGNORED_DIRS)
        self.max_file_bytes = int(options.get("maxFileBytes", MAX_FILE_BYTES))
        self.part_bytes = int(options.get("partBytes", READ_TASK_BYTES))
        self.most = int(options.get("plannedEntries", PLANNED_ENTRIES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        """Repository, path ends and size decide before a file is opened; Spark tests
        them again, as a size may change until the file is read."""
        kept = {EqualTo: ("repo_id", "path"), In: ("repo_id", "path"), StringEndsWith: ("path",),
                StringStartsWith: ("repo_id", "path"), LessThan: ("size",), LessThanOrEqual: ("size",)}
        self.filters = [f for f in filters if len(f.attribute if hasattr(f, "attribute") else ()) == 1
                        and f.attribute[0] in kept.get(type(f), ())]
        return filters

    def wanted(self, x: Found) -> bool:
        """Whether the pushed filters let a file through (folders that cannot be
        listed have no size: they always pass)."""
        if x.error is not None:
            return True
        tests = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, StringEndsWith: str.endswith,
                 StringStartsWith: str.startswith, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}
        return all(tests[type(f)](getattr(x, f.attribute[0]), f.value) for f in self.filters)

    def partitions(self):
        return plan(self.root, self.ignore, self.wanted, self.most, self.part_bytes, self.max_file_bytes)

    def read(self, partition):
        files: Iterator[Found] = iter(partition.files)
        if partition.units:
            files = self._below(list(partition.units))
        yield from _read(self.root, files, self.max_file_bytes)

    def _below(self, units: list[Unit]) -> Iterator[Found]:
        """Units to their end: slices of large folders further down are walked here too."""
        while units:
            later = []
            for x in walk(self.root, units, self.ignore):
                if isinstance(x, Unit):
                    later.append(x)
                elif self.wanted(x):
                    yield x
            units = later


class TreeSource(DataSource):
    """Options: ``ignore`` (folder names, comma separated), ``maxFileBytes``, ``partBytes``,
    ``plannedEntries``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return FILE

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


# ------------------------------------------------------------- listing as jobs

def list_tree(spark: SparkSession, root: str, ignore=IGNORED_DIRS) -> DataFrame:
    """``(repo_id, path, size, list_error)`` of every file the scanner keeps, and
    of folders that cannot be listed. An empty ``ignore`` means the default.

    The first round walks from the root a little way; every round deals the units
    that are left over all tasks, until none is left."""
    base, skip = mounted_path(root), frozenset(ignore or IGNORED_DIRS)
    types = [("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("list_error", pa.string()),
             ("folder", pa.string()), ("slice", pa.int32()), ("of", pa.int32())]

    def listed(most):
        def run(batches):
            units = [Unit(*u) for b in batches for u in zip(*(b.column(i).to_pylist() for i in range(3)))]
            rows = []
            for unit in units:
                for x in walk(base, [unit], skip, most):
                    rows.append((None, None, None, None, x.folder, x.slice, x.of) if isinstance(x, Unit)
                                else (x.repo_id, x.path, x.size, x.error, None, None, None))
                    if len(rows) >= 50_000:
                        yield _table(rows, types)
                        rows = []
            yield _table(rows, types)
        return run

    units = spark.createDataFrame([("", 0, 1)], "folder string, slice int, of int")
    found, most = None, FIRST_WALK
    while True:
        entries = materialize(units.mapInArrow(listed(most), "repo_id string, path string, size bigint, list_error string, "
                                               "folder string, slice int, of int"))
        files = entries.where("folder is null").select("repo_id", "path", "size", "list_error")
        found = files if found is None else found.unionByName(files)
        left = entries.where("folder is not null")
        if left.isEmpty():
            return found
        most = WALK
        units = left.select("folder", "slice", "of").repartition(
            max(1, spark.sparkContext.defaultParallelism), "folder", "slice")


def read_tree(spark: SparkSession, root: str, ignore=IGNORED_DIRS, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The files of a tree of any size: listed by jobs, then read by as many tasks
    as their bytes need."""
    files = list_tree(spark, root, ignore)  # stored tables
    base = mounted_path(root)
    size = F.when(F.col("size") <= max_file_bytes, F.col("size")).otherwise(0)
    total = files.agg(F.sum(size)).first()[0] or 0
    # files are at most ``max_file_bytes``, so tasks of hashed keys weigh alike
    tasks = max(spark.sparkContext.defaultParallelism, total // READ_TASK_BYTES + 1)

    def run(batches):
        yield from _read(base, (Found(*f) for b in batches for f in zip(*(b.column(i).to_pylist() for i in range(4)))),
                         max_file_bytes)

    return files.repartition(int(tasks), "repo_id", "path").mapInArrow(run, FILE)


def _open_whole(path: str, flags: int) -> int:
    return os.open(path, flags & ~os.O_TRUNC)


class Spares:
    """Files and folders of trees that were read, which a task takes over for the next
    tree: on some file systems a new file or folder costs a search for a free place, and
    one that goes a request to the disk, which together take longer than the writing.

    Whole repositories are taken at a time, from ``start`` (0 to 1) of each root's list on:
    who moves one into ``held`` first has it, and no other attempt of the round looks there."""

    def __init__(self, roots: list[str], held: str, start: float):
        self._files, self._free = self._claim(roots, held, start), deque()

    def _claim(self, roots: list[str], held: str, start: float) -> Iterator[str]:
        for root in roots:
            names = os.listdir(root)
            first = int(start * len(names))
            for name in names[first:] + names[:first]:
                own = f"{held}/{uuid.uuid4().hex}"
                try:
                    os.rename(f"{root}/{name}", own)
                except FileNotFoundError:  # another task has it
                    continue
                for folder, _, files in os.walk(own, topdown=False):
                    yield from (f"{folder}/{f}" for f in files)
                    self._free.append(folder)  # its files are gone, and the folders in it come first

    def folder(self, path: str) -> None:
        """Makes a folder and those above it that are not there."""
        if os.path.isdir(path):
            return
        self.folder(os.path.dirname(path))
        if self._free:
            try:
                return os.rename(self._free.popleft(), path)
            except OSError:  # not empty, or another attempt has made ``path``
                pass
        os.makedirs(path, exist_ok=True)

    def write(self, path: str, content: bytes) -> bool:
        """Writes a file, in one that is taken over if there is any left (then true). It
        gets its name when its content is whole."""
        for spare in self._files:
            with open(spare, "wb", opener=_open_whole) as f:
                now = os.fstat(f.fileno())
                # two names, after an attempt that ended between link and unlink: not to be written by both
                if single := now.st_nlink == 1:
                    f.write(content)
                    if now.st_size > len(content):
                        f.truncate()
            if not single:
                os.unlink(spare)
                continue
            try:  # a rename would hold the whole file system's lock on renames between folders
                os.link(spare, path)
            except OSError:  # the path is there, or there are no links
                os.replace(spare, path)
            else:
                os.unlink(spare)
            return True
        with open(path, "wb") as f:
            f.write(content)
        return False


def write_tree(files: DataFrame, root: str, spares: tuple[str, ...] = ()) -> DataFrame:
    """Writes a ``source_files`` table as ``root/<repo_id>/<path>`` from the
    executors (one folder per repository); returns per-task file counts.

    Files and folders of the trees ``spares`` are taken over as far as they are needed
    (``taken`` counts the files); rows of a repository must be in one partition then.
    Of repositories that a task began, what is left is in ``root`` + ``.left``."""
    base, old = mounted_path(root), [mounted_path(s) for s in spares]
    held = f"{base}.left"
    if old:
        os.makedirs(held, exist_ok=True)

    def run(batches):
        n = taken = 0
        # steps of the golden ratio: tasks start far from each other, however many they are
        own = Spares(old, held, TaskContext.get().partitionId() * 0.6180339887 % 1)
        for batch in batches:
            for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                top = os.path.join(base, repo)
                target = os.path.join(top, *path.split("/"))
                if not os.path.isdir(folder := os.path.dirname(target)):
                    os.makedirs(os.path.dirname(top), exist_ok=True)
                    own.folder(folder)
                taken += own.write(target, content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([taken], pa.int64())], ["written", "taken"])

    return files.select("repo_id", "path", "content").mapInArrow(run, "written bigint, taken bigint")


def remove_tree(spark: SparkSession, root: str) -> None:
    """Deletes a tree, its folders dealt over the executors."""
    base = mounted_path(root)

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                shutil.rmtree(os.path.join(base, folder), ignore_errors=True)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["removed"])

    with os.scandir(base) as entries:
        folders = [(e.name,) for e in entries]
    if folders:
        spark.createDataFrame(folders, "folder string").repartition(spark.sparkContext.defaultParallelism).mapInArrow(
            run, "removed bigint").collect()
    shutil.rmtree(base, ignore_errors=True)


def _not_empty(folders: list[str]) -> list[str]:
    """The folders that hold something; empty ones go."""
    kept = []
    for folder in folders:
        try:
            os.rmdir(mounted_path(folder))
        except OSError:
            kept.append(folder)
    return kept


def through_trees(files: DataFrame, root: str, read, tree_files: int = TREE_FILES) -> DataFrame:
    """``read(path of a tree)`` over a ``source_files`` table written as trees of some
    ``tree_files`` files each: a small file takes a whole block of the file system, so one
    tree of all files would take many times the table's bytes.

    The table is cut by ranges of (repository, path), so that a repository is in few
    trees however large it is, and equal keys are in one. ``LANES`` trees are at work at a
    time, so that small stages of one fill the gaps of another; every lane writes one
    after another, each over the files of the one before. What is read of a tree is
    stored before that."""
    spark = files.sparkSession
    kept = files.select("repo_id", "path", "content")
    count = kept.count()
    pieces = -(-count // tree_files) or 1
    cut = shared_path(spark, "tables")
    kept.repartitionByRange(pieces, "repo_id", "path").withColumn("piece", F.spark_partition_id()).write.partitionBy(
        "piece").parquet(cut)
    # ranges are sampled: one may be empty
    numbers = iter([n for n in range(pieces) if folder_there(spark, f"{cut}/piece={n}")])
    taking = threading.Lock()
    lanes = min(LANES, pieces)
    # one lane's writing leaves cores to the others
    tasks = max(1, spark.sparkContext.defaultParallelism // min(lanes, 2))

    def lane() -> list[str]:
        out, spares, there = [], [], 0
        while True:
            with taking:
                piece = next(numbers, None)
            if piece is None:
                break
            at, tree = f"{cut}/piece={piece}", f"{root}/{piece}"
            part = spark.read.schema(kept.schema).parquet(at).repartition(tasks, "repo_id").sortWithinPartitions("repo_id", "path")
            written, taken = write_tree(part, tree, tuple(spares)).agg(F.sum("written"), F.sum("taken")).first()
            there += written - taken
            if spares:
                spares = _not_empty([*spares, f"{tree}.left"])
            if there - written > tree_files:  # few large repositories: most spares are in the hands of one task
                for spare in spares:
                    remove_tree(spark, spare)
                spares, there = [], written
            out.append(store(read(tree)))
            spares.append(tree)
            delete(spark, at)
        for spare in spares:
            remove_tree(spark, spare)
        return out

    def run(_: int) -> list[str]:
        try:
            return lane()
        except BaseException:
            with taking:  # the other lanes end after their tree
                deque(numbers, maxlen=0)
            raise

    with ThreadPoolExecutor(lanes) as pool:
        out = [path for paths in pool.map(inheritable_thread_target(spark)(run), range(lanes)) for path in paths]
    if not out:
        os.makedirs(mounted_path(root), exist_ok=True)
        return read(root)
    return spark.read.parquet(*out)
