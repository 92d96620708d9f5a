"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flagtide.session import materialize, shared_path, ship_package

# A-Z and their lower-case forms, the only letters that change.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time, so that only those are turned into
    Python objects at once. At the end of the task freed memory goes back."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        release_memory()


def release_memory() -> None:
    """Python workers outlive their tasks; what a task has freed goes back to
    the operating system, so the stages of a job do not add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(23).integers(1, 1 << 62, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the number of words of each.

    Words are runs of bytes other than space and \\t..\\r. All words are hashed
    at once: the sums of a running polynomial at both ends of a word give its
    hash, whatever its place."""
    parts = [t + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the last byte is a space
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up)])
    h = (sums[last] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    counts = np.diff(np.searchsorted(first, np.cumsum([0, *map(len, parts)])))
    return h ^ (h >> np.uint64(29)), counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder and read back: the
    plan above is cut, and the rows outlive any executor."""
    ship_package(df.sparkSession)
    return materialize(df)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return shared_path(spark, what)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, UPPER, LOWER))


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the duration of a block (``__`` stands for a dot)."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def key_filter(df: DataFrame, column: str, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``keys`` (or, with
    ``inside`` false, the others), told by a bitmap of hashed keys.

    The bitmap is broadcast: 16 bits to a key and 64 MB at most, whatever the
    number of keys. Rows wrongly let through are left to the join that follows,
    so beyond that size only the saving is lost, never a row.
    """
    bits = 1 << min(29, max(18, (16 * max(1, keys.count())).bit_length()))
    page = 1 << 15
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    pages = keys.where(F.col(key).isNotNull()).select(at(key).alias("at")).groupBy(
        F.floor(F.col("at") / page).alias("__ft_page")).agg(F.bitmap_construct_agg(F.col("at") % page).alias("__ft_map"))
    found = df.withColumn("__ft_at", at(column)).withColumn("__ft_page", F.floor(F.col("__ft_at") / page))
    found = found.join(F.broadcast(pages), "__ft_page", "left")
    bit = (F.col("__ft_at") % page).cast("int")
    byte = F.conv(F.hex(F.substring("__ft_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return found.where(hit if inside else ~hit).select(*df.columns)


def without_rows(keyed: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``keyed`` (with a column __ft_key) without the rows whose id and key are in
    ``gone`` (__ft_id, __ft_gone; a written table)."""
    rest = key_filter(keyed, "__ft_key", gone, "__ft_gone", inside=False)
    maybe = key_filter(keyed, "__ft_key", gone, "__ft_gone")
    same = F.col(id_col).eqNullSafe(F.col("__ft_id")) & (F.col("__ft_key") == F.col("__ft_gone"))
    return rest.unionByName(maybe.join(gone, same, "left_anti"))
