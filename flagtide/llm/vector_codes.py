"""Integer codes of vectors: a codebook per part, found by exact nearest entries
in the Walsh-Hadamard domain.

Parts and entries are padded with zeros to a power of two and transformed with
the integer Walsh-Hadamard transform, rows in sequency order (by number of sign
changes). A transform of size n scales squared distances by n exactly, so they
may be summed over coefficients, slow ones first: an entry whose sum so far is
above the whole distance of another one is out before the rest is looked at.
All numbers are integers. Codebooks are averaged from sums that every task
makes of its own rows; only entries reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagtide.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are held within this; larger ones (beyond 2^45 as floats) count as it.
LARGEST = 1 << 53
_LONG = (1 << 63) - 1


@lru_cache
def walsh(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows in sequency order."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two, in the Walsh-Hadamard domain."""
    width = x.shape[1]
    n = 1 << max(0, width - 1).bit_length()
    return x @ walsh(n)[:, :width].T.astype(x.dtype)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of every row, the first of
    equal ones. Integers only: 64-bit ones where no sum can leave them, Python's else."""
    width = rows.shape[1]
    n = 1 << max(0, width - 1).bit_length()
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * n * n * n * most * most >= 1 << 62:
        rows, entries = rows.astype(object), entries.astype(object)
    x, c = transformed(rows), transformed(entries)
    # first coefficient for all pairs; the entry that is nearest in it bounds the distance
    so_far = (x[:, :1] - c[None, :, 0]) ** 2
    guess = so_far.argmin(axis=1)
    limit = ((x - c[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero((so_far <= limit[:, None]).astype(bool))
    total = so_far[row, entry]
    for k in range(1, n):
        total = total + (x[row, k] - c[entry, k]) ** 2
        if k + 1 == n or k & (k + 1) == 0:  # the ones left shrink fast at first
            alive = (total <= limit[row]).astype(bool)
            row, entry, total = row[alive], entry[alive], total[alive]
    # pairs are ordered by row, then entry: of the smallest totals the first stands
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    best = np.minimum.reduceat(total, starts) if len(row) else total
    is_best = np.flatnonzero((total == np.repeat(best, np.diff(np.append(starts, len(row))))).astype(bool))
    first = is_best[np.append(True, row[is_best][1:] != row[is_best][:-1])] if len(row) else is_best
    return entry[first], total[first] // n


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers padded with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances of all parts (rows x parts)."""
    width = x.shape[1] // len(books)
    found = [nearest(x[:, p * width:(p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _moved(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: sums per task, added up by Spark."""
    part_width = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), dtype=np.int64)
        sums = np.zeros((len(books), len(books[0]), part_width), dtype=object)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if not len(x):
                continue
            codes, _ = _assigned(x, books)
            for p in range(len(books)):
                part = x[:, p * part_width:(p + 1) * part_width]
                order = np.argsort(codes[:, p], kind="stable")
                used, starts = np.unique(codes[order, p], return_index=True)
                counts[p, used] += np.diff(np.append(starts, len(order)))
                # sums of a batch: below 2^63 as long as rows x largest are
                whole = part[order] if len(x) * int(np.abs(x).max(initial=0)) < _LONG else part[order].astype(object)
                sums[p, used] += np.add.reduceat(whole, starts, axis=0)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()),
             pa.array([[str(v) for v in row] for row in sums[p, e]], pa.list_(pa.string()))],
            ["part", "entry", "n", "sums"])

    rows = kept.select("x").mapInArrow(run, "part int, entry int, n bigint, sums array<string>")
    added = rows.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    moved = [b.copy() for b in books]
    for r in added.collect():  # parts x entries x positions
        moved[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return moved


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, ``code`` (two hex digits a part), ``error`` (sum of the
    squared distances), ``label_error`` (its sum over equal labels, nulls together) and
    ``codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components are left out.
    Components become floor(scale * x), held within 2^53 either way. Codebooks start
    as the vectors of the ``entries`` smallest ids (null ids last, equal ids by
    their components); fewer vectors make fewer entries. Vectors are as wide as the longest,
    rounded up to a multiple of ``parts``; shorter ones, the empty one too, are filled with
    zeros. Rows that repeat are vectors of their own. An error beyond a long is the largest
    long. An empty table gives no rows. Other columns are not looked at.
    """
    x = F.col("v")
    whole = F.transform(x, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), F.floor(F.lit(float(scale)) * c).cast("double"))).cast("long"))
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = written(vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(
        x.isNotNull() & finite).select("id", "label", whole.alias("x")))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    seeds = kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    filled = np.array([r["x"] + [0] * (width - len(r["x"])) for r in seeds], dtype=np.int64).reshape(len(seeds), width)
    books = [filled[:, p * width // parts:(p + 1) * width // parts].copy() for p in range(parts)]
    if seeds:
        for _ in range(rounds):
            books = _moved(kept, books, width)
    digits = [f"{e:02x}" for e in range(max(entries, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = _assigned(_matrix(batch.column("x"), width), books)
            text = ["".join([digits[c] for c in row]) for row in codes.tolist()]
            total = [min(_LONG, int(sum(row))) for row in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(total, pa.int64())],
                ["id", "label", "code", "error"])

    types = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = written(kept.mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error bigint"))
    # a written table has a known size: few labels are broadcast, many are joined by key
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("total")))
    largest = F.lit(_LONG).cast("decimal(38,0)")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", F.least("total", largest).cast("long").alias("label_error"),
        F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
