"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Unit vectors at cosine >= c lie within d = sqrt(2 - 2c), so on a Gaussian
projection they differ by a normal deviate of scale d, whatever the dimension.
A pair collides on a projection when the second value lies in the window of
2d around the first; pairs that collide on enough of many projections are
verified by their cosine in double precision. The least count is the one that
a pair exactly at c misses with a probability of one in 10^5.

One window alone lets a third to half of all vectors through, so counting over
single sorted projections is quadratic. Vectors are therefore sorted into
cells of several projections at once, in as many tables as make sure that a
pair at c shares a cell with the asked-for recall; the width of a cell and the
number of projections follow from the number of vectors, so cells keep their
size as the table grows. A pair is counted in the first table it shares only,
so links are counted where they are found and never shipped as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagtide.llm.common import written
from flagtide.llm.components import components

#: Vectors of a chunk of a crowded cell; rows of a task's bucket of cells;
#: pairs looked at together.
CHUNK, BUCKET_ROWS, PAIRS = 256, 12_000, 500_000
MISSED = 1e-5


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_cell(distance: float, width: float) -> float:
    """Probability that two values ``distance`` apart (as a scale) fall into one
    cell of a grid with a random offset."""
    t = width / distance
    return 1 - 2 * _normal(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Plan:
    """Everything random or calibrated, from the threshold and the table's size."""

    cosine: float
    size: int
    recall: float = 0.995
    projections: int = 32
    crowd: int = 50  # unrelated vectors a cell should hold

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def width(self) -> float:
        return 3.36 * self.distance

    @property
    def window(self) -> float:
        return 2 * self.distance

    @property
    def grids(self) -> int:
        """Projections that make a cell."""
        far = same_cell(1.3, self.width)
        return max(1, math.ceil(math.log(max(2, self.size / self.crowd)) / -math.log(far)))

    @property
    def tables(self) -> int:
        near = same_cell(self.distance, self.width) ** self.grids
        return max(1, math.ceil(math.log(1 - self.recall) / math.log1p(-near)))

    @property
    def least_count(self) -> int:
        """The largest count reached with probability 1 - MISSED at the threshold."""
        p, m, total = 2 * _normal(2.0) - 1, self.projections, 0.0
        for count in range(m + 1):
            total += math.comb(m, count) * p**count * (1 - p) ** (m - count)
            if total > MISSED:
                return count
        return m

    def matrices(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([dim, 20240611])
        return (rng.standard_normal((dim, self.grids * self.tables)), rng.random(self.grids * self.tables) * self.width,
                rng.standard_normal((dim, self.projections)))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One number per vector and table."""
        a, b, _ = self.matrices(unit.shape[1])
        at = np.floor((unit @ a + b) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.grids)
        mix = np.random.default_rng(11).integers(1, 1 << 62, self.grids, dtype=np.int64) | 1
        return (at * mix).sum(axis=2) + np.arange(self.tables) * 0x5851F42D4C957F2D


_PLANS: dict = {}


def _matrices(plan: Plan, dim: int):
    if (plan, dim) not in _PLANS:
        _PLANS[plan, dim] = plan.matrices(dim)
    return _PLANS[plan, dim]


def unit_vectors(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    v = np.stack(rows).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def comparable(v: np.ndarray) -> bool:
    return len(v) > 0 and bool(np.isfinite(v).all()) and bool((v != 0).any())


def _vectors(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=kind) for b in column.to_pylist()]


# ------------------------------------------------------------------- distinct

def classes(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, vector (bytes; null where it links with nothing) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if e is None else e for e in v], dtype=np.float64) if v else np.empty(0)
                out.append((x + 0.0).astype(kind).tobytes() if comparable(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, vector binary")


def celled(distinct: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """node, weight, vector, cells (one number per table)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _vectors(b.column("vector"), kind)
            out: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i, c in zip(at, plan.cells(unit_vectors([vectors[i] for i in at]))):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "weight", "vector")),
                                              pa.array(out, pa.list_(pa.int64()))], ["node", "weight", "vector", "cells"])

    return distinct.mapInArrow(run, "node bigint, weight bigint, vector binary, cells array<bigint>")


# ---------------------------------------------------------------- the counting

def pair_ranges(starts: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j inside groups of consecutive rows, about ``limit`` at a time."""
    first = np.repeat(starts, sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = first + within
    partners = np.repeat(sizes, sizes) - within - 1  # later rows of the group
    keep = partners > 0
    left, partners = left[keep], partners[keep]
    total = np.cumsum(partners)
    at = 0
    while at < len(left):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit)))
        p = partners[at:to]
        i = np.repeat(left[at:to], p)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
        at = to


def collisions(values: np.ndarray, i: np.ndarray, j: np.ndarray, window: float) -> np.ndarray:
    """Projections on which the second vector lies in the window of the first."""
    count = np.zeros(len(i), dtype=np.int16)
    for column in values.T:
        count += np.abs(column[i] - column[j]) <= window
    return count


def bucket_links(batch: pa.Table, plan: Plan, kind: str) -> pa.Table:
    """Links inside the cells of one bucket: per vector the weight linked to it
    (``links``), and edges that connect what is linked (``other``)."""
    group, side = batch.column("grp").to_numpy(), batch.column("side").to_numpy()
    order = np.lexsort((side, group))
    group, side = group[order], side[order]
    table = batch.column("at").to_numpy()[order]
    node, weight = batch.column("node").to_numpy()[order], batch.column("weight").to_numpy()[order]
    vectors = _vectors(batch.column("vector"), kind)
    vectors = [vectors[k] for k in order]
    dims = np.array([len(v) for v in vectors])
    linked, edges = np.zeros(len(node), dtype=np.int64), []
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        unit = unit_vectors([vectors[k] for k in rows])
        grids, offsets, lines = _matrices(plan, int(dim))
        lines = (unit @ lines).astype(np.float32)
        own = plan.cells(unit)
        g, s, t = group[rows], side[rows], table[rows]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(g)]]))
        for i, j in pair_ranges(starts, sizes, PAIRS):
            # side 0: a cell of its own; sides 1 and 2: two chunks of a crowded one
            wanted = (s[i] != s[j]) | (s[i] == 0)
            i, j = i[wanted], j[wanted]
            close = collisions(lines, i, j, plan.window) >= plan.least_count
            i, j = i[close], j[close]
            if not len(i):
                continue
            sure = np.einsum("ij,ij->i", unit[i], unit[j]) >= plan.cosine
            i, j = i[sure], j[sure]
            shared = own[i] == own[j]
            first = shared.argmax(axis=1) == t[i]  # the first table the pair shares
            i, j = i[first], j[first]
            np.add.at(linked, rows[i], weight[rows[j]])
            np.add.at(linked, rows[j], weight[rows[i]])
            edges += _forest(node[rows[i]], node[rows[j]])
    hit = np.flatnonzero(linked)
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({"node": pa.array(np.concatenate([node[hit], np.array(a, dtype=np.int64)])),
                     "links": pa.array(np.concatenate([linked[hit], np.zeros(len(a), dtype=np.int64)])),
                     "other": pa.array([None] * len(hit) + list(b), pa.int64())})


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep connected what the given edges connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            out.append((x, y))
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, recall: float = 0.995, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings``.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; vectors of different lengths do not link with each other.
    Equal vectors are one class: they link with each other and with all links of
    the class. Rows that repeat an id are vectors of their own. A null id is
    kept, under its component's smallest id if it has links. An empty table gives
    no rows. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    double = "double" in dict(embeddings.dtypes)[vector_col]
    kind = "<f8" if double else "<f4"
    rows = written(classes(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)), kind))
    valid = rows.where("vector is not null").withColumn("node", F.xxhash64("vector", F.md5("vector")))
    distinct = written(valid.groupBy("node", "vector").agg(F.count(F.lit(1)).alias("weight"),
                                                          F.min("vec_id").alias("vec_id")))
    plan = Plan(cosine, distinct.count(), recall)
    posted = written(celled(distinct.select("node", "weight", "vector"), plan, kind))
    keys = posted.select("node", F.posexplode("cells").alias("at", "cell"))
    # crowded cells are cut into chunks, and every two chunks make a group
    crowded = keys.groupBy("at", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    crowded = written(crowded)
    placed = posted.select("node", "weight", "vector", F.posexplode("cells").alias("at", "cell"))
    if crowded.isEmpty():
        grouped = placed.select("*", F.xxhash64("at", "cell").alias("grp"), F.lit(0).alias("side"))
    else:
        marked = placed.join(crowded, ["at", "cell"], "left")
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        alone = F.array(F.struct(F.xxhash64("at", "cell").alias("grp"), F.lit(0).alias("side")))
        # a chunk meets itself (side 0) and every other chunk (sides 1 and 2)
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
            F.xxhash64("at", "cell", F.least(c, chunk), F.greatest(c, chunk)).alias("grp"),
            F.when(c == chunk, 0).when(c > chunk, 1).otherwise(2).alias("side")))
        grouped = marked.select("node", "weight", "vector", "at", "cell", F.explode(
            F.when(F.col("chunks").isNull(), alone).otherwise(pairs)).alias("g")).select(
            "node", "weight", "vector", "at", "cell", "g.grp", "g.side")
    buckets = max(1, plan.size * plan.tables // BUCKET_ROWS)
    grouped = grouped.select("node", "weight", "vector", "at", "grp", "side",
                             F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"))
    found = written(grouped.groupBy("bucket").applyInArrow(
        lambda t: bucket_links(t, plan, kind), "node bigint, links bigint, other bigint"))
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select("node", "other"), "node", "other")
    merged = distinct.select("node", "weight", "vec_id").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = merged.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    merged = merged.join(least, "component").join(counts, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.select("vec_id", "node").join(merged, "node").select("vec_id", "n_links", "component_id")
    lone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                               F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn(
        "kept", F.col("vec_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id")))
