"""Near-duplicates through an inverted join of MinHash signature coordinates.

Every distinct shingle set gets a signature of K coordinates and is posted
under its coordinate-value pairs. Two sets whose signatures agree in at least T
coordinates must share one of the K-T+1 rarest pairs of either (the prefix), so
only those are posted; sets with fewer than T pairs that occur elsewhere at all
are skipped whole. Within a posting list every set is compared with the list's
most central set only, which gathers near-copies into families. Inside a
family links are confirmed on the full sets: first against the family's centre,
and then, block against block, for all pairs that are neither linked yet nor
ruled out by the triangle inequality of Jaccard distances from the centre.

T lies five standard deviations below the agreement expected at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flagtide.llm.common import LOWER, UPPER, slices, without_rows, word_hashes, written
from flagtide.llm.components import components

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows of a chunk of a large family, and width of its distance shells.
BLOCK, SHELL = 96, 0.05


@dataclass(frozen=True)
class Settings:
    """``words`` to a shingle; link at intersection * per >= least * union."""

    words: int = 5
    least: int = 80
    per: int = 100
    coordinates: int = 64

    @property
    def threshold(self) -> float:
        return self.least / self.per

    @property
    def matches(self) -> int:
        mean = self.coordinates * self.threshold
        return max(1, math.floor(mean - 5 * math.sqrt(mean * (1 - self.threshold))))

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


# ------------------------------------------------------------- sets, signatures

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a sequence of word hashes: ``k`` words
    each; fewer than ``k`` words are one shingle, none is the empty set."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def shingles_of(texts: list, k: int) -> list[np.ndarray]:
    """The shingle set of every text, after lower-casing A-Z."""
    hashes, counts = word_hashes([t.encode().translate(FOLD) if t else b"" for t in texts])
    return [shingle_set(h, k) for h in np.split(hashes, np.cumsum(counts)[:-1])]


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each of ``n`` hash functions over the set."""
    a, b = _coefficients(n)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        x, y = low[at:at + 4096][:, None], high[at:at + 4096][:, None]
        v = x * a + b
        v = (v ^ (v >> np.uint32(15)) ^ y) * a[::-1]
        np.minimum(out, v.min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, row_key, n_shingles, set_hash (of the whole set) and sig (K numbers)
    of doc_id, text, row_key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, hashes, sigs = [], [], []
            for shingles in shingles_of(batch.column(1).to_pylist(), s.words):
                sizes.append(len(shingles))
                hashes.append(set_hash(shingles))
                sigs.append(signature(shingles, s.coordinates).view(np.int32) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "row_key", "n_shingles", "set_hash", "sig"])

    return docs.mapInArrow(run, "doc_id bigint, row_key bigint, n_shingles bigint, set_hash binary, sig array<int>")


def set_hash(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_hash, shingles (sorted 64-bit values, as bytes) of a column of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles_of(batch.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in sets], pa.binary()),
                                              pa.array([x.tobytes() for x in sets], pa.binary())],
                                             ["set_hash", "shingles"])

    return docs.mapInArrow(run, "set_hash binary, shingles binary")


# ---------------------------------------------------------------- the join

def postings(sets: DataFrame, s: Settings) -> DataFrame:
    """token, node, weight: the posted coordinate-value pairs of every set that
    has enough shared ones. ``weight`` tells how common its pairs are."""
    each = sets.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node", F.xxhash64("at", "value").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = each.join(shared, "token")
    by_node = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    by_node = by_node.where(F.size("tokens") >= s.matches)  # at most K entries to a node
    # pairs that occur nowhere else come first in the order and need no posting
    lone = F.lit(s.coordinates) - F.size("tokens")
    weight = F.aggregate("tokens", F.lit(0.0), lambda acc, t: acc + F.ln(t["df"].cast("double")))
    return by_node.select("node", weight.alias("weight"), F.explode(
        F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.lit(s.prefix) - lone))).alias("t")).select(
        F.col("t.token").alias("token"), "node", "weight")


def _agreement(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, v: acc + v)


def families(sets: DataFrame, s: Settings, rounds: int = 3) -> DataFrame:
    """node, family, weight: sets that agree with the centre of a posting list
    in at least half of the coordinates a link needs come into one family. Sets
    far from the centre stay in the list for the next round, which has a centre
    of its own; after the last round what is left of a list is a family."""
    posts = written(postings(sets, s))
    weights = posts.groupBy("node").agg(F.max("weight").alias("weight"))
    sigs = sets.select("node", "sig")
    edges = None
    rest = posts
    for turn in range(rounds):
        centre = rest.groupBy("token").agg(F.max(F.struct("weight", -F.col("node"))).alias("top"),
                                           F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "token", (-F.col("top.col2")).alias("centre"))
        listed = rest.join(centre, "token").where("node != centre").select("token", "node", "weight", "centre")
        listed = written(listed)
        pairs = listed.select("node", "centre").distinct()
        checked = pairs.join(sigs, "node").join(
            sigs.select(F.col("node").alias("centre"), F.col("sig").alias("other")), "centre").select(
            "node", "centre", (_agreement("sig", "other") * 2 >= s.matches).alias("near"))
        checked = written(checked)
        last = turn == rounds - 1
        new = checked.select("node", "centre") if last else checked.where("near").select("node", "centre")
        edges = new if edges is None else edges.unionByName(new)
        if last:
            break
        far = checked.where("not near").select("node", "centre")
        rest = written(listed.join(far, ["node", "centre"], "left_semi").select("token", "node", "weight"))
        if rest.isEmpty():
            break
    found = components(edges, "node", "centre")
    return found.join(weights, "node").select("node", F.col("component").alias("family"), "weight")


# ----------------------------------------------------------------- full sets

def jaccard_parts(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs."""
    n = len(sets)
    rows = np.repeat(np.arange(n), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[columns] > 1
    rows, columns = rows[keep], columns[keep]
    order = np.unique(columns, return_inverse=True)
    columns, width = order[1], len(order[0])
    out = np.zeros((n, n), dtype=np.float32)
    step = 8192
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    for at in range(0, width, step):
        lo, hi = np.searchsorted(columns, [at, at + step])
        m = np.zeros((n, min(step, width - at)), dtype=np.float32)
        m[rows[lo:hi], columns[lo:hi] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep what the matrix connects connected."""
    n = len(adjacent)
    seen, edges = np.zeros(n, dtype=bool), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(adjacent[x] & ~seen):
                seen[y] = True
                edges.append((x, int(y)))
                todo.append(int(y))
    return edges


def block_links(batch: pa.Table, s: Settings) -> pa.Table:
    """Links inside one block, as a forest (a group of at most two chunks)."""
    nodes = batch.column("node").to_numpy()
    sets = [np.frombuffer(b, dtype=np.uint64) for b in batch.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    inter = jaccard_parts(sets, sizes)
    union = sizes[:, None] + sizes[None, :] - inter
    edges = spanning(inter * s.per >= s.least * union)
    return pa.table({"a": pa.array([nodes[x] for x, _ in edges], pa.int64()),
                     "b": pa.array([nodes[y] for _, y in edges], pa.int64())})


def links(sets: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """a, b: links between distinct sets, enough to connect what belongs together.

    ``sets``: node, set_hash, doc_id (of one row with the set), sig; ``texts``: doc_id, text."""
    found = written(families(sets, s))
    wanted = found.join(sets.select("node", "doc_id"), "node").select("doc_id").distinct()
    full = shingle_sets(texts.join(wanted, "doc_id").select("text"), s.words)
    # rows that share an id give other sets as well; a set is met by its whole 128-bit hash
    members = written(found.join(sets.select("node", "set_hash"), "node").join(full, "set_hash").drop("set_hash")
                      .dropDuplicates(["node"]))
    centres = members.groupBy("family").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for x, y in zip(b.column("shingles"), b.column("middle")):
                p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                rows.append((both, len(p) + len(q) - both))
            inter, union = (pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "family", "centre")), inter, union],
                                             ["node", "family", "centre", "inter", "uni"])

    middles = centres.join(members.select(F.col("node").alias("centre"), F.col("shingles").alias("middle")), "centre")
    star = written(members.join(middles, "family").select("node", "family", "centre", "shingles", "middle").mapInArrow(
        measured, "node bigint, family bigint, centre bigint, inter bigint, uni bigint").select(
        "node", "family", "centre", (F.col("inter") * s.per >= F.col("uni") * s.least).alias("linked"),
        F.floor((1 - F.col("inter") / F.col("uni")) / SHELL).cast("int").alias("shell")))
    linked = star.where("linked and node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))

    # the centre has been compared with everybody; the others are compared in
    # chunks of members at about the same distance from it, small families whole
    open_ = star.where("node != centre").groupBy("family").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("apart")).where("members > 1 and apart > 0")
    large = F.col("members") > BLOCK
    rows = star.where("node != centre").join(open_, "family").select(
        "family", "node", (large & F.col("linked")).alias("linked"), F.when(large, F.col("shell")).otherwise(0).alias("shell"))
    chunk = ["family", "linked", "shell", "part"]
    parts = rows.groupBy("family", "linked", "shell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, chunk[:3]).select(
        *chunk[:3], "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    each = parts.select(*chunk[:3], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sides = [each.select("family", F.struct(*chunk[1:]).alias(f"side{i}")) for i in (1, 2)]
    reach = math.ceil((1 - s.threshold) / SHELL) + 1
    blocks = sides[0].join(sides[1], "family").where(
        (F.col("side1") <= F.col("side2")) & ~(F.col("side1.linked") & F.col("side2.linked"))
        & (F.abs(F.col("side1.shell") - F.col("side2.shell")) <= reach))
    needed = blocks.select("family", F.xxhash64("side1", "side2").alias("block"),
                           F.explode(F.array_distinct(F.array("side1", "side2"))).alias("side"))
    needed = needed.select("family", "block", "side.*")
    keyed = rows.join(needed, chunk).select("family", "block", "node").join(members.select("node", "shingles"), "node")
    inside = keyed.groupBy("family", "block").applyInArrow(
        lambda table: block_links(table, s), "a bigint, b bigint")
    return linked.unionByName(inside)


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_key: one row per row of ``docs``.

    Null texts and texts without words have the empty set and link with
    nothing. Rows with equal sets are one class (linked). Rows that repeat an
    id are judged each by its own text. A null id has a null component unless
    linked, and is kept. An empty table gives no rows. Other columns are not
    looked at.
    """
    s = settings
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(signatures(texts.withColumn("row_key", F.xxhash64("doc_id", "text")), s))
    # a distinct set is known by its 128-bit hash, and numbered as it is written
    classes = written(rows.where("n_shingles > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))
    found = components(links(classes.where("doc_id is not null"), texts, s))
    merged = classes.select("set_hash", "doc_id", "node").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = merged.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    merged = merged.join(least, "component").select("set_hash", "component_id")
    columns = ["doc_id", "n_shingles", "component_id", "row_key"]
    linked = rows.where("n_shingles > 0").join(merged, "set_hash").select(*columns)
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key")
    return linked.unionByName(empty).withColumn(
        "kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns unchanged."""
    gone = written(near_duplicates(docs, settings, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias("__ft_id"), F.col("row_key").alias("__ft_gone")).distinct())
    keyed = docs.withColumn("__ft_key", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    return without_rows(keyed, gone, id_col).select(*docs.columns)
