"""Ranked lexical search by presence masks.

Documents become lists of the items' terms with their counts, written once; the
counts over the whole corpus (documents, terms, documents of a term) follow from
them. Blocks of documents are then searched for every item: each of its terms
has a bitmap over the block's documents, turned bitwise the bitmaps give every
document's mask of matched terms, and documents of equal masks form a group. The
highest score that a mask allows is the sum of its terms' best contributions in
the block; groups are evaluated by descending bound, until the bound falls below
the lowest of the best scores found so far. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flagtide.llm.common import slices, written
from flagtide.llm.terms import BLOCK_BYTES, as_bytes, item_blocks, words

#: Documents of a block; documents evaluated together at least; bits of an item's bitmaps.
BLOCK_DOCS, STEP_DOCS, MASK_BITS = 1 << 14, 256, 1 << 22


def term_counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """id, n (terms with repeats), terms (numbers of ``known``, ascending) and their
    counts: one row per document of ``docs`` (id, data) with at least one term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, terms, counts = [], [], []
            for data in batch.column("data").to_pylist():
                n, tally = 0, Counter()
                for part in words(data):
                    n += len(part)
                    tally.update(filter(known.__contains__, part))
                found = sorted((known[w], c) for w, c in tally.items())
                sizes.append(n)
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, n bigint, terms array<int>, counts array<bigint>").where("n > 0")


def weight(n_docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * with_term + 1)))


class Postings:
    """A block of documents by term: their places in the block and contributions."""

    def __init__(self, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, n_terms: int):
        self.n = len(sizes)
        m = 100 - 25 + (25 * sizes * n_docs) // n_terms
        part = (1_000_000_000 * count) // (1000 * count + 12 * m[doc])
        order = np.argsort(term, kind="stable")  # places stay ascending within a term
        self.doc, self.part = doc[order], part[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.best = np.maximum.reduceat(self.part, self.first) if len(order) else self.part

    def of(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the lists of those ``terms`` that stand in the block, else -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def masks(postings: Postings, lists: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from ``start`` to ``stop`` of the documents with any of the terms, and their
    masks: rows of 64-bit words, bit j (from the lowest) for list j."""
    maps = np.zeros((-(-len(lists) // 64) * 64, -(-(stop - start) // 8)), dtype=np.uint8)  # a bitmap per term
    for j, x in enumerate(lists.tolist()):
        found = postings.doc[postings.first[x]:postings.last[x]]
        bits = np.zeros(stop - start, dtype=bool)
        bits[found[np.searchsorted(found, start):np.searchsorted(found, stop)] - start] = True
        maps[j] = np.packbits(bits)
    places = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(maps, axis=0))[:stop - start])
    turned = np.unpackbits(maps, axis=1)[:, places]  # bitmaps of terms to masks of documents
    packed = np.packbits(turned, axis=0, bitorder="little")
    return places + start, np.ascontiguousarray(packed.T).view(np.uint64)


def grouped(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal masks side by side, and the starts of the groups."""
    order = np.lexsort(mask.T)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (mask[order[1:]] != mask[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new)


def search(postings: Postings, lists: np.ndarray, factor: np.ndarray, top: int, floor: int, start: int,
           stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of documents from ``start`` to ``stop`` that score above 0; among
    them all that are of the ``top`` best (ties included) with at least ``floor``.

    ``lists``: the item's terms in the block; ``factor``: weight times repeats."""
    places, mask = masks(postings, lists, start, stop)
    if not len(places):
        return places, places
    order, starts = grouped(mask)
    ends = np.append(starts[1:], len(order))
    heads = mask[order[starts]]
    has = ((heads[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(starts), -1)[:, :len(lists)] > 0
    bound = has.astype(np.int64) @ (factor * postings.best[lists])
    by_bound = np.argsort(-bound, kind="stable")
    total = np.cumsum((ends - starts)[by_bound])
    kept_at, kept_score, at = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    while at < len(by_bound) and bound[by_bound[at]] >= max(1, floor):
        done = total[at - 1] if at else 0
        to = min(len(by_bound), int(np.searchsorted(total, done + STEP_DOCS)) + 1)
        groups = by_bound[at:to]
        sizes = ends[groups] - starts[groups]
        of_doc = np.repeat(np.arange(len(groups)), sizes)
        within = np.arange(len(of_doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        docs = places[order[starts[groups][of_doc] + within]]
        score = np.zeros(len(docs), dtype=np.int64)
        for j, x in enumerate(lists.tolist()):
            with_term = has[groups, j][of_doc]
            a, z = postings.first[x], postings.last[x]
            where = a + np.searchsorted(postings.doc[a:z], docs[with_term])
            score[with_term] += factor[j] * postings.part[where]
        kept_at, kept_score = np.concatenate([kept_at, docs]), np.concatenate([kept_score, score])
        if len(kept_score) > top:
            least = np.partition(kept_score, len(kept_score) - top)[len(kept_score) - top]
            floor = max(floor, int(least))
            good = kept_score >= least
            kept_at, kept_score = kept_at[good], kept_score[good]
        at = to
    good = kept_score > 0
    return kept_at[good], kept_score[good]


class Best:
    """The best documents of one item so far: higher scores first, then smaller ids
    (none before all)."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: list[int], ids: list) -> None:
        rows = self.rows + list(zip(scores, ids))
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))
        self.rows = rows[:self.top]


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            held.append(batch.slice(at, n))
            if sum(b.num_rows for b in held) >= n:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(counted: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int,
          block_docs: int) -> DataFrame:
    """item, score, id: the best of every partition for every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(top) for item, _, _ in items}
        id_type = None
        for block in _blocks(batches, block_docs):
            id_type = block.schema.field("id").type
            terms, counts = (block.column(c).combine_chunks() for c in ("terms", "counts"))
            lengths = np.diff(terms.offsets.to_numpy())
            postings = Postings(block.column("n").to_numpy(), np.repeat(np.arange(block.num_rows), lengths),
                                terms.flatten().to_numpy(), counts.flatten().to_numpy(), n_docs, n_terms)
            ids = block.column("id")
            for item, numbers, factor in items:
                lists = postings.of(numbers)
                there = lists >= 0
                step = max(64, MASK_BITS // max(1, int(there.sum())))  # fewer documents at once for very long items
                for a in range(0, postings.n if there.any() else 0, step):
                    at, score = search(postings, lists[there], factor[there], top, best[item].floor, a,
                                       min(a + step, postings.n))
                    best[item].add(score.tolist(), ids.take(pa.array(at)).to_pylist())
        rows = [(item, score, doc) for item, b in best.items() for score, doc in b.rows]
        for at in range(0, len(rows), 10_000):
            cols = list(zip(*rows[at:at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], id_type)], ["item", "score", "id"])

    id_type = counted.schema["id"].dataType.simpleString()
    return counted.mapInArrow(run, f"item int, score bigint, id {id_type}")


def rank(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
         block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of every item with a
    score above 0; of equal scores the smaller id comes first, a null id before all.

    Terms are runs of 0-9, A-Z (lower-cased), a-z and all characters beyond ASCII;
    null texts have none. Rows of ``docs`` that repeat are documents of their own.
    Item rows that repeat id and text count once; items that share only their id
    are ranked each on its own. Items without terms, and an empty table on either
    side, give no rows. Other columns are not looked at. Items go to the tasks in
    blocks of ``block_bytes`` of text, each block reads all documents.
    """
    spark = docs.sparkSession
    item_type, doc_type = (df.schema[c].dataType for df, c in ((items, item_id), (docs, id_col)))
    base = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("data"))
    parts = []
    for block in item_blocks(items, item_id, item_text, block_bytes):
        known: dict[bytes, int] = {}
        tallies = [Counter(known.setdefault(w, len(known)) for part in words(data) for w in part) for _, data in block]
        counted = written(term_counts(base, known))
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())
        wanted = []
        for number, tally in enumerate(tallies):
            terms = sorted(t for t in tally if t in holding)
            factor = [tally[t] * weight(n_docs, holding[t]) for t in terms]
            wanted.append((number, np.array(terms, dtype=np.int32), np.array(factor, dtype=np.int64)))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
        best = _best(counted, wanted, n_docs, n_terms, top, block_docs).withColumn(
            "rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)],
                                      f"item int, item_id {item_type.simpleString()}")
        parts.append(best.join(F.broadcast(names), "item").select(
            F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame(
            [], f"`{item_id}` {item_type.simpleString()}, rank int, `{id_col}` {doc_type.simpleString()}, score bigint")
    return reduce(DataFrame.unionByName, parts)
