"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Texts become sequences of word numbers, the windows of the items patterns over
them. Patterns of one length share three tables: the shift of a block of two
words says how far the search may go on when it ends in that block (blocks that
stand in no pattern let it pass almost a whole window), buckets by the hash of
the last block and of the first one select the patterns that may end there, and
these are compared with the text word by word. The search runs along many
places of a slice of documents in step (numpy); documents are only mapped over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flagtide.llm.common import slices, written
from flagtide.llm.terms import BLOCK_BYTES, as_bytes, item_blocks, numbered, words

WINDOW = 10
#: Words that one search goes through, and places of it that advance in step.
SEARCH_WORDS, STRIDE = 1 << 18, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Patterns:
    """Wu-Manber tables of different patterns (rows of word numbers) of one length."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        places = self.m - self.block + 1
        bits = min(22, max(10, int(8 * len(rows) * places).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, places, dtype=np.int32)
        for q in range(places):  # the last word of the block is word q + block - 1
            np.minimum.at(self.shift, self._hash(rows, q + self.block - 1), places - 1 - q)
        # buckets: patterns in the order of the hashes of their last and first block
        key = self._bucket(self._hash(rows, self.m - 1), rows, self.block - 1)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _mixed(self, columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h + c.astype(np.int64).view(np.uint64) + np.uint64(2)) * _ODD
            h ^= h >> np.uint64(29)
        return h * _MIX

    def _hash(self, rows: np.ndarray, last: int) -> np.ndarray:
        return (self._mixed([rows[:, i] for i in range(last - self.block + 1, last + 1)]) >> self.down).astype(np.int64)

    def _bucket(self, suffix: np.ndarray, rows: np.ndarray, last: int) -> np.ndarray:
        prefix = self._mixed([rows[:, i] for i in range(last - self.block + 1, last + 1)]) >> np.uint64(32)
        return (suffix.astype(np.uint64) << np.uint64(32)) | prefix

    def _block_at(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._mixed([text[ends - i] for i in range(self.block - 1, -1, -1)]) >> self.down).astype(np.int64)

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Places where a pattern may end: all others are jumped over."""
        at = np.arange(self.m - 1, len(text), STRIDE)
        stop = np.minimum(at + STRIDE, len(text))
        found = []
        while len(at):
            jump = self.shift[self._block_at(text, at)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        return np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last places, pattern numbers) of all occurrences in ``text``."""
        ends = self.candidates(text)
        if not len(ends):
            return ends, ends
        first = ends - (self.m - 1)
        heads = np.stack([text[first + i] for i in range(self.block)], axis=1)
        key = self._bucket(self._block_at(text, ends), heads, self.block - 1)
        low = np.searchsorted(self.keys, key, side="left")
        high = np.searchsorted(self.keys, key, side="right")
        out_at, out_row = [], []
        while True:  # the members of the buckets, one of each at a time
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            ends, first, low, high = ends[open_], first[open_], low[open_], high[open_]
            row = self.order[low]
            same = np.ones(len(ends), dtype=bool)
            for i in range(self.m):
                same[same] = text[first[same] + i] == self.rows[row[same], i]
            out_at.append(ends[same])
            out_row.append(row[same])
            low = low + 1
        if not out_at:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(out_at), np.concatenate(out_row)


class Windows:
    """The windows of a block of items: word numbers, Wu-Manber tables of every
    length, and the items of every window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.known: dict[bytes, int] = {}
        held: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, data in items:
            name = "" if item is None else str(item)
            ids = [self.known.setdefault(w, len(self.known)) for part in words(data) for w in part]
            size = min(window, len(ids))
            for a in range(len(ids) - size + 1 if ids else 0):
                held.setdefault(size, {}).setdefault(tuple(ids[a:a + size]), set()).add(name)
        self.tables = [(Patterns(np.array(list(p), dtype=np.int32)), [sorted(n) for n in p.values()])
                       for _, p in sorted(held.items())]

    def search(self, texts: list[np.ndarray]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By number of a text with a hit: its hit words as half-open runs, and
        the items found. Between two texts stands a word of no item."""
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.full(int(starts[-1]), -1, dtype=np.int32)
        for a, t in zip(starts.tolist(), texts):
            text[a:a + len(t)] = t
        cover = np.zeros(len(text) + 1, dtype=np.int32)
        names: dict[int, set[str]] = {}
        for patterns, items in self.tables:
            ends, rows = patterns.find(text)
            np.add.at(cover, ends - (patterns.m - 1), 1)
            np.add.at(cover, ends + 1, -1)
            which = np.searchsorted(starts, ends, side="right") - 1
            for doc, row in np.unique(np.stack([which, rows], axis=1), axis=0).tolist():
                names.setdefault(doc, set()).update(items[row])
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        runs: dict[int, list[tuple[int, int]]] = {}
        for a, z in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            runs.setdefault(doc, []).append((a - int(starts[doc]), z - int(starts[doc])))
        return {doc: (runs[doc], found) for doc, found in names.items()}


FOUND = "n_words bigint, spans array<struct<`from`: int, `to`: int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _searched(docs: DataFrame, windows: Windows) -> DataFrame:
    """``docs`` (id, key, data) as id, key and what the search finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = batch.column("data").to_pylist()
            counts, found, held, size = [], {}, [], 0
            for i, d in enumerate(data):
                ids = numbered(d, windows.known)
                counts.append(len(ids))
                held.append((i, ids))
                size += len(ids)
                if size >= SEARCH_WORDS or i + 1 == len(data):
                    hits = windows.search([t for _, t in held])
                    found |= {held[n][0]: hit for n, hit in hits.items()}
                    held, size = [], 0
            spans = [[{"from": a, "to": z} for a, z in found[i][0]] if i in found else [] for i in range(len(data))]
            items = [sorted(found[i][1]) if i in found else [] for i in range(len(data))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS),
                 pa.array(items, pa.list_(pa.string()))], ["id", "key", "n_words", "spans", "items"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, key binary, {FOUND}")


def _covered(spans: Column) -> Column:
    """Length of the union of half-open runs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.sort_array(spans), zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["to"] - F.greatest(x["from"], s["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(s["end"], x["to"]).alias("end")), lambda s: s["n"])


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_hit, ``items`` (ids of the items
    found, sorted strings) and ``spans`` (runs of words, half-open, inside occurrences).

    Words are runs of 0-9, A-Z (lower-cased), a-z and all characters beyond
    ASCII. An item's windows are its ``window`` consecutive words, all its words if
    it has fewer; an item without words has none. Null texts have no words. Rows
    of ``docs`` that repeat are documents of their own; items that repeat an id
    are one item with the windows of all, a null id is written as the empty
    text. Other columns are not looked at. Without items nothing is hit.

    Items go to the tasks in blocks of ``block_bytes`` of text. Every block
    searches all documents; what blocks find is put together by document (runs of
    different blocks may overlap).
    """
    base = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("data"))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        rows = _searched(base.withColumn("key", F.lit(None).cast("binary")), Windows(first, window))
    else:
        # rows that agree in id and text have the same hits, so a digest stands for the row;
        # what a block finds is written before the next block's tables are made
        keyed = base.withColumn("key", F.unhex(F.sha2("data", 256)))
        everything = written(_searched(keyed, Windows(first, window)))
        more = [written(_searched(keyed, Windows(b, window)).where(F.size("items") > 0)) for b in chain([second], blocks)]
        hits = reduce(DataFrame.unionByName, more).groupBy("id", "key").agg(
            F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
        same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key"))
        joined = everything.alias("a").join(hits.alias("b"), same, "left")
        none = lambda c, like: F.coalesce(c, F.filter(like, lambda _: F.lit(False)))
        rows = joined.select("a.id", "a.n_words",
                             F.concat("a.spans", none(F.col("b.more_spans"), F.col("a.spans"))).alias("spans"),
                             F.concat("a.items", none(F.col("b.more_items"), F.col("a.items"))).alias("items"))
    return rows.select(F.col("id").alias(id_col), "n_words", _covered(F.col("spans")).alias("n_hit"),
                       F.array_sort(F.array_distinct("items")).alias("items"), F.sort_array("spans").alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """``find`` in digest form: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, items, **names)
    return found.select(
        names.get("id_col", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
