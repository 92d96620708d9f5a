"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Lengths are whole numbers up to the window, so bins with the same room left
are interchangeable and pieces of one length are too. Best-fit decreasing is
therefore run on the histogram of piece lengths (one number per length,
whatever the corpus size): a segment tree over the remaining capacities finds
the tightest open bin for a length in logarithmic time, and whole runs of
equal bins are filled in one step. The outcome is a bounded table of runs,
applied to the pieces as a map over their rank within their length.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flagtide.llm.common import slices, written

SEPARATOR_ID = 0
PIECE_TYPE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of the byte-level vocabulary ``byte_bpe_50k``.

    The ids are those of ``tokenizers`` with ``byte_bpe_50k.json``; the same
    ranks run through ``tiktoken`` where that is known to agree (several times
    faster). Texts that spell a special token, and texts ``tiktoken`` refuses
    (extremely long white space), go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def reference(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    @classmethod
    def public(cls) -> "Encoder":
        import public_tokenizers as P

        return cls(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except BaseException as e:  # noqa: BLE001  the regex engine gives up by a Rust panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, dtype="<u4")


def piece_bounds(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: only one
    longer than the window is cut, and only its first piece may be shorter."""
    if n <= window:
        return [(0, n)]
    first = n % window
    starts = ([0] if first else []) + list(range(first, n, window))
    return [(s, (starts + [n])[i + 1] - s) for i, s in enumerate(starts)]


def tokenize(docs: DataFrame, window: int = 2048, with_ids: bool = False, id_col: str = "doc_id",
             text_col: str = "text", make_encoder=Encoder.public) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the
    ``ids`` themselves on demand). Every document ends in the separator id, so
    null and empty texts give one piece of length 1."""
    schema = PIECE_TYPE + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make_encoder()  # for this task only
        tail = np.array([SEPARATOR_ID], dtype="<u4")
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([enc.ids(text), tail]) if text else tail
                for k, (start, length) in enumerate(piece_bounds(len(ids), window)):
                    part = ids[start:start + length]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        out["ids"].append(part.astype(np.int64))
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                      *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..window: which hold bins."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.full = bytearray(2 * self.size)

    def put(self, capacity: int, present: bool) -> None:
        i = capacity + self.size
        self.full[i] = present
        while i > 1:
            i >>= 1
            self.full[i] = self.full[2 * i] | self.full[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity >= ``least`` that holds a bin, or -1."""
        i = least + self.size
        if self.full[i]:
            return least
        while i > 1:
            if not i & 1 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Runs:
    """Where pieces go: pieces ``first`` .. of one length fill consecutive
    bins from ``bin``, ``each`` to a bin, from position ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int


def best_fit_decreasing(histogram: dict[int, int], window: int) -> Runs:
    """Best-fit decreasing over a histogram of lengths (1 .. ``window``).

    Pieces are placed longest first, each into the open bin with the least
    room that still takes it. Bins with equal room form stacks of runs
    ``[first bin, number of bins]``; a run of ``m`` bins takes
    ``m * (room // length)`` pieces in one step, which is where one by one
    placement would put them: a bin that just took a piece and has room for
    another is the tightest there is.
    """
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    tree, rows, bins = CapacityTree(window), [], 0

    def push(room: int, run: tuple[int, int]) -> None:
        stacks[room].append(run)
        tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:  # no open bin takes it: a run of new ones
                room, per = window, window // length
                run = (bins, -(-left // per))
                bins += run[1]
            else:
                run, per = stacks[room].pop(), room // length
                if not stacks[room]:
                    tree.put(room, False)
            start, m = run
            whole = min(m, left // per)
            rest = min(left - whole * per, per - 1) if whole < m else 0
            if whole:
                rows.append((length, rank, start, per, window - room))
                push(room - per * length, (start, whole))
                rank, left = rank + whole * per, left - whole * per
            if rest:
                rows.append((length, rank, start + whole, rest, window - room))
                push(room - rest * length, (start + whole, 1))
                rank, left = rank + rest, left - rest
            used = whole + bool(rest)
            if used < m:
                push(room, (start + used, m - used))
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return Runs(*(table[:, i] for i in range(5)), bins)


def ranked(pieces: DataFrame, largest: int) -> DataFrame:
    """Numbers the pieces of each length from 0 (column ``rank``). A length
    that very many pieces share is dealt over hash buckets, which are counted
    first, so no window holds more than a bounded share of it."""
    buckets = max(64, largest // 20_000)
    b = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = b.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return (b.withColumn("nth", F.row_number().over(local)).join(counts, ["length", "bucket"])
            .withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "before", "nth"))


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces.

    ``pieces`` needs doc_id, piece and length (1 .. window); further columns
    stay. The table is read twice, so it should be a written one. Rows that
    repeat a document's id are pieces of their own. Empty tables give no rows.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # <= window rows
    runs = best_fit_decreasing(histogram, window)
    order = np.lexsort((runs.first, runs.length))
    length, first, bin_, each, offset = (a[order] for a in (runs.length, runs.first, runs.bin, runs.each, runs.offset))
    # rows of a length lie together, ordered by the first rank they cover
    bounds = np.searchsorted(length, np.arange(window + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(size), dtype=np.int64)
            for v in np.unique(size):
                rows = size == v
                lo, hi = bounds[v], bounds[v + 1]
                at[rows] = lo + np.searchsorted(first[lo:hi], rank[rows], side="right") - 1
            nth = rank - first[at]
            sequence, place_ = bin_[at] + nth // each[at], offset[at] + nth % each[at] * size
            keep = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(place_)],
                                             [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "rank")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "sequence_id bigint", "offset bigint"])
    table = ranked(pieces.select(*(f.name for f in kept)), max(histogram.values(), default=0))
    return table.select(*(f.name for f in kept), "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, window: int = 2048, with_ids: bool = False, id_col: str = "doc_id",
                   text_col: str = "text", make_encoder=Encoder.public) -> DataFrame:
    """Tokenises and packs: one row per piece, see ``tokenize`` and ``pack``.

    Null and empty texts are one piece of one token, a very long text is cut into
    as many pieces as it needs; a null id stays null; of rows that repeat an id
    each is a document; an empty table gives no rows; other columns are not
    looked at.
    """
    return pack(written(tokenize(docs, window, with_ids, id_col, text_col, make_encoder)), window)
