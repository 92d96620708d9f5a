"""Repeated passages through partitioned run-length suffix indexes.

A byte is removed when a string of ``length`` bytes that covers it also starts
anywhere else. The corpus is not indexed as one text: every window of
``length`` bytes is owned by one anchor, the k-mer with the smallest hash inside
it, so equal windows have equal anchors. Windows whose anchor occurs once in the
corpus are unique and go no further. Consecutive windows of one anchor form a
piece; pieces with equal bytes are collapsed, and what is left (different
contexts of one anchor) is dealt by anchor to blocks of bounded size.

Contexts of one anchor that would not fit a block are split further: windows by
how far before the anchor they start, a few ranges of that distance at a time,
and each range by the bytes that all its windows share. Equal windows fall into
the same range and share those bytes, so no match is parted; unlike contexts part
within a few levels, and a range of one window has nothing left to compare.

For each block suffixes are sorted, and the run-length Burrows-Wheeler transform
is kept with the text positions of its run heads and ends; the longest match of
every position with any other is streamed from those samples alone: between
samples a match only gets shorter by one each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from flagtide.llm.common import key_filter, slices, written

K = 24
#: Bytes of a block's text; contexts that share a key and go to one block.
BLOCK_BYTES, BLOCK_CONTEXTS = 1 << 19, 1_000
#: Ranges that a split makes of one range of distances.
FAN_OUT = 4
BUFFER = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)

_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------- anchors and spans

def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings of ``data`` (by doubling)."""
    h, power, size, parts = _TABLE[data], _BASE, 1, {}
    while size < 16:
        h, size = h[:-size] * power + h[size:], size * 2
        power = np.uint64(int(power) * int(power) & (1 << 64) - 1)
        parts[size] = (h, power)
    h8, power8 = parts[8]
    n = len(data) - K + 1
    x = h[:n] * power8 + h8[16:16 + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def owners(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` k-mers the position of its smallest hash,
    the first of equal ones (up to 2^20 positions)."""
    m = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < window:
        m = np.minimum(m[:len(m) - (window - size)], m[window - size:])
    return (m & _POSITION).astype(np.int64)


def spans(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(text number, first window, windows, place of the anchor from there, anchor
    hash, 128-bit hash of the bytes) of all windows of ``length`` bytes. Texts are worked on in buffers; a text longer
    than a buffer is cut into overlapping parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BUFFER):
            part = text[at:at + BUFFER + length - 1]
            if size + len(part) > BUFFER and held:
                yield from _buffer_spans(held, length)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield from _buffer_spans(held, length)


def _buffer_spans(held, length):
    buffer = b"".join(p for _, _, p in held)
    data = np.frombuffer(buffer, dtype=np.uint8)
    hashes = kmer_hashes(data)
    owner = owners(hashes, length - K + 1)
    lengths = np.array([len(p) for _, _, p in held])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(len(data) + 1, dtype=np.int32)  # windows that do not leave their text
    np.add.at(inside, starts[:-1], 1)
    np.add.at(inside, starts[1:] - length + 1, -1)
    valid = np.cumsum(inside[:len(owner)]) > 0
    opens = valid.copy()
    opens[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(opens)
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    last = np.flatnonzero(closes)
    which = np.searchsorted(starts, first, side="right") - 1
    anchor = hashes[owner[first]].view(np.int64)
    view = memoryview(buffer)
    digest = xxhash.xxh3_128_digest
    place = owner[first] - first
    for w, a, b, o, h in zip(which.tolist(), first.tolist(), last.tolist(), place.tolist(), anchor.tolist()):
        i, at, _ = held[w]
        yield i, at + a - int(starts[w]), b - a + 1, o, h, digest(view[a:b + length])


def _encoded(column) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


PIECE = "row bigint, twin bigint, start int, windows int, place int"
_PIECE_TYPES = [("row", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("place", pa.int32())]


def _batches(rows: list[tuple], types: list[tuple[str, pa.DataType]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), most):
        columns = zip(*rows[at:at + most])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """One row per piece of ``rows`` (row, twin, text): the document, first window,
    number of windows, place of the anchor, anchor as ``key``, digest of the bytes."""
    types = [*_PIECE_TYPES, ("key", pa.int64()), ("digest", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = list(zip(batch.column("row").to_pylist(), batch.column("twin").to_pylist()))
            yield from _batches([(*ids[i], *rest) for i, *rest in spans(_encoded(batch.column("text")), length)], types)

    return rows.mapInArrow(run, f"{PIECE}, key bigint, digest binary")


def _encoded(column) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def parts(text: bytes, start: int, windows: int, place: int, key: str, width: int,
          length: int) -> Iterator[tuple[int, int, int, str, bytes]]:
    """(first window, windows, place, key, digest) of the parts of a piece: its
    windows by ranges of ``width`` distances to the anchor. A part's key holds
    the bytes that all windows of the range have in common."""
    anchor = start + place
    for r in range(max(0, place - windows + 1) // width, place // width + 1):
        first = max(start, anchor - (r + 1) * width + 1)
        last = min(start + windows - 1, anchor - r * width)
        core = text[anchor - r * width:anchor - (r + 1) * width + 1 + length]
        yield (first, last - first + 1, anchor - first,
               xxhash.xxh3_128_hexdigest(b"%s %d %d " % (key.encode(), width, r) + core),
               xxhash.xxh3_128_digest(text[first:last + length]))


# ------------------------------------------------------- run-length suffix index

class RunLengthIndex:
    """Run-length BWT of a few texts: the heads and ends of its runs with their
    text positions and the positions of their neighbours in the sorted order.

    Texts end in a separator below all bytes; no match crosses it. The sorted
    order and the ranks it comes from are not kept.
    """

    FIRST = 7  # symbols of the first key

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(self.starts[-1])
        self.n = n
        joined = b"\0".join([*texts, b""]) + bytes(8)
        self.bytes = np.ndarray((n + 1,), dtype="<u8", buffer=joined, strides=(1,))  # eight bytes from every place
        stops = self.starts[1:] - 1
        self.to_stop = np.repeat(stops, lengths + 1) - np.arange(n)  # bytes left in the text
        symbols = np.frombuffer(joined, dtype=np.uint8)[:n].astype(np.int64) + 1
        symbols[stops] = 0
        order = self._order(symbols, int(lengths.max(initial=0)) + 1)
        before = np.where(order > 0, symbols[order - 1], 0)  # the BWT
        heads = np.ones(n, dtype=bool)  # first of a run; separators never run on
        heads[1:] = before[1:] != before[:-1]
        ends = np.ones(n, dtype=bool)
        ends[:-1] = heads[1:]
        heads[before == 0] = ends[before == 0] = True
        self.runs = int(heads.sum())
        at_head, at_end = np.flatnonzero(heads[1:]) + 1, np.flatnonzero(ends[:-1])
        #: (position, its neighbour) at run heads with the one above, at run ends with the one below
        self.samples = [(order[at_head], order[at_head - 1]), (order[at_end], order[at_end + 1])]

    def _order(self, symbols: np.ndarray, deepest: int) -> np.ndarray:
        """Positions by the suffixes that start there, to ``deepest`` symbols."""
        n = self.n
        padded = np.concatenate([symbols, np.zeros(self.FIRST, dtype=np.int64)])
        key = np.zeros(n, dtype=np.int64)
        for d in range(self.FIRST):
            key = key * 257 + padded[d:d + n]
        rank, depth = self._rank(key), self.FIRST
        while depth < deepest:
            after = np.zeros(n, dtype=np.int64)
            after[:max(0, n - depth)] = rank[depth:] + np.int64(1)
            rank, depth = self._rank(rank.astype(np.int64) * (n + 2) + after), depth * 2
        return np.argsort(rank, kind="stable")

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.ones(len(key), dtype=np.int64)
        new[:1] = 0
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(len(key), dtype=np.int32)
        rank[order] = np.cumsum(new)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, inside their texts: eight bytes
        of all pairs at a time."""
        limit = np.minimum(self.to_stop[i], self.to_stop[j])
        out = limit.copy()
        left, at = np.flatnonzero(limit > 0), 0
        while len(left):
            differ = self.bytes[i[left] + at] ^ self.bytes[j[left] + at]
            parted = np.flatnonzero(differ)
            low = differ[parted] & (~differ[parted] + np.uint64(1))  # the lowest bit that differs
            same = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            out[left[parted]] = np.minimum(limit[left[parted]], at + same)
            at += 8
            left = left[(differ == 0) & (limit[left] > at)]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of its longest match with the suffix
        at any other position, streamed from the samples at run ends: elsewhere
        it is one less than at the position before."""
        best = np.zeros(self.n, dtype=np.int64)
        for i, j in self.samples:
            np.maximum.at(best, i, self.common(i, j))
        position = np.arange(self.n)
        streamed = np.maximum.accumulate(best + position) - position
        return np.minimum(np.maximum(streamed, 0), self.to_stop)


def long_matches(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, the positions where a string of ``length`` bytes starts that
    starts anywhere else in ``texts`` as well."""
    index = RunLengthIndex(texts)
    marked = index.matching_statistics() >= length
    return [np.flatnonzero(marked[a:b - 1]) for a, b in zip(index.starts[:-1], index.starts[1:])]


def runs_of(positions: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive positions."""
    if not len(positions):
        return []
    cuts = np.flatnonzero(np.diff(positions) > 1)
    return list(zip(positions[np.concatenate([[0], cuts + 1])].tolist(),
                    positions[np.concatenate([cuts, [len(positions) - 1]])].tolist()))


# --------------------------------------------------------------------- operator

RANGE = "row bigint, twin bigint, `from` int, `to` int"
DOC = ["row", "twin"]


def _indexed(contexts: DataFrame, length: int, blocks: int) -> DataFrame:
    """Ranges of bytes of the single contexts that the block's index marks."""
    names = [("row", pa.int64()), ("twin", pa.int64()), ("from", pa.int32()), ("to", pa.int32())]

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("bytes").to_pylist()
        found = []
        for row, twin, start, n, positions in zip(*(table.column(c).to_pylist() for c in ("row", "twin", "start", "n")),
                                                  long_matches(texts, length)):
            if n == 1:
                found += [(row, twin, start + a, start + b + length) for a, b in runs_of(positions)]
        columns = zip(*found) if found else [()] * 4
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])

    return contexts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(
        run, RANGE)


def _with_text(pieces: DataFrame, rows: DataFrame, each, schema: str, types: list) -> DataFrame:
    """What ``each`` gives for the bytes of a document and every piece of it.

    Only documents that have pieces are joined; a document's pieces travel as
    one list, which is no longer than its text."""
    fields = [c for c in pieces.columns if c not in DOC]
    by_row = written(pieces.groupBy(*DOC).agg(F.collect_set(F.struct(*fields)).alias("pieces")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for row, twin, text, own in zip(b.column("row").to_pylist(), b.column("twin").to_pylist(),
                                            _encoded(b.column("text")), b.column("pieces").to_pylist()):
                for p in own:
                    out += [(row, twin, *x) for x in each(text, p)]
            yield from _batches(out, [("row", pa.int64()), ("twin", pa.int64()), *types])

    # equal rows are one document here, whatever the number of rows
    texts = key_filter(rows.select(*DOC, "text"), "row", by_row, "row").dropDuplicates(DOC).join(by_row, DOC)
    return texts.select(*DOC, "text", "pieces").mapInArrow(run, f"row bigint, twin bigint, {schema}")


def repeated_ranges(rows: DataFrame, length: int) -> DataFrame:
    """row, twin, from, to: byte ranges (they may overlap) covered by repeated strings.

    ``rows``: row and twin (together the 128-bit number of a document; rows that
    repeat id and text have equal ones, and their strings repeat) and text."""
    found = written(occurrences(rows, length))
    anchors = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    pieces = key_filter(found, "key", anchors, "key").withColumn("n", F.lit(1).cast("long"))
    width = max(1, length - K + 1)  # distances of a window to its anchor
    marked, indexed = [], []
    while True:
        pieces = written(pieces)
        variants = written(pieces.groupBy("key", "digest").agg(
            F.sum("n").alias("n"), F.min(F.struct(*DOC, "start", "windows", "place")).alias("at")))
        again = variants.where("n > 1").select("key", "digest")
        marked.append(pieces.join(again, ["key", "digest"]).select(
            *DOC, F.col("start").alias("from"), (F.col("start") + F.col("windows") + (length - 1)).alias("to")))
        mixed = written(variants.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where(
            "contexts > 1 and least = 1").select("key", "contexts"))
        wanted = variants.join(mixed, "key").select(
            *(F.col(f"at.{c}").alias(c) for c in DOC), F.col("at.start").alias("start"), F.col("at.windows").alias("windows"),
            F.col("at.place").alias("place"), F.col("key").cast("string").alias("key"), "n", "contexts")
        indexed.append(wanted.where(F.col("contexts") <= BLOCK_CONTEXTS).drop("contexts", "place"))
        if mixed.where(F.col("contexts") > BLOCK_CONTEXTS).isEmpty():
            break
        width = max(1, -(-width // FAN_OUT))  # the width 1 leaves one context to a key
        pieces = _split(wanted.where(F.col("contexts") > BLOCK_CONTEXTS).drop("contexts"), rows, width, length)

    cut = lambda text, p: [(p["start"], p["n"], p["key"], text[p["start"]:p["start"] + p["windows"] + length - 1])]
    contexts = written(_with_text(
        reduce(DataFrame.unionByName, indexed), rows, cut, "start int, n bigint, key string, bytes binary",
        [("start", pa.int32()), ("n", pa.int64()), ("key", pa.string()), ("bytes", pa.binary())]))
    size = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return reduce(DataFrame.unionByName, [*marked, _indexed(contexts, length, max(1, size // BLOCK_BYTES))])


def _split(hot: DataFrame, rows: DataFrame, width: int, length: int) -> DataFrame:
    """The parts of pieces whose key has too many contexts for one block."""
    each = lambda text, p: [(*x, p["n"]) for x in parts(
        text, p["start"], p["windows"], p["place"], p["key"], width, length)]
    return _with_text(hot, rows, each, "start int, windows int, place int, key string, digest binary, n bigint",
                      [*_PIECE_TYPES[2:], ("key", pa.string()), ("digest", pa.binary()), ("n", pa.int64())])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without bytes of characters that lie only partly in them."""
    out = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


REPORT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut_text(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   prefix: str = "") -> DataFrame:
    """``docs`` (all columns, ``text_col`` untouched) with n_bytes, n_removed,
    n_spans, kept_sha256 and ``kept_text``, the text without repeated passages.

    Texts are UTF-8 bytes, null counts as empty, matches never cross documents
    and are judged on the input. ``kept_text`` keeps characters of which only a
    part is covered, the other columns count bytes. Rows that repeat, those
    without an id too, are documents of their own, so what they have in ``length``
    bytes or more goes from all of them. A very long text is worked on in
    overlapping parts, all of it. An empty table gives no rows. Report columns
    are named with ``prefix``; input columns of these names are replaced.
    """
    report = [prefix + c.split()[0] for c in REPORT.split(", ")] + [f"{prefix}kept_text"]
    keep = [c for c in docs.columns if c not in report]
    reserved = ["__ft_row", "__ft_twin"]
    base = docs.select(*(c for c in keep if c not in reserved))
    # two hashes over differently ordered values: together the number of a document
    keyed = base.withColumns({"__ft_row": F.xxhash64(F.col(id_col), F.col(text_col)),
                              "__ft_twin": F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))})
    rows = keyed.select(F.col("__ft_row").alias("row"), F.col("__ft_twin").alias("twin"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(rows, length)
    by_row = written(ranges.groupBy(F.col("row").alias("__ft_key"), F.col("twin").alias("__ft_key2")).agg(
        F.sort_array(F.collect_set(F.struct("from", "to"))).alias("__ft_ranges")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = key_filter(keyed, "__ft_row", by_row, "__ft_key")
    missed = key_filter(keyed, "__ft_row", by_row, "__ft_key", inside=False)
    zero = F.lit(0).cast("long")
    values = [F.octet_length(text).cast("long"), zero, zero, F.sha2(text, 256), text]
    whole = missed.select(*base.columns, *(v.alias(c) for v, c in zip(values, report)))

    own = list(base.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches):
            out = []
            for data, found in zip(_encoded(batch.column("__ft_text")), batch.column("__ft_ranges").to_pylist()):
                runs = merged([(r["from"], r["to"]) for r in found or []])
                kept = _cut_text(data, runs)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                            _cut_text(data, whole_characters(data, runs)).decode()))
            columns = [batch.column(c) for c in own] + [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, [*own, *report])

    same = (F.col("__ft_row") == F.col("__ft_key")) & (F.col("__ft_twin") == F.col("__ft_key2"))
    joined = hit.join(by_row, same, "left")
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, f.dataType) for c, f in zip(
        report, T.StructType.fromDDL(f"{REPORT}, kept_text string").fields))])
    changed = joined.select(*base.columns, text.alias("__ft_text"), "__ft_ranges").mapInArrow(cut, schema)
    return whole.unionByName(changed)
