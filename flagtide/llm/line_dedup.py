"""Line deduplication over content-defined chunks of lines.

Lines are hashed, and a rolling hash over the hashes of the last few lines
decides where a chunk ends, so inserting or deleting lines moves the
boundaries next to the change only. Chunks of at least two lines that occur
more than once in the corpus, compared byte by byte, stay at their first
occurrence (smallest document id, then position) and are removed elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flagtide.llm.common import key_filter, slices, written


@dataclass(frozen=True)
class Chunking:
    """A chunk ends after a line where the rolling hash of the last ``window``
    lines is divisible by ``divisor`` (a power of two), with ``least`` to
    ``most`` lines. Chunks meet under ``digest_bits`` bits of their digest."""

    window: int = 2
    divisor: int = 4
    least: int = 2
    most: int = 32
    digest_bits: int = 64


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def chunk_bounds(lines: list[str], c: Chunking) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks of a document."""
    drop = pow(_BASE, c.window, 1 << 64)
    out, first, rolling, held = [], 0, 0, []
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.encode())
        held.append(h)
        rolling = (rolling * _BASE + h) & _MASK
        if i >= c.window:
            rolling = (rolling - drop * held[i - c.window]) & _MASK
        n = i + 1 - first
        if n >= c.most or n >= c.least and ((rolling ^ rolling >> 29) * 0xBF58476D1CE4E5B9 & _MASK) >> 33 & c.divisor - 1 == 0:
            out.append((first, i + 1))
            first = i + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


ROW = ["row", "twin"]


def chunks(rows: DataFrame, c: Chunking) -> DataFrame:
    """row, twin, doc_id, first, last, digest: the chunks of two or more lines."""
    names = ["row", "twin", "doc_id", "first", "last", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for row, twin, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = (text or "").split("\n")
                for a, b in chunk_bounds(lines, c):
                    if b - a > 1:
                        digest = xxhash.xxh3_64_intdigest("\n".join(lines[a:b]).encode()) >> (64 - c.digest_bits)
                        out.append((row, twin, doc, a, b, digest - (1 << 63)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, "row bigint, twin bigint, doc_id bigint, first int, last int, digest bigint")


def with_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, twin, doc_id, first, last, digest, bytes of the wanted chunks."""
    by_row = written(wanted.groupBy(*ROW).agg(F.collect_set(F.struct("doc_id", "first", "last", "digest")).alias("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for row, twin, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = (text or "").split("\n")
                out += [(row, twin, p["doc_id"], p["first"], p["last"], p["digest"],
                         "\n".join(lines[p["first"]:p["last"]]).encode()) for p in parts]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)],
                                                 ["row", "twin", "doc_id", "first", "last", "digest", "bytes"])

    texts = key_filter(rows.select(*ROW, "text"), "row", by_row, "row").dropDuplicates(ROW).join(by_row, ROW)
    return texts.select(*ROW, "text", "parts").mapInArrow(
        run, "row bigint, twin bigint, doc_id bigint, first int, last int, digest bigint, bytes binary")


def repeated_chunks(rows: DataFrame, c: Chunking) -> DataFrame:
    """row, twin, first, last of the chunks to remove. ``rows``: row, twin, doc_id, text."""
    found = written(chunks(rows, c))
    again = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    same = written(with_bytes(rows, found.join(again, "digest")))
    place = F.struct("doc_id", *ROW, "first")
    firsts = same.groupBy("digest", "bytes").agg(F.min(place).alias("keep"))
    return same.join(firsts, ["digest", "bytes"]).where(place != F.col("keep")).select(*ROW, "first", "last")


def remove_repeated(docs: DataFrame, chunking: Chunking = Chunking(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, kept_text: one row per row of ``docs``.

    Lines are what lies between line feeds, so the empty (and the null) text is
    one empty line. A null id comes before all others. Rows that repeat both id
    and text are one document whose chunks are removed or kept in all of them;
    rows that repeat the text under another id lose their repeated chunks. An
    empty table gives no rows. Other columns are not looked at.
    """
    # two hashes over differently ordered values: together the 128-bit number of a document
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"),
                       F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("twin"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    by_row = written(repeated_chunks(rows, chunking).groupBy(*ROW).agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("gone")))

    @F.pandas_udf("n_removed bigint, kept_text string")
    def cut(texts, lists):
        import pandas as pd

        out = []
        for text, gone in zip(texts, lists):
            lines, kept, at = (text or "").split("\n"), [], 0
            for g in gone if gone is not None else []:
                kept += lines[at:g["first"]]
                at = g["last"]
            kept += lines[at:]
            out.append((len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_removed", "kept_text"])

    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    report = ["doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text"]
    whole = key_filter(rows, "row", by_row, "row", inside=False).select(
        "doc_id", n_lines, F.lit(0).cast("long").alias("n_removed"), text.alias("kept_text")).select(*report)
    changed = key_filter(rows, "row", by_row, "row").join(by_row, ROW, "left").select(
        "doc_id", n_lines, cut(text, "gone").alias("cut")).select("doc_id", "n_lines", "cut.*").select(*report)
    return whole.unionByName(changed)
