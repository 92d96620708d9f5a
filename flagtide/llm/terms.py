"""Words of texts and blocks of query items, shared by the operators that look
for benchmark items in documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Text of the items that go to the tasks at once.
BLOCK_BYTES = 2 << 20

# Word bytes are 0-9, a-z and all of 128 and above; A-Z are lower-cased, the rest
# parts words. A character outside ASCII is word bytes only, so bytes will do.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a megabyte of it at a time."""
    folded = data.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if at + _PIECE >= len(folded) else folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def numbered(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as their numbers, -1 for any other."""
    parts = [np.fromiter(map(known.get, w, repeat(-1)), np.int32, len(w)) for w in words(data)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """(id, bytes) of all different items, in blocks of some ``block_bytes`` of
    text, however many items there are. Rows that repeat id and text count once."""
    rows = items.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("data")).dropDuplicates()
    size = rows.agg(F.sum(F.octet_length("data") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "data"), F.lit(max(1, blocks))))
    for b in range(blocks):
        yield [(r["id"], bytes(r["data"])) for r in dealt.where(F.col("block") == b).collect()]
