"""Bitmaps of keys as run-time filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits to a key, and bits of a bitmap at least and at most (64 MB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 18, 29
_PAGE = 1 << 15  # bits of a bitmap aggregate


def may_be_among(rows: DataFrame, columns: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``columns`` may be among ``keys`` (columns of the same
    names; a written table, it is read twice), and those that are surely not.

    A bitmap of hashed keys is broadcast, ``BITS_PER_KEY`` bits to a key and never
    more than 2^``MOST_BITS`` in all. Beyond that size more rows are let through
    wrongly, and only the saving is lost: what follows must still compare keys.
    """
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * max(1, keys.count())).bit_length()))
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    pages = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _PAGE).alias("__page")).agg(
        F.bitmap_construct_agg(F.col("at") % _PAGE).alias("__map"))
    held = rows.withColumn("__at", at).withColumn("__page", F.floor(F.col("__at") / _PAGE)).join(
        F.broadcast(pages), "__page", "left")
    bit = (F.col("__at") % _PAGE).cast("int")
    byte = F.conv(F.hex(F.substring("__map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return held.where(hit).select(*rows.columns), held.where(~hit).select(*rows.columns)
