"""Keyless evidence grounding: which quotes occur verbatim in which texts.

A product of quotes x texts does not scale, so candidates come from equi-joins
on an *anchor* that every text containing the quote must hold as well; each
candidate pair is then confirmed with an exact ``instr`` test. What may be an
anchor depends on what the quote offers:

* any three consecutive interior words (interior words of a quote are whole words
  wherever the quote occurs),
* any interior word, where there are fewer than three,
* any stretch of ``ANCHOR_CHARS`` characters (all of them in a shorter quote) where
  it has no interior word; the texts' character n-grams are only made for the
  lengths that occur.

Texts are joined to the quotes' own n-grams once. How many texts hold an n-gram
follows from that, and each quote is anchored on its rarest one: a phrase that
stands everywhere makes no candidates, and a quote with an n-gram that stands
nowhere has none at all. Joins carry ids and anchors; quote texts come back for
the confirmation alone. Which side is broadcast, and how hot anchors are split,
is left to the optimizer's byte statistics and adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flagtide.session import materialize

WORD_SPLIT = r"[^\p{L}\p{N}_]+"
ANCHOR_WORDS = 3
ANCHOR_CHARS = 8


def _words(col) -> F.Column:
    return F.filter(F.split(col, WORD_SPLIT, -1), lambda w: w != "")


def _interior(col) -> F.Column:
    """Words strictly inside the quote (both neighbours are inside it too)."""
    tokens = F.split(col, WORD_SPLIT, -1)
    return F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda w: w != "")


def _grams(words: F.Column, n: int) -> F.Column:
    idx = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
    return F.transform(F.filter(idx, lambda i: i >= 1),
                       lambda i: F.array_join(F.slice(words, i, n), " "))


def _char_grams(text: F.Column, n: int) -> F.Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))


def quote_anchors(quotes: DataFrame, quote_id: str, quote_col: str) -> DataFrame:
    """``quote_id, kind, place, anchor``: everything a quote may be anchored on; kind is
    ``words``, ``word`` or ``chars1`` .. ``chars8``. Null and empty quotes have no
    anchor (they ground nothing)."""
    n = F.least(F.length(quote_col), F.lit(ANCHOR_CHARS))
    q = quotes.where(F.length(quote_col) > 0).select(quote_id, quote_col, _interior(F.col(quote_col)).alias("inner"))
    kind = (F.when(F.size("inner") >= ANCHOR_WORDS, F.lit("words")).when(F.size("inner") >= 1, F.lit("word"))
            .otherwise(F.concat(F.lit("chars"), n.cast("string"))))
    starts = F.sequence(F.lit(1), F.length(quote_col) - n + 1)
    anchors = (F.when(F.size("inner") >= ANCHOR_WORDS, _grams(F.col("inner"), ANCHOR_WORDS))
               .when(F.size("inner") >= 1, F.col("inner"))
               .otherwise(F.transform(starts, lambda i: F.substr(quote_col, i, n))))
    return q.select(quote_id, kind.alias("kind"), F.posexplode(anchors).alias("place", "anchor"))


def _text_anchors(texts: DataFrame, kind: str, text_id: str, text_col: str) -> DataFrame:
    """``text_id, anchor``: the texts' own anchors of one kind, each once per text."""
    if kind.startswith("chars"):
        own = _char_grams(F.col(text_col), int(kind.removeprefix("chars")))
        return texts.select(text_id, F.explode(F.array_distinct(own)).alias("anchor"))
    # the words are a column, so that they are split once and not once per n-gram
    words = texts.select(text_id, _words(F.col(text_col)).alias("_words"))
    own = _grams(F.col("_words"), ANCHOR_WORDS) if kind == "words" else F.col("_words")
    return words.select(text_id, F.explode(F.array_distinct(own)).alias("anchor"))


def candidate_pairs(quotes: DataFrame, texts: DataFrame, quote_id: str, quote_col: str,
                    text_id: str, text_col: str) -> DataFrame | None:
    """``quote_id, text_id``: every text with the rarest anchor of a quote (all pairs
    that can hold are among them); None without any quote to look for."""
    anchors = materialize(quote_anchors(quotes, quote_id, quote_col))
    kinds = sorted(r[0] for r in anchors.select("kind").distinct().collect())  # at most ten kinds
    if not kinds:
        return None
    found = []
    for kind in kinds:
        # only (text id, anchor) rows are exploded; text bodies stay in the scan
        wanted = anchors.where(F.col("kind") == kind).select("anchor").distinct()
        found.append(_text_anchors(texts, kind, text_id, text_col).join(wanted, "anchor").select(
            F.lit(kind).alias("kind"), "anchor", text_id))
    held = materialize(reduce(DataFrame.unionByName, found))
    counted = held.groupBy("kind", "anchor").agg(F.count(F.lit(1)).alias("n_texts"))
    rank = F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), "place")
    rarest = materialize(anchors.join(counted, ["kind", "anchor"], "left").groupBy(quote_id).agg(
        F.min_by(F.struct("kind", "anchor"), rank).alias("best"), F.min(F.coalesce("n_texts", F.lit(0))).alias("n_texts")).where(
        "n_texts > 0").select(quote_id, "best.*"))
    return held.join(rarest, ["kind", "anchor"]).select(quote_id, text_id)


def quotes_in_texts(quotes: DataFrame, texts: DataFrame, quote_id: str, quote_col: str,
                    text_id: str, text_col: str) -> DataFrame:
    """``(quote_id, text_id)`` for every quote contained in a text."""
    found = candidate_pairs(quotes, texts, quote_id, quote_col, text_id, text_col)
    if found is None:
        schema = StructType([quotes.schema[quote_id], texts.schema[text_id]])
        return quotes.sparkSession.createDataFrame([], schema)
    # candidate pairs are few: with their quotes they go to the texts
    with_quote = materialize(found.distinct().join(quotes.select(quote_id, quote_col), quote_id))
    confirmed = texts.select(text_id, text_col).join(with_quote, text_id)
    return confirmed.where(F.instr(F.col(text_col), F.col(quote_col)) > 0).select(quote_id, text_id).distinct()
