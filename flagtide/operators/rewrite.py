"""The rewrite job: (repo, flag, state, path) targets x source files.

Each target row is rewritten from the *original* bytes of its file (targets
never see each other's edits). Python runs only inside Arrow batches of the
text column; joins, decoding, hashing and status roll-ups are native.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagtide.operators.guards import decode_source, encode_source
from flagtide.operators.keys import may_be_among
from flagtide.session import materialize

_TEXTS = T.ArrayType(T.StringType())
REWRITE_TYPE = T.StructType([T.StructField(c, _TEXTS) for c in ("status", "updated", "error")])
#: Flags of one file that are rewritten in one row; each has a text as long as the file.
FLAGS_AT_ONCE = 64
#: Tasks of the rewrite per core: enough that a slow one does not hold up the rest.
SHARES_PER_CORE = 4


@F.arrow_udf(REWRITE_TYPE)
def _rewrite(texts: pa.Array, flags: pa.Array, states: pa.Array, scopes: pa.Array) -> pa.Array:
    from flagtide.functions.pysource import quiet, rewrite_each

    # one flat column per result, cut into rows by offsets
    ends, flat = [0], []
    with quiet():
        for text, names, finals, scope in zip(*(a.to_pylist() for a in (texts, flags, states, scopes))):
            asked = [(n, bool(s)) for n, s in zip(names, finals) if n is not None]
            done = iter(rewrite_each(text, asked, scope) if text is not None else [])
            flat += [next(done, (None, None, None)) if n is not None else (None, None, None) for n in names]
            ends.append(len(flat))
    offsets = pa.array(ends, pa.int32())
    columns = zip(*flat) if flat else [()] * 3
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, pa.string())) for c in columns],
                                      names=["status", "updated", "error"])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _used_names(texts: pa.Array) -> pa.Array:
    from flagtide.functions.pysource import _parse, quiet, used_names

    out = []
    with quiet():
        for text in texts.to_pylist():
            try:
                out.append(sorted(used_names(_parse(text))) if text is not None else None)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.append(None)
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _diff(originals: pa.Array, updated: pa.Array, paths: pa.Array) -> pa.Array:
    from flagtide.functions.pysource import unified_diff_lines

    return pa.array([unified_diff_lines(o, u, p) if o is not None and u is not None else None
                     for o, u, p in zip(originals.to_pylist(), updated.to_pylist(), paths.to_pylist())],
                    pa.list_(pa.string()))


# Python steps are expensive: never let the optimizer copy them into pushed filters.
_rewrite = _rewrite.asNondeterministic()
_used_names = _used_names.asNondeterministic()
_diff = _diff.asNondeterministic()


def used_names_table(files: DataFrame) -> DataFrame:
    """``(repo_id, path, name)``: names used outside import statements."""
    d = decode_source(files).where(F.col("text").isNotNull())
    return d.select("repo_id", "path", F.explode(_used_names("text")).alias("name"))


def rewrite_files(targets: DataFrame, files: DataFrame, import_scope: str = "all") -> DataFrame:
    """One row per (repo, flag, path) target file.

    ``targets``: ``repo_id, flag_name, final_state, path``;
    ``files``: ``repo_id, path, content``.
    Targets are gathered per file first, so a body is joined, decoded and parsed
    once for all flags that name it (``FLAGS_AT_ONCE`` of them to a row); each
    flag is resolved on the original text.
    Out: status ``mutated``/``unchanged``/``failed``, error, updated text and
    bytes, and both SHA-256 hashes. ``import_scope``: ``all`` (drop every
    unused import of a changed file) or ``new`` (only those the change made
    unused).
    """
    # Bodies are joined to the targets from the files' side: only files that a
    # target names are kept, and a small target table is broadcast so that no other
    # body is shuffled; missing files are found by key alone. The named ones are then
    # dealt to Python in shares of equal number, however few bytes or input splits
    # hold them: a short file costs a parse all the same.
    wanted = targets.select("repo_id", "flag_name", "final_state", "path")
    asked = wanted.groupBy("repo_id", "path").agg(F.collect_list(F.struct("flag_name", "final_state")).alias("all"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / FLAGS_AT_ONCE).cast("int")),
                       lambda i: F.slice("all", i * FLAGS_AT_ONCE + 1, FLAGS_AT_ONCE))
    asked = asked.select("repo_id", "path", F.explode(rows).alias("asked"))
    missing = asked.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select(
        "repo_id", "path", F.inline("asked"))
    named = files.select("repo_id", "path", "content").join(asked, ["repo_id", "path"])
    shares = SHARES_PER_CORE * max(2, targets.sparkSession.sparkContext.defaultParallelism)
    d = decode_source(named.repartition(shares, "repo_id", "path"))
    d = d.withColumn("r", F.when(F.col("text").isNotNull(), _rewrite(
        F.col("text"), F.transform("asked", lambda a: a["flag_name"]), F.transform("asked", lambda a: a["final_state"]),
        F.lit(import_scope))))
    each = F.transform("asked", lambda a, i: F.struct(
        a["flag_name"].alias("flag_name"), a["final_state"].alias("final_state"),
        *(F.get(F.col(f"r.{c}"), i).alias(c) for c in ("status", "updated", "error"))))
    found = d.select("repo_id", "path", "had_bom", "text", F.col("content").isNotNull().alias("there"), "decode_error",
                     F.explode(each).alias("x")).select("*", "x.*").drop("x")
    gone = missing.select("*", F.lit(False).alias("had_bom"), F.lit(False).alias("there"),
                          *(F.lit(None).cast("string").alias(c) for c in ("text", "decode_error", "status", "updated", "error")))
    d = found.unionByName(gone)
    status = F.when(~F.col("there") | F.col("decode_error").isNotNull(), F.lit("failed")).otherwise(F.col("status"))
    error = (F.when(~F.col("there"), F.concat(F.lit("file not found: "), F.col("path")))
             .when(F.col("decode_error").isNotNull(), F.col("decode_error")).otherwise(F.col("error")))
    out = d.select("repo_id", "flag_name", "final_state", "path", "had_bom",
                   status.alias("status"), error.alias("error"), F.col("text").alias("original_source"),
                   F.when(status != "failed", F.col("updated")).alias("updated_source"))
    updated_bytes = F.when(F.col("updated_source").isNotNull(),
                           encode_source("updated_source", "had_bom"))
    return out.select(
        "*", updated_bytes.alias("updated_bytes"),
        F.when(F.col("status") != "failed", F.sha2(encode_source("original_source", "had_bom"), 256))
        .alias("original_sha256"),
        F.sha2(updated_bytes, 256).alias("updated_sha256"))


def file_diffs(rewritten: DataFrame) -> DataFrame:
    """Unified diff lines per mutated file (BOM stripped, 3 context lines)."""
    m = rewritten.where(F.col("status") == "mutated")
    return m.select("repo_id", "flag_name", "path",
                    _diff("original_source", "updated_source", "path").alias("diff_lines"))


def mutation_summary(rewritten: DataFrame, keys=("repo_id",)) -> DataFrame:
    """mutated / unchanged / failed file counts."""
    return rewritten.groupBy(*keys).agg(
        F.count_if(F.col("status") == "mutated").cast("bigint").alias("mutated"),
        F.count_if(F.col("status") == "unchanged").cast("bigint").alias("unchanged"),
        F.count_if(F.col("status") == "failed").cast("bigint").alias("failed"))


def gate_all_or_nothing(rows: DataFrame, keys, bad) -> DataFrame:
    """Flag every member of a group that has any bad member (one veto rolls
    back the whole group) in ``group_failed``; rows whose keys are equal, nulls
    included, are one group, and a null ``bad`` is no veto.

    Only the keys of failing groups are gathered. A bitmap of them tells the rows
    of good groups apart where they are, unshuffled; the rest meets the failing
    keys in an equi-join, which is a broadcast while these are few bytes and is
    split by adaptive execution where one group is hot.
    """
    keys = list(keys)
    failing = materialize(rows.where(bad).select(*keys).distinct())
    maybe, others = may_be_among(rows, keys, failing)
    named = failing.select(*(F.col(k).alias(f"__veto_{k}") for k in keys), F.lit(True).alias("__veto"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__veto_{k}")) for k in keys))
    met = maybe.join(named, same, "left").select(*rows.columns, F.coalesce("__veto", F.lit(False)).alias("group_failed"))
    return others.withColumn("group_failed", F.lit(False)).unionByName(met)
