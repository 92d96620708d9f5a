"""Guard extraction and candidate grouping over a table of source files.

``source_files(repo_id, path, size, content)`` -> decoded text -> one row per
guard (``occurrences``) -> one row per (repo, flag) (``candidates``).
Only parsing runs in Python (an Arrow-batched pandas UDF over the text
column); decoding, snippets, grouping, limits and gates are native.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagtide.functions import text as tx

# Fixed values (extractor defaults).
MAX_FILE_BYTES = 512_000
MAX_OCCURRENCES_PER_FLAG = 50
IGNORED_DIRS = ("tests", "venv", ".git", "__pycache__", ".tox", "node_modules", "build", "dist")

UTF8_BOM = bytes.fromhex("EFBBBF")
KEYS = ["repo_id", "flag_name"]

GUARD_TYPE = T.StructType([
    T.StructField("guards", T.ArrayType(T.StructType([
        T.StructField("flag_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]))),
    T.StructField("error", T.StringType()),
])


_GUARD_COLUMNS = [("flag_name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32())]


@F.arrow_udf(GUARD_TYPE)
def _parse_guards(texts: pa.Array) -> pa.Array:
    from flagtide.functions.pysource import find_guards, quiet

    # flat columns and offsets: no object per guard on the way to Arrow
    ends, flat, errors = [0], [], []
    with quiet():
        for text in texts.to_pylist():
            error = None
            if text is not None:
                try:
                    flat += find_guards(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
            ends.append(len(flat))
            errors.append(error)
    fields = [pa.field(n, t) for n, t in _GUARD_COLUMNS]
    columns = zip(*flat) if flat else [()] * len(fields)
    guards = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    none = pa.array([e is not None or not there for e, there in zip(errors, texts.is_valid().to_pylist())], pa.bool_())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), guards, mask=none), pa.array(errors, pa.string())],
        names=["guards", "error"])


# Parsing is expensive: never let the optimizer copy it into a pushed filter.
_parse_guards = _parse_guards.asNondeterministic()


def prune_ignored(files: DataFrame, ignore=IGNORED_DIRS, path_col: str = "path") -> DataFrame:
    """Scanner rules on a file table: drop files under a directory whose exact
    name is ignored or starts with ``.`` (the root itself is never tested) and
    keep names ending in ``.py`` (case-sensitive). Hidden *files* stay."""
    ignore = list(ignore or IGNORED_DIRS)
    parts = F.split(F.col(path_col), "/", -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad_dir = F.exists(dirs, lambda d: d.isin(*ignore) | d.startswith("."))
    return files.where(~bad_dir & F.col(path_col).endswith(".py"))


def decode_source(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Strip one UTF-8 BOM (remembered in ``had_bom``), strict UTF-8 decode
    (``text`` null and ``decode_error`` set when invalid); line endings kept."""
    content = F.col(content_col)
    had_bom = F.coalesce(F.substring(content, 1, 3) == F.lit(UTF8_BOM), F.lit(False))
    body = F.when(had_bom, F.expr(f"substring({content_col}, 4)")).otherwise(content)
    as_str = body.cast("string")
    valid = F.is_valid_utf8(as_str)
    return files.withColumns({
        "had_bom": had_bom,
        "text": F.when(valid, as_str),
        "decode_error": F.when(~valid, F.lit("invalid UTF-8")),
    })


def encode_source(text_col, had_bom_col) -> F.Column:
    """Inverse of ``decode_source``: UTF-8 bytes, BOM re-added when it was there."""
    enc = F.encode(tx._c(text_col), "UTF-8")
    return F.when(tx._c(had_bom_col), F.concat(F.lit(UTF8_BOM), enc)).otherwise(enc)


@dataclass
class Extraction:
    """Guard rows plus per-file problems (oversize, undecodable, unparseable)."""
    occurrences: DataFrame
    errors: DataFrame


def parse_files(files: DataFrame, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Per file, in one pass: size check, decode, parse. Oversize files and
    files without content are neither decoded nor parsed (their text is null). ``text`` stays next to
    the result so snippets are cut natively without a second pass. What a folder
    source says of files and folders it could not read or list (``read_error``,
    ``list_error``, where the table has them) is the reason of their error."""
    size = F.coalesce(F.col("size"), F.length("content").cast("bigint"), F.lit(0).cast("bigint"))
    said = [F.col(c) for c in ("read_error", "list_error") if c in files.columns]
    sized = files.select("repo_id", "path", size.alias("size"), "content",
                         F.coalesce(*said, F.lit("file has no content")).alias("unread_error"))
    decoded = decode_source(sized)
    fits = F.col("size") <= max_file_bytes
    text = F.when(fits, F.col("text"))
    return decoded.select(
        "repo_id", "path", "size", text.alias("text"), F.when(F.col("content").isNull(), F.col("unread_error")).alias("unread"),
        F.when(fits, F.col("decode_error")).alias("decode_error"),
        F.when(text.isNotNull(), _parse_guards(text)).alias("parsed"))


def extract_files(files: DataFrame, context_lines: int = tx.CONTEXT_LINES,
                  max_snippet_chars: int = tx.MAX_SNIPPET_CHARS,
                  max_file_bytes: int = MAX_FILE_BYTES, telling: bool = False) -> DataFrame:
    """One row per file: its guards (with snippets cut natively from the text)
    or the stage and message of the problem (oversize, read, decode, parse).
    ``telling``: only files with guards or a problem."""
    empty = F.array().cast("array<struct<flag_name:string,kind:string,line:int,snippet:string>>")
    parsed = parse_files(files, max_file_bytes)
    if telling:  # tested on the parse itself, a filter on the result would cut all snippets twice
        parsed = parsed.where(F.col("parsed.guards").isNull() | (F.size("parsed.guards") > 0))
    # split once per file; the lambda below reads the column
    parsed = parsed.withColumn("lines", F.when(F.size("parsed.guards") > 0, tx.split_lines(F.col("text"))))
    lines = F.col("lines")
    guards = F.transform("parsed.guards", lambda g: F.struct(
        g["flag_name"].alias("flag_name"), g["kind"].alias("kind"), g["line"].alias("line"),
        tx.guard_snippet(lines, g["line"], g["end_line"], context_lines,
                         max_snippet_chars).alias("snippet")))
    oversize = F.col("size") > max_file_bytes
    stage = (F.when(oversize, F.lit("oversize"))
             .when(F.col("unread").isNotNull(), F.lit("read"))
             .when(F.col("decode_error").isNotNull(), F.lit("decode"))
             .when(F.col("parsed.error").isNotNull(), F.lit("parse")))
    error = F.when(oversize, F.format_string("file is %d bytes; limit is %d", F.col("size"),
                                             F.lit(max_file_bytes))) \
        .when(F.col("unread").isNotNull(), F.col("unread")) \
        .otherwise(F.coalesce("decode_error", "parsed.error"))
    return parsed.select(
        "repo_id", "path", F.when(stage.isNull(), guards).otherwise(empty).alias("guards"),
        stage.alias("stage"), error.alias("error"))


def extraction_of(per_file: DataFrame) -> Extraction:
    # of an inner explode Spark infers a filter on the list, for which all snippets are cut once more
    occurrences = per_file.where(F.col("stage").isNull()).select(
        "repo_id", F.col("path").alias("file_path"), F.explode_outer("guards").alias("g")).where(F.col("g").isNotNull()).select(
        "repo_id", "g.flag_name", "file_path", "g.line", "g.kind", "g.snippet")
    errors = per_file.where(F.col("stage").isNotNull()).select("repo_id", "path", "stage", "error")
    return Extraction(occurrences, errors)


def extract(files: DataFrame, context_lines: int = tx.CONTEXT_LINES,
            max_snippet_chars: int = tx.MAX_SNIPPET_CHARS,
            max_file_bytes: int = MAX_FILE_BYTES) -> Extraction:
    """``extract_guards`` + ``guard_snippet`` + ``size_guard`` as one job."""
    return extraction_of(extract_files(files, context_lines, max_snippet_chars, max_file_bytes))


def occurrence_counts(occurrences: DataFrame) -> DataFrame:
    """Occurrences per (repo, flag); partial aggregation before the shuffle."""
    return occurrences.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_occurrences"))


def occurrence_limit(occurrences: DataFrame, limit: int = MAX_OCCURRENCES_PER_FLAG) -> DataFrame:
    """(repo, flag) groups with more than ``limit`` occurrences."""
    return occurrence_counts(occurrences).where(F.col("n_occurrences") > limit)


@dataclass
class Candidates:
    """Candidate rows, and the groups left out because they exceed the limit."""
    rows: DataFrame
    over_limit: DataFrame


def group_candidates(occurrences: DataFrame, limit: int = MAX_OCCURRENCES_PER_FLAG) -> Candidates:
    """One row per (repo, flag): sorted occurrence structs and sorted files.

    Groups over ``limit`` are taken out *before* any list is built, so no task
    ever collects more than ``limit`` structs per group, whatever the skew;
    they are returned beside the candidates with their count.
    """
    over = occurrence_limit(occurrences, limit)
    rows = occurrences.join(over.select(*KEYS), KEYS, "left_anti")
    occ = F.struct("file_path", "line", "kind", "snippet")
    return Candidates(rows.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(occ)).alias("occurrences"),
        F.array_sort(F.collect_set("file_path")).alias("files"),
        F.count(F.lit(1)).alias("n_occurrences")), over)


def failed_repos(errors: DataFrame, occurrences: DataFrame | None = None,
                 limit: int = MAX_OCCURRENCES_PER_FLAG) -> DataFrame:
    """Repos whose extraction fails as a whole (any bad file or over-limit flag)."""
    bad = errors.select("repo_id")
    if occurrences is not None:
        bad = bad.unionByName(occurrence_limit(occurrences, limit).select("repo_id"))
    return bad.distinct()


def discover_candidates(files: DataFrame, limit: int = MAX_OCCURRENCES_PER_FLAG,
                        strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidates per repo plus the error table. ``strict`` applies the
    all-or-nothing rule per repo: one bad file or over-limit flag -> no
    candidates for that repo (it appears in the errors instead)."""
    from flagtide.session import materialize

    # only files with guards or problems are kept (and written) for later steps
    ex = extraction_of(materialize(extract_files(files, telling=True)))
    occ, errors = ex.occurrences, ex.errors
    grouped = group_candidates(occ, limit)
    cands = grouped.rows
    if strict:
        cands = cands.join(failed_repos(errors, occ, limit), "repo_id", "left_anti")
    over = grouped.over_limit.select(
        "repo_id", F.lit(None).cast("string").alias("path"), F.lit("occurrence_limit").alias("stage"),
        F.format_string("flag %s exceeds the occurrence limit of %d", "flag_name",
                        F.lit(limit)).alias("error"))
    return cands, errors.unionByName(over)


def path_allowlist(files: DataFrame) -> DataFrame:
    """Distinct canonical paths per repo, and the bad ones with their reason
    (``raw_path`` is set for those only): spellings of one path are one row."""
    norm = tx.normalize_path(F.col("path"))
    return files.select("repo_id", norm["path"].alias("path"), norm["error_code"].alias("error_code"),
                        F.when(norm["error_code"].isNotNull(), F.col("path")).alias("raw_path")).distinct()


def top_flags(occurrences: DataFrame, n: int = 20) -> DataFrame:
    """Flags ranked by the number of repositories and files that guard on them,
    over every file that could be read. Rows are counted per file first, so
    the distinct counts shuffle one row per (flag, repo)."""
    per_file = occurrences.groupBy("flag_name", "repo_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    per_repo = per_file.groupBy("flag_name", "repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"))
    return (per_repo.groupBy("flag_name")
            .agg(F.count(F.lit(1)).alias("n_repos"), F.sum("files").cast("bigint").alias("n_files"),
                 F.sum("n").cast("bigint").alias("n_occurrences"))
            .orderBy(F.desc("n_repos"), F.desc("n_files"), F.asc("flag_name"))
            .limit(n))
