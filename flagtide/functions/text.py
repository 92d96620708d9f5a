"""Native Column helpers (JVM side, inside whole-stage codegen).

Every function takes and returns ``Column``s so Catalyst can fold, push down
and fuse them; none of them calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
# Python's str.strip() white space: ASCII space/controls, the separators
# U+001C..U+001F, NEL, NBSP and the Unicode space separators.
WS_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
FLAG_NAME_REGEX = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+\z"
REPO_NAME_REGEX = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z"
SNIPPET_MARKER = "\n... [snippet truncated]"
MAX_SNIPPET_CHARS = 2000
CONTEXT_LINES = 2
MAX_OUTPUT_CHARS = 50000
BRANCH_PREFIX = "remediation/remove-"
MAX_FLAG_SLUG = 80
#: Paths that pass every check of ``normalize_path`` unchanged (by far not all of them).
PLAIN_PATH_REGEX = r"^(?:\.?[A-Za-z0-9_-][A-Za-z0-9_.-]*+/)*+\.?[A-Za-z0-9_-][A-Za-z0-9_.-]*\.[pP][yY]\z"
LINE_BREAK_REGEX = r"\r\n|\r|\n"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: Spark ``trim`` only removes spaces."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+\\z", "")


def rstrip_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"{WS_CLASS}+\\z", "")


def is_blank(col) -> Column:
    return strip_ws(col) == F.lit("")


def is_flag_name(col) -> Column:
    """Upper-case words joined by at least one underscore (``DEBUG`` is not)."""
    return _c(col).rlike(FLAG_NAME_REGEX)


def repo_name_ok(col) -> Column:
    return _c(col).rlike(REPO_NAME_REGEX)


def content_hash(col) -> Column:
    """Hex SHA-256 of the bytes."""
    return F.sha2(_c(col), 256)


def truncate_snippet(col, limit: int = MAX_SNIPPET_CHARS) -> Column:
    """Cut a snippet to ``limit`` characters, the marker included in the budget."""
    s = _c(col)
    keep = max(0, limit - len(SNIPPET_MARKER))
    return F.when(F.length(s) <= limit, s).otherwise(
        F.concat(rstrip_ws(F.substring(s, 1, keep)), F.lit(SNIPPET_MARKER)))


def truncate_output(col, limit: int = MAX_OUTPUT_CHARS) -> Column:
    """Cut long tool output; the marker names how many characters were cut."""
    s = _c(col)
    cut = F.length(s) - F.lit(limit)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(
        rstrip_ws(F.substring(s, 1, limit)), F.lit("\n... [truncated "),
        cut.cast("string"), F.lit(" character(s)]")))


def split_lines(col) -> Column:
    """Lines of a text, breaking on CRLF, CR and LF (a final break ends the
    last line rather than starting an empty one)."""
    s = _c(col)
    body = F.regexp_replace(s, f"({LINE_BREAK_REGEX})\\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK_REGEX, -1))


def guard_snippet(lines, start, end, context: int = CONTEXT_LINES,
                  limit: int = MAX_SNIPPET_CHARS) -> Column:
    """Lines ``start-context .. end+context`` clamped to the file, each as
    ``'%4d: %s'``, joined by LF, then cut to ``limit`` characters."""
    lines, start, end = _c(lines), _c(start), _c(end)
    lo = F.greatest(F.lit(1), start - context)
    hi = F.least(F.size(lines), end + context)
    picked = F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0)))
    def numbered(x, i):
        n = (lo + i).cast("string")
        return F.concat(F.when(lo + i < 1000, F.lpad(n, 4, " ")).otherwise(n), F.lit(": "), x)

    # an array of one, so that the text is joined once although its length and the text are read
    whole = F.array(F.array_join(F.transform(picked, numbered), "\n"))
    return F.get(F.transform(whole, lambda s: truncate_snippet(s, limit)), F.lit(0))


def _any_part(parts: Column, pred) -> Column:
    return F.exists(parts, pred)


def normalize_path(col, model: bool = False) -> Column:
    """Repository-relative POSIX path check -> ``struct(path, error_code)``.

    strip, ``\\`` -> ``/``; rejects empty, NUL (file paths only), absolute or
    drive paths, empty/``.``/``..`` parts and non-Python names. ``model=True``
    is the variant used for proposed paths (``.py`` as a whole name allowed).
    """
    plain = _c(col).rlike(PLAIN_PATH_REGEX)
    p = F.regexp_replace(strip_ws(col), r"\\", "/")
    parts = F.split(p, "/", -1)
    last = F.element_at(parts, -1)
    if model:
        py_ok = F.lower(p).endswith(".py")
    else:
        py_ok = last.rlike(r"^.+\.[pP][yY]\z")
    checks = [(p == "", "empty")]
    if not model:
        checks.append((F.instr(p, "\u0000") > 0, "nul_byte"))
    checks += [
        (p.startswith("/") | p.rlike(r"^[A-Za-z]:"), "not_relative"),
        (_any_part(parts, lambda x: x.isin("", ".", "..")), "unsafe_part"),
        (~py_ok, "not_python"),
    ]
    err = F.lit(None).cast("string")
    for cond, code in reversed(checks):
        err = F.when(cond, F.lit(code)).otherwise(err)
    # most paths are canonical as they are: one expression tells, and all checks are spared
    return F.struct(F.when(plain, _c(col)).otherwise(F.when(err.isNull(), p)).alias("path"),
                    F.when(~F.coalesce(plain, F.lit(False)), err).alias("error_code"))


def branch_name(col) -> Column:
    """``remediation/remove-<slug>``; null when the slug is empty."""
    short = is_flag_name(col) & (F.length(_c(col)) <= MAX_FLAG_SLUG)  # most names: nothing to strip or cut
    slug = F.regexp_replace(F.lower(strip_ws(col)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+\\z", "")
    slug = F.regexp_replace(F.substring(slug, 1, MAX_FLAG_SLUG), "-+\\z", "")
    return F.when(short, F.concat(F.lit(BRANCH_PREFIX), F.translate(F.lower(_c(col)), "_", "-"))).when(
        slug != "", F.concat(F.lit(BRANCH_PREFIX), slug))


def run_timed_out(error_class, error_message) -> Column:
    return (F.coalesce(F.lower(_c(error_class)).contains("timeout"), F.lit(False))
            | F.coalesce(F.lower(_c(error_message)).contains("timed out"), F.lit(False)))
