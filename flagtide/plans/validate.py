"""Proposed clean-up plans checked against the facts, as joins.

A plan is a JSON payload per (repo_id, attempt). It is parsed with a closed
schema (extra keys and non-boolean ``final_state`` are violations), then every
target is checked with equi-joins against the candidate table, the path
allowlist and the evidence sources. All violations are kept; the reference's
first-error verdict is ``first_violation`` over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flagtide.functions import text as tx

# ---------------------------------------------------------------------------
# Fixed values (plan schema limits and rule order).
MAX_TARGETS = 100
FLAG_NAME_CHARS = (1, 200)
FILES_PER_TARGET = (1, 200)
EVIDENCE_PER_TARGET = (1, 20)
QUOTE_CHARS = (1, 500)
EXPLANATION_CHARS = (1, 1000)
EVIDENCE_SOURCES = ("business_context", "repository")
PLAN_KEYS = ("targets",)
TARGET_KEYS = ("flag_name", "final_state", "files_affected", "evidence")
EVIDENCE_KEYS = ("source", "quote", "explanation")
# Semantic checks, in the order the reference applies them to each target.
RULE_RANK = {
    "schema": 0,
    "unknown_flag": 1,
    "bad_path": 2,
    "duplicate_path": 3,
    "hallucinated_path": 4,
    "unrelated_path": 5,
    "omitted_path": 6,
    "ungrounded_evidence": 7,
}
# ---------------------------------------------------------------------------

PLAN_KEY = ["repo_id", "attempt"]
TARGET_KEY = ["repo_id", "attempt", "ordinal"]


def _keys_of(variant_col) -> F.Column:
    """Top-level keys of a variant object (empty when it is not an object)."""
    as_map = F.try_variant_get(variant_col, "$", "map<string,variant>")
    return F.coalesce(F.map_keys(as_map), F.array().cast("array<string>"))


def _field(variant_col, name: str) -> F.Column:
    """A field as a variant; null where the value is no object or lacks it."""
    return F.try_variant_get(variant_col, f"$.{name}", "variant")


def _text(variant_col) -> F.Column:
    """The string in a variant; null for every other JSON type."""
    return F.when(F.schema_of_variant(variant_col) == "STRING", F.try_variant_get(variant_col, "$", "string"))


def _stripped(variant_col) -> F.Column:
    return tx.strip_ws(_text(variant_col))


def parse_plans(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plans, targets)`` from ``plan_attempts(repo_id, attempt, status, error, payload)``.

    No payload can fail the job: a field of the wrong JSON type is null, and its
    rule reports it. plans: one row per attempt with ``has_payload``, ``parsed``
    (payload is a JSON object), ``n_targets`` (-1: no list) and ``extra_keys``.
    targets: one row per target with its ordinal and fields, stripped as all
    later joins need them; lengths before the strip are kept for the rules
    (``flag_chars``, and ``quote_chars`` / ``explanation_chars`` per evidence item).
    """
    plans = attempts.select(*PLAN_KEY, "status", "error", "payload", F.try_parse_json("payload").alias("v")).select(
        *PLAN_KEY, "status", "error", F.col("payload").isNotNull().alias("has_payload"),
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("parsed"),
        F.try_variant_get(_field(F.col("v"), "targets"), "$", "array<variant>").alias("t_arr"),
        F.array_except(_keys_of(F.col("v")), F.array(*[F.lit(k) for k in PLAN_KEYS])).alias("extra_keys"),
    )
    t = F.col("t")
    targets = plans.select(*PLAN_KEY, F.posexplode("t_arr").alias("ordinal", "t")).select(
        *PLAN_KEY, (F.col("ordinal") + 1).alias("ordinal"),
        _stripped(_field(t, "flag_name")).alias("flag_name"),
        F.length(_text(_field(t, "flag_name"))).alias("flag_chars"),
        F.schema_of_variant(_field(t, "final_state")).alias("final_state_type"),
        F.when(F.schema_of_variant(_field(t, "final_state")) == "BOOLEAN",
               F.try_variant_get(t, "$.final_state", "boolean")).alias("final_state"),
        F.transform(F.try_variant_get(_field(t, "files_affected"), "$", "array<variant>"), _stripped).alias("files_affected"),
        F.array_except(_keys_of(t), F.array(*[F.lit(k) for k in TARGET_KEYS])).alias("extra_keys"),
        F.transform(F.try_variant_get(_field(t, "evidence"), "$", "array<variant>"), lambda e: F.struct(
            _text(_field(e, "source")).alias("source"),
            _stripped(_field(e, "quote")).alias("quote"), F.length(_text(_field(e, "quote"))).alias("quote_chars"),
            _stripped(_field(e, "explanation")).alias("explanation"),
            F.length(_text(_field(e, "explanation"))).alias("explanation_chars"),
            F.array_except(_keys_of(e), F.array(*[F.lit(k) for k in EVIDENCE_KEYS])).alias("extra_keys"))).alias("evidence"),
    )
    return plans.select(*PLAN_KEY, "status", "error", "has_payload", "parsed",
                        F.coalesce(F.size("t_arr"), F.lit(-1)).alias("n_targets"), "extra_keys"), targets


VIOLATION_TYPE = "struct<ordinal:int,rule_rank:int,ev_ordinal:int,rule:string,message:string>"


def _violation(ordinal, rule: str, message, ev_ordinal=None) -> F.Column:
    return F.struct(
        (ordinal if isinstance(ordinal, F.Column) else F.lit(ordinal)).cast("int").alias("ordinal"),
        F.lit(RULE_RANK[rule]).alias("rule_rank"),
        (F.lit(0) if ev_ordinal is None else ev_ordinal).cast("int").alias("ev_ordinal"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
    )


def _true_ones(conds: list[tuple[F.Column, F.Column]]) -> F.Column:
    """The violations whose condition holds, as an array."""
    return F.filter(F.array(*[F.when(c, m) for c, m in conds]), lambda x: x.isNotNull())


def _rows(df: DataFrame, found: F.Column) -> DataFrame:
    """Rows ``keys + (ordinal, rule_rank, ev_ordinal, rule, message)``."""
    return df.select(*PLAN_KEY, F.explode(found).alias("v")).select(*PLAN_KEY, "v.*")


def _outside(length, bounds: tuple[int, int]) -> F.Column:
    return length.isNull() | (length < bounds[0]) | (length > bounds[1])


def _evidence_found() -> F.Column:
    """Schema violations of a target's evidence items, by ``ev_ordinal``."""
    def of(e, i):
        conds = [
            (~F.coalesce(e["source"].isin(*EVIDENCE_SOURCES), F.lit(False)),
             F.lit("evidence source must be business_context or repository")),
            (_outside(e["quote_chars"], QUOTE_CHARS), F.lit("quote must have 1..500 characters")),
            (_outside(e["explanation_chars"], EXPLANATION_CHARS), F.lit("explanation must have 1..1000 characters")),
            ((e["quote"] == "") & (e["quote_chars"] > 0), F.lit("quote cannot be blank")),
            ((e["explanation"] == "") & (e["explanation_chars"] > 0), F.lit("explanation cannot be blank")),
            (F.size(e["extra_keys"]) > 0, F.concat(F.lit("extra evidence fields: "), F.array_join(e["extra_keys"], ","))),
        ]
        return _true_ones([(c, _violation(F.col("ordinal"), "schema", m, i + 1)) for c, m in conds])

    return F.flatten(F.transform("evidence", of))


def _target_found() -> F.Column:
    """Schema violations of a target's own fields."""
    files, ev = F.col("files_affected"), F.col("evidence")
    named = F.filter(files, lambda p: p.isNotNull())
    conds = [
        (_outside(F.col("flag_chars"), FLAG_NAME_CHARS), F.lit("flag_name must have 1..200 characters")),
        ((F.col("flag_name") == "") & (F.col("flag_chars") > 0), F.lit("flag_name cannot be blank")),
        (F.coalesce(F.col("final_state_type"), F.lit("")) != "BOOLEAN", F.lit("final_state must be a boolean")),
        (_outside(F.size(files), FILES_PER_TARGET), F.lit("files_affected must have 1..200 items")),
        (F.exists(files, lambda p: p.isNull()), F.lit("files_affected must hold strings")),
        (F.exists(named, lambda p: p == ""), F.lit("files_affected cannot contain blank paths")),
        (F.size(F.array_distinct(named)) != F.size(named), F.lit("files_affected contains duplicates")),
        (_outside(F.size(ev), EVIDENCE_PER_TARGET), F.lit("evidence must have 1..20 items")),
        (~F.coalesce(F.exists(ev, lambda e: F.coalesce(e["source"] == "business_context", F.lit(False))), F.lit(False)),
         F.lit("at least one business_context evidence item is required")),
        (F.size("extra_keys") > 0, F.concat(F.lit("extra target fields: "), F.array_join("extra_keys", ","))),
    ]
    return _true_ones([(c, _violation(F.col("ordinal"), "schema", m)) for c, m in conds])


def evidence_rules(targets: DataFrame) -> DataFrame:
    """Per evidence item: source in the enum, quote 1..500 and explanation
    1..1000 characters (strings, counted before the strip), not blank after it,
    no extra keys."""
    return _rows(targets, _evidence_found())


def target_rules(targets: DataFrame) -> DataFrame:
    """flag a string of 1..200 chars and not blank; ``final_state`` a JSON boolean;
    files a list of 1..200 strings, none blank, no duplicates after strip;
    evidence 1..20 with at least one business_context item; no extra keys."""
    return _rows(targets, _target_found())


def plan_rules(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """Payload is an object; at most 100 targets; no duplicate flag; no extra keys.
    An empty target list is valid."""
    dup = (targets.where(F.col("flag_name").isNotNull()).groupBy(*PLAN_KEY, "flag_name").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1).groupBy(*PLAN_KEY).agg(F.lit(True).alias("dup_flag")))
    p = plans.join(dup, PLAN_KEY, "left")
    conds = [
        (~F.col("parsed"), F.lit("payload is not a JSON object")),
        (F.col("parsed") & (F.col("n_targets") < 0), F.lit("targets must be a list")),
        (F.col("n_targets") > MAX_TARGETS, F.lit("at most 100 targets")),
        (F.coalesce(F.col("dup_flag"), F.lit(False)), F.lit("duplicate target flag")),
        (F.size("extra_keys") > 0, F.concat(F.lit("extra plan fields: "), F.array_join("extra_keys", ","))),
    ]
    return _rows(p, _true_ones([(c, _violation(F.lit(0), "schema", m)) for c, m in conds]))


def target_files(targets: DataFrame) -> DataFrame:
    """One row per proposed path with its normalised form (model-path rules)."""
    t = targets.select(*TARGET_KEY, "flag_name", F.posexplode("files_affected").alias("file_ordinal", "raw_path"))
    norm = tx.normalize_path(F.col("raw_path"), model=True)
    return t.select("*", norm["path"].alias("path"), norm["error_code"].alias("error_code"))


def join_unknown_flags(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Targets whose flag is not a candidate of that repo (left anti join)."""
    return targets.join(candidates.select("repo_id", "flag_name"), ["repo_id", "flag_name"], "left_anti")


def bad_paths(files: DataFrame) -> DataFrame:
    return files.where(F.col("error_code").isNotNull())


def dup_paths(files: DataFrame) -> DataFrame:
    """Paths proposed more than once for one target after normalisation."""
    return (files.where(F.col("path").isNotNull()).groupBy(*TARGET_KEY, "path")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def join_hallucinated_paths(files: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Proposed paths that are not in the repo's allowlist."""
    return files.where(F.col("path").isNotNull()).join(
        allowlist.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def candidate_file_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select("repo_id", "flag_name", F.explode("files").alias("path"))


def join_unrelated_paths(files: DataFrame, allowlist: DataFrame, candidates: DataFrame) -> DataFrame:
    """Allowlisted proposed paths that do not contain the target's flag."""
    allowed = files.where(F.col("path").isNotNull()).join(
        allowlist.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return allowed.join(candidate_file_rows(candidates), ["repo_id", "flag_name", "path"], "left_anti")


def join_omitted_paths(targets: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate files of a target's flag that the target does not list."""
    proposed = files.where(F.col("path").isNotNull()).select(*TARGET_KEY, "path")
    wanted = targets.select(*TARGET_KEY, "flag_name").join(
        candidate_file_rows(candidates), ["repo_id", "flag_name"])
    return wanted.join(proposed, TARGET_KEY + ["path"], "left_anti")


def repository_context(candidates: DataFrame) -> DataFrame:
    """Per (repo, flag): the sorted snippets joined by LF (what quotes may cite)."""
    return candidates.select("repo_id", "flag_name", F.array_join(
        F.transform("occurrences", lambda o: o["snippet"]), "\n").alias("repo_text"))


def join_evidence_grounding(targets: DataFrame, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence quotes not contained in their source: the stripped business
    context of the repo, or the flag's joined snippets. Equi-join on the repo
    (and flag) key, then a containment test; never a keyless product."""
    ev = targets.select(*TARGET_KEY, "flag_name", F.posexplode("evidence").alias("ev_ordinal", "e"))
    ctx = contexts.select("repo_id", tx.strip_ws("text").alias("context"))
    j = (ev.join(ctx, "repo_id", "left")
         .join(repository_context(candidates), ["repo_id", "flag_name"], "left"))
    source = F.when(F.col("e.source") == "business_context", F.col("context")).otherwise(F.col("repo_text"))
    grounded = F.coalesce(F.instr(source, F.col("e.quote")) > 0, F.lit(False))
    return j.where(~grounded).select(*TARGET_KEY, "flag_name", (F.col("ev_ordinal") + 1).alias("ev_ordinal"),
                                     F.col("e.source").alias("source"), F.col("e.quote").alias("quote"))


def within_limits() -> F.Column:
    """Whether a target's lists are no longer than the schema allows."""
    return (F.coalesce(F.size("files_affected"), F.lit(0)) <= FILES_PER_TARGET[1]) & (
        F.coalesce(F.size("evidence"), F.lit(0)) <= EVIDENCE_PER_TARGET[1])


def repeated_values(values: F.Column) -> F.Column:
    """Values that an array holds more than once: sorted, then each compared with
    its neighbour."""
    ordered = F.array_sort(values)
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def semantic_violations(targets: DataFrame, candidates: DataFrame, allowlist: DataFrame,
                        contexts: DataFrame) -> DataFrame:
    """All semantic violations in one pass over the targets."""
    return _checked(targets, candidates, allowlist, contexts, schema=False)


def _checked(targets: DataFrame, candidates: DataFrame, allowlist: DataFrame, contexts: DataFrame,
             schema: bool) -> DataFrame:
    """All violations of the targets in one pass (with ``schema``, those of the
    target and evidence rules as well).

    A target's candidate (its file set and snippets, both bounded by the
    occurrence limit) and its repository's context are joined once; unknown
    flags, bad, repeated and omitted paths and ungrounded quotes follow from
    the row. The schema's limits come first: a target with longer lists has
    violated them, and its lists are not looked at further. Only proposed paths
    that are not the candidate's are exploded and looked up in the allowlist.
    """
    known = candidates.select("repo_id", "flag_name", F.col("files").alias("wanted"), F.array_join(
        F.transform("occurrences", lambda o: o["snippet"]), "\n").alias("repo_text"))
    ctx = contexts.select("repo_id", tx.strip_ws("text").alias("context"))
    none = F.array().cast("array<string>")
    nothing = F.array().cast(f"array<{VIOLATION_TYPE}>")
    by_schema = [_target_found(), _evidence_found()] if schema else []
    t = targets.select(
        *PLAN_KEY, "ordinal", "flag_name", F.flatten(F.array(nothing, *(F.coalesce(f, nothing) for f in by_schema))).alias("by_schema"),
        F.when(within_limits(), F.transform(F.filter(F.coalesce("files_affected", none), lambda p: p.isNotNull()), lambda p: F.struct(
            p.alias("raw"), tx.normalize_path(p, model=True).alias("n")))).alias("proposed"),
        F.when(within_limits(), F.transform("evidence", lambda e: F.struct(e["source"].alias("source"), e["quote"].alias("quote")))).alias("cited"))
    t = t.join(known, ["repo_id", "flag_name"], "left").join(ctx, "repo_id", "left")
    t = t.withColumn("paths", F.transform(F.filter("proposed", lambda p: p["n"]["path"].isNotNull()), lambda p: p["n"]["path"]))
    n = F.col("ordinal")
    said = lambda rule, text, value: _violation(n, rule, F.concat(F.lit(text), value))
    cited = F.transform("cited", lambda e, i: F.struct(e.alias("e"), (i + 1).alias("at")))
    source = lambda e: F.when(e["source"] == "business_context", F.col("context")).otherwise(F.col("repo_text"))
    found = F.flatten(F.filter(F.array(
        F.col("by_schema"),
        F.when(F.col("wanted").isNull() & F.col("flag_name").isNotNull(),
               F.array(said("unknown_flag", "unknown flag: ", F.col("flag_name")))),
        F.transform(F.filter("proposed", lambda p: p["n"]["error_code"].isNotNull()), lambda p: said(
            "bad_path", "unsafe path (", F.concat(p["n"]["error_code"], F.lit("): "), p["raw"]))),
        F.transform(repeated_values(F.col("paths")), lambda p: said("duplicate_path", "duplicate path: ", p)),
        F.when(F.col("paths").isNotNull(), F.transform(F.array_except(F.coalesce("wanted", none), "paths"),
                                                       lambda p: said("omitted_path", "omitted file: ", p))),
        F.transform(F.filter(cited, lambda c: ~F.coalesce(F.instr(source(c["e"]), c["e"]["quote"]) > 0, F.lit(False))),
                    lambda c: _violation(n, "ungrounded_evidence", F.concat(
                        F.lit("ungrounded "), F.coalesce(c["e"]["source"], F.lit("?")), F.lit(" quote: "),
                        F.coalesce(c["e"]["quote"], F.lit(""))), c["at"]))), lambda some: some.isNotNull()))
    others = F.array_except(F.array_distinct("paths"), F.coalesce("wanted", none))
    # one row per violation, and one per path that the allowlist decides on
    rows = t.select("repo_id", "attempt", "ordinal", F.explode(F.concat(
        F.transform(found, lambda v: F.struct(v.alias("v"), F.lit(None).cast("string").alias("path"))),
        F.transform(F.coalesce(others, none), lambda p: F.struct(
            F.lit(None).cast(VIOLATION_TYPE).alias("v"), p.alias("path"))))).alias("x")).select(
        *PLAN_KEY, "ordinal", "x.*")
    allowed = allowlist.select("repo_id", "path", F.lit(True).alias("allowed")).distinct()
    looked_up = rows.where(F.col("path").isNotNull()).join(allowed, ["repo_id", "path"], "left").select(*PLAN_KEY, F.when(
        F.col("allowed").isNull(), said("hallucinated_path", "path outside allowlist: ", F.col("path"))).otherwise(
        said("unrelated_path", "file without the flag: ", F.col("path"))).alias("v"))
    return rows.where(F.col("path").isNull()).select(*PLAN_KEY, "v.*").unionByName(looked_up.select(*PLAN_KEY, "v.*"))


def all_violations(plans: DataFrame, targets: DataFrame, candidates: DataFrame,
                   allowlist: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every violation: plan rules, and all rules of the targets in one pass."""
    return plan_rules(plans, targets).unionByName(_checked(targets, candidates, allowlist, contexts, schema=True))


def first_violation(violations: DataFrame) -> DataFrame:
    """The reference's single verdict: any schema violation first, then by
    target ordinal, rule order and evidence ordinal (message breaks ties)."""
    order = F.struct(
        (F.col("rule") != "schema").cast("int"), "ordinal", "rule_rank", "ev_ordinal", "message")
    return violations.groupBy(*PLAN_KEY).agg(
        F.min_by(F.struct("ordinal", "rule", "message"), order).alias("first"),
        F.count(F.lit(1)).alias("n_violations")).select(
        *PLAN_KEY, F.col("first.ordinal").alias("ordinal"), F.col("first.rule").alias("rule"),
        F.col("first.message").alias("message"), "n_violations")


def resolve_attempts(attempts: DataFrame, key: str, order_cols: list[str], outcome_col: str,
                     error_col: str | None = None, max_attempts: int = 2) -> DataFrame:
    """First success per key over ordered attempts, with the order columns of the
    attempt that decided (an attempt's own number, not its rank).

    ``outcome_col`` is ``valid`` (stop, use it), ``invalid`` (try the next one)
    or ``fatal`` (stop at once, no retry). Only the first ``max_attempts``
    attempts count; none valid or fatal -> ``exhausted`` with the last error.

    The window only finds each key's first ``max_attempts`` rows (Spark cuts the
    groups to them before the shuffle); what decides is one aggregate that can
    be merged: the least attempt among those that stop, else the greatest.
    """
    order = F.struct(*order_cols)
    err = F.col(error_col) if error_col else F.lit(None).cast("string")
    first = (attempts.select(key, order.alias("at"), F.col(outcome_col).alias("o"), err.alias("e"))
             .withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at")))
             .where(F.col("n") <= max_attempts))
    it = F.struct("n", "at", "o", "e")
    g = first.groupBy(key).agg(F.min_by(it, F.when(F.col("o").isin("valid", "fatal"), F.col("n"))).alias("stop"),
                               F.max_by(it, "n").alias("last"))
    used = F.coalesce("stop", "last")
    resolution = (F.when(F.col("stop").isNull(), F.lit("exhausted"))
                  .when(F.col("stop.o") == "valid", F.lit("accepted")).otherwise(F.lit("fatal")))
    return g.select(
        key, resolution.alias("resolution"), used["n"].cast("int").alias("attempts_used"),
        *(used["at"][c].alias(f"used_{c}") for c in order_cols),
        F.when(resolution != "accepted", used["e"]).alias("error"))
