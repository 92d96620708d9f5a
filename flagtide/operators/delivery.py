"""Hand-off of prepared targets: branch names, reuse of open requests, branch
conflicts, delivery status and request text. Nothing here calls a host; the
result is an outbox table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagtide.functions import text as tx
from flagtide.operators.outcomes import NOT_PREPARED_TEXT

# Fixed values (request text).
TITLE_PREFIX = "Remove deprecated feature flag: "
COMMIT_PREFIX = "chore: remove deprecated feature flag "
# Error texts.
NO_OWNER = "DeliveryError: the repository names no owner"
NO_BASE = "ValueError: no usable base branch"
NO_SLUG = "ValueError: the flag name leaves nothing for a branch name"
NO_FILES = "PipelineError: a prepared target without changed files"


def base_branch(override, default_branch) -> list[Column]:
    """``[base, error]``: the stripped override when given (even if blank),
    else the stripped default; blank is an error."""
    b = tx.strip_ws(F.coalesce(tx._c(override), tx._c(default_branch)))
    return [F.when(b != "", b).alias("base"),
            F.when(b == "", F.lit("no usable base branch")).alias("error")]


def owner_login(owner, full_name) -> Column:
    """Owner login, else the part of ``owner/name`` before the slash."""
    before = F.substring_index(tx._c(full_name), "/", 1)
    return F.coalesce(F.when(tx.strip_ws(owner) != "", tx.strip_ws(owner)),
                      F.when(F.instr(tx._c(full_name), "/") > 1, before))


def join_open_pr(targets: DataFrame, open_prs: DataFrame) -> DataFrame:
    """Attach the first open request with the same base and ``owner:branch``
    head (first = lowest number). ``targets`` needs ``repo_id, base, head``."""
    first = open_prs.groupBy("repo_id", "base", "head").agg(
        F.min_by(F.struct("url", "number", "head_sha"), "number").alias("pr"))
    return targets.join(first, ["repo_id", "base", "head"], "left")


def join_branch_conflict(targets: DataFrame, branches: DataFrame) -> DataFrame:
    """``branch_exists`` and its tip for each target's branch."""
    b = branches.select("repo_id", F.col("branch").alias("branch_name"), F.col("sha").alias("branch_sha"))
    return targets.join(b, ["repo_id", "branch_name"], "left").withColumn(
        "branch_exists", F.col("branch_sha").isNotNull())


def delivery_status(outcomes: DataFrame, open_prs: DataFrame, branches: DataFrame,
                    owner_col: str = "owner") -> DataFrame:
    """Per target: ``not_prepared`` (its error or a default text), ``failed``
    (no owner, bad base, empty slug, branch exists without an open request, or no
    changed files), ``reused`` (an open request exists) or ``ready`` (new
    work for the outbox). Prepared flags of one repository whose names give
    the same branch (``A_B`` and ``A__B``) all fail rather than share a branch.
    One failure never blocks other targets."""
    # files are counted first: who does not read them does not shuffle them
    t = outcomes.withColumns({"branch_name": tx.branch_name("flag_name"), "n_files": F.coalesce(F.size("files"), F.lit(0))})
    t = t.withColumn("head", F.concat(F.col(owner_col), F.lit(":"), F.col("branch_name")))
    t = join_branch_conflict(join_open_pr(t, open_prs), branches)
    # two flags of one repository with the same slug would share a branch; the
    # window holds the flags of one branch name
    same_branch = Window.partitionBy("repo_id", "branch_name")
    t = t.withColumn("n_same_branch", F.count_if(F.col("status") == "prepared").over(same_branch))
    prepared = F.col("status") == "prepared"
    n_files = F.col("n_files")
    status = (F.when(~prepared, F.lit("not_prepared"))
              .when(F.col(owner_col).isNull(), F.lit("failed"))
              .when(F.col("base").isNull(), F.lit("failed"))
              .when(F.col("branch_name").isNull(), F.lit("failed"))
              .when(n_files == 0, F.lit("failed"))
              .when(F.col("n_same_branch") > 1, F.lit("failed"))
              .when(F.col("pr.url").isNotNull(), F.lit("reused"))
              .when(F.col("branch_exists"), F.lit("failed"))
              .otherwise(F.lit("ready")))
    error = (F.when(~prepared, F.coalesce(F.col("error"), F.lit(NOT_PREPARED_TEXT)))
             .when(F.col(owner_col).isNull(), F.lit(NO_OWNER))
             .when(F.col("base").isNull(), F.lit(NO_BASE))
             .when(F.col("branch_name").isNull(), F.lit(NO_SLUG))
             .when(n_files == 0, F.lit(NO_FILES))
             .when(F.col("n_same_branch") > 1, F.concat(
                 F.lit("SlugCollision: another flag of this repository maps to branch '"),
                 F.col("branch_name"), F.lit("'")))
             .when(F.col("pr.url").isNull() & F.col("branch_exists"), F.concat(
                 F.lit("DeliveryConflictError: no open request for the existing branch '"), F.col("branch_name"),
                 F.lit("'"))))
    commit = F.when(status == "reused", F.coalesce(F.col("pr.head_sha"), F.col("branch_sha")))
    return t.select(*(c for c in t.columns if c != "n_files"), status.alias("delivery_status"), error.alias("delivery_error"),
                    F.col("pr.url").alias("pr_url"), F.col("pr.number").alias("pr_number"),
                    commit.alias("commit_sha"))


def pr_text(flag_col, paths_col) -> list[Column]:
    """``[title, commit_message, body]`` with sorted file bullets."""
    flag = tx.strip_ws(flag_col)
    bullets = F.array_join(F.transform(F.array_sort(tx._c(paths_col)),
                                       lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n")
    body = F.concat(F.lit("Automated removal of a retired feature flag.\n\nDeprecated feature flag: `"), flag,
                    F.lit("`\n\nChanged files:\n"), bullets,
                    F.lit("\n\nThe change was produced by a deterministic source rewrite and must still be "
                          "reviewed by a maintainer before merging."))
    return [F.concat(F.lit(TITLE_PREFIX), flag).alias("title"),
            F.concat(F.lit(COMMIT_PREFIX), flag).alias("commit_message"),
            body.alias("body")]
