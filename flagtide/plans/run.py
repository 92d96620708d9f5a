"""The whole chain: accepted plan -> targets -> rewrite -> baseline gate ->
outcomes -> deliveries -> reports, every step a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagtide.operators import delivery as D
from flagtide.operators import outcomes as O
from flagtide.operators import report as R
from flagtide.operators import rewrite as RW
from flagtide.plans.discovery import accepted_targets
from flagtide.session import materialize


@dataclass
class Run:
    resolutions: DataFrame
    targets: DataFrame
    file_changes: DataFrame
    changed_files: DataFrame
    outcomes: DataFrame
    deliveries: DataFrame
    reports: DataFrame


def remediation_run(files: DataFrame, candidates: DataFrame, allowlist: DataFrame, contexts: DataFrame,
                    attempts: DataFrame, baseline: DataFrame, validations: DataFrame, repositories: DataFrame,
                    open_prs: DataFrame, branches: DataFrame) -> Run:
    """Runs accepted plans of all repositories at once.

    ``baseline``: repo_id, passed; ``validations``: repo_id, flag_name, passed,
    output; ``repositories``: repo_id, owner, full_name, base_override,
    default_branch. Repositories without an accepted plan, and those whose
    baseline run fails or is missing, have no outcomes. The rewrite result is
    written once; changed files, outcomes, deliveries and reports are read from it.
    ``write_outbox`` hands the changed files over.
    """
    resolutions, targets = accepted_targets(attempts, candidates, allowlist, contexts)
    good = baseline.where("passed").select("repo_id").distinct()
    targets = materialize(targets)
    changes = materialize(RW.rewrite_files(targets.join(good, "repo_id", "left_semi"), files))
    outcomes = materialize(O.target_outcomes(changes, validations, baseline=baseline))
    base, _ = D.base_branch("base_override", "default_branch")
    hosts = repositories.select("repo_id", D.owner_login("owner", "full_name").alias("owner"),
                                F.col("full_name").alias("host_repository"), base)
    deliveries = materialize(D.delivery_status(outcomes.join(hosts, "repo_id", "left"), open_prs, branches))
    summary = R.delivery_summary(deliveries).join(R.prep_summary(outcomes).select("repo_id", "failed"), "repo_id")
    plan = targets.groupBy("repo_id", "flag_name").agg(
        F.first("final_state").alias("final_state"), F.count(F.lit(1)).alias("files"))
    allowed = allowlist.groupBy("repo_id").agg(F.count("path").alias("n_allowlist"))
    discovery = plan.groupBy("repo_id").agg(F.array_sort(F.collect_list(
        F.struct("flag_name", "final_state", "files"))).alias("targets")).join(allowed, "repo_id", "left").select(
        "repo_id", F.struct("n_allowlist", "targets").alias("discovery"))
    reports = R.repo_report(R.prep_records(outcomes), summary, "delivery", deliveries=R.delivery_records(deliveries),
                            baseline=baseline, discovery=discovery,
                            repositories=hosts.withColumnRenamed("base", "base_branch"))
    return Run(resolutions, targets, changes, O.changed_files(changes, outcomes), outcomes, deliveries, reports)
