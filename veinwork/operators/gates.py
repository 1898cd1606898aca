"""Gates: several checks that end in one row, open or closed, with every reason in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.policy import reasons


def split_gates(sizes: DataFrame, spec: DataFrame, tolerance: float) -> DataFrame:
    """One row per partition of spec: requested, actual, problems (below_minimum, deviation) and the warning where the size isn't the one requested.

    sizes: partition, n_records. spec: partition, requested, minimum; partitions that sizes doesn't have count as empty. A deviation is a difference of more than
    tolerance of what was requested; a partition that nothing was requested for has none.
    """
    joined = spec.join(sizes.select("partition", F.col("n_records").alias("actual")), "partition", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    off = F.abs(F.col("actual") - F.col("requested"))
    wrong = reasons({"below_minimum": F.col("actual") < F.col("minimum"), "deviation": (F.col("requested") > 0) & (off > F.col("requested") * tolerance)})
    said = F.when(off > 0, F.format_string("%s: %d requested, whole groups gave %d", "partition", "requested", "actual"))
    return joined.select("partition", "requested", "actual", wrong.alias("problems"), said.alias("warning"))


def divided_families(split: DataFrame, family: str) -> DataFrame:
    """Families of groups that a split by smaller units has put into several partitions, with those partitions: a warning, as records of one family are alike."""
    parts = F.array_sort(F.collect_set("partition"))
    return split.groupBy(family).agg(parts.alias("partitions")).filter(F.size("partitions") > 1)


def lineage_drift(derived: DataFrame, listed: DataFrame, dataset: str, record: str, columns: Sequence[str]) -> DataFrame:
    """Per dataset how many records of its manifest differ from what is derived from its rows again: missing, unknown, or another value in a column."""
    a = derived.select(dataset, record, F.struct(*columns).alias("_derived"))
    b = listed.select(dataset, record, F.struct(*columns).alias("_listed"))
    joined = a.join(b, [dataset, record], "full").filter(~F.col("_derived").eqNullSafe(F.col("_listed")))
    return joined.groupBy(dataset).agg(F.count("*").alias("n_drifted"))


def dataset_gate(datasets: DataFrame, approvals: DataFrame, drift: DataFrame, gate: str = "dataset_promotion") -> DataFrame:
    """One row per dataset: whether it may be used, and all reasons why not.

    datasets: dataset, report_passed (null without a report), file_sha256 (null without a file), content_sha256, and the manifest's listed_file_sha256 and
    listed_content_sha256. approvals: gate, subject_sha256, approved, sequence; of those for a gate and content the first decides. drift: lineage_drift.
    """
    first = approvals.filter(F.col("gate") == gate).groupBy(F.col("subject_sha256").alias("_subject")).agg(F.min_by("approved", "sequence").alias("_approved"))
    joined = datasets.join(first, F.col("listed_content_sha256") == F.col("_subject"), "left").join(drift, "dataset", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    wrong = reasons({
        "no_report": F.col("report_passed").isNull(),
        "not_qualified": F.col("report_passed").isNotNull() & ~F.col("report_passed"),
        "no_file": F.col("file_sha256").isNull(),
        "file_changed": F.col("file_sha256").isNotNull() & differs("file_sha256", "listed_file_sha256"),
        "content_changed": differs("content_sha256", "listed_content_sha256"),
        "lineage_changed": F.coalesce("n_drifted", F.lit(0)) > 0,
        "not_approved": ~F.coalesce(F.col("_approved"), F.lit(False)),
    })
    return joined.select("dataset", (F.size(wrong) == 0).alias("qualified"), wrong.alias("reasons"))


def run_gate(runs: DataFrame, pending: DataFrame, approvals: DataFrame, run: str, now: Column) -> DataFrame:
    """One row per run: whether its results may be made: nothing is pending in its registration and an approval covers now. pending: a row (run) for each open field.
    approvals: run, approved_at, expires_at."""
    open_fields = pending.groupBy(run).agg(F.count("*").alias("_open"))
    covered = approvals.groupBy(run).agg(F.max((now >= F.col("approved_at")) & (now <= F.col("expires_at"))).alias("_covered"), F.lit(True).alias("_any"))
    joined = runs.join(open_fields, run, "left").join(covered, run, "left")
    wrong = reasons({
        "pending_fields": F.coalesce("_open", F.lit(0)) > 0,
        "no_approval": F.col("_any").isNull(),
        "approval_not_valid": F.col("_any").isNotNull() & ~F.coalesce("_covered", F.lit(False)),
    })
    return joined.select(run, F.coalesce("_open", F.lit(0)).alias("n_pending"), (F.size(wrong) == 0).alias("open"), wrong.alias("reasons"))


def overridden(requests: DataFrame, routes: DataFrame, denials: Column) -> DataFrame:
    """requests with provider (the override if there is one, else the table's), status and reasons.

    requests: workload, wanted (the override or null). routes: workload, provider. denials: the compute policy's reasons against the override, in order; one that waits for a device to be seen (attestation) doesn't bind
    before there is one. An override with a binding reason is denied and gets no provider; a workload that the table doesn't know is denied as unknown_workload, with an override too.
    """
    joined = requests.join(routes.select("workload", F.col("provider").alias("_table")), "workload", "left")
    known, asked = F.col("_table").isNotNull(), F.col("wanted").isNotNull()
    binding = F.filter(denials, lambda r: ~F.contains(r, F.lit("attestation")))
    why = F.when(~known, F.array(F.lit("unknown_workload"))).when(asked, binding).otherwise(F.array().cast("array<string>"))
    status = F.when(F.size(why) > 0, "denied").when(asked & (F.col("wanted") != F.col("_table")), "override").otherwise("default")
    provider = F.when(F.size(why) == 0, F.coalesce("wanted", "_table"))
    return joined.select(*requests.columns, provider.alias("routed"), status.alias("status"), why.alias("reasons"))


def failure_record(events: DataFrame, columns: Sequence[str], action: Column) -> DataFrame:
    """A record for each failed step: an id that is a hash of run, step and attempt, so that a failure recorded twice has one id; skill, class, severity, retryable, what was
    observed, causes, repairs tried before in the run's step, remaining budget, recommended action, artifacts.

    events: run, step, attempt, skill, failure_class, severity, retryable, observed, causes, repair (the one this attempt ended with, or null), budget, artifacts, and columns
    that the record keeps beside. A step's attempts are few.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("run", "step").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    tried = F.array_compact(F.collect_list("repair").over(before))
    identity = F.concat(F.lit("failure-"), F.substring(F.sha2(F.concat_ws("|", F.col("run").cast("string"), F.col("step").cast("string"), F.col("attempt").cast("string")), 256), 1, 12))
    kept = events.withColumn("_tried", tried).withColumn("remaining_budget", F.greatest(F.col("budget") - F.size("_tried"), F.lit(0)))
    return kept.select(*columns, identity.alias("failure_id"), "skill", "failure_class", "severity", "retryable", "observed", "causes", F.col("_tried").alias("attempted_repairs"), "remaining_budget", action.alias("recommended_action"), "artifacts")


def run_report(runs: DataFrame, steps: DataFrame, recoveries: DataFrame, claims: DataFrame) -> DataFrame:
    """run and text: a report in Markdown of its status and hashes, a table of steps, what failed and was decided, and a table of claims with what backs them.

    runs: run, completed, seed, workflow_sha256, campaign_sha256, n_events, n_artifacts (nulls are unknown). steps: run, place, step, skill, attempts, status. recoveries: run,
    place, step, decision, failure_id, repair. claims: run, claim, value, units, status, artifacts (array). A run's steps and claims are one row of text.
    """
    def lines(rows: DataFrame, order: Sequence[str], line: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
        return rows.groupBy("run").agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n").alias(name))

    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    step = lines(steps, ["place", "step"], F.format_string("| %s | %s | %d | %s |", "step", "skill", "attempts", "status"), "_steps")
    recovery = lines(recoveries, ["place", "step"], F.format_string("- %s: %s after %s, repair %s", "step", "decision", "failure_id", "repair"), "_recoveries")
    status = F.when(F.col("status") == "verified", F.col("status")).otherwise(F.concat("status", F.lit(" (not verified)")))
    claim = lines(claims, ["claim"], F.format_string("| %s | %s | %s | %s | %s |", "claim", "value", "units", status, F.array_join("artifacts", ", ")), "_claims")
    joined = runs.join(step, "run", "left").join(recovery, "run", "left").join(claim, "run", "left")
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Run "), F.col("run").cast("string")), F.lit(""),
        F.concat(F.lit("- Status: "), F.when(F.coalesce("completed", F.lit(False)), "completed").otherwise("failed or incomplete")),
        F.concat(F.lit("- Seed: "), said("seed")), F.concat(F.lit("- Workflow: "), said("workflow_sha256")), F.concat(F.lit("- Campaign: "), said("campaign_sha256")),
        F.format_string("- Events: %d, artifacts: %d", "n_events", "n_artifacts"),
    )
    body = F.concat_ws(
        "\n", head, F.lit("\n## Steps\n\n| Step | Skill | Attempts | Status |\n|-|-|-|-|"), F.col("_steps"), F.lit("\n## Failures and recovery\n"), F.coalesce("_recoveries", F.lit("- none")),
        F.lit("\n## Claims\n"), F.coalesce(F.concat(F.lit("| Claim | Value | Units | Status | Backed by |\n|-|-|-|-|-|\n"), F.col("_claims")), F.lit("- none")),
    )
    return joined.select("run", body.alias("text"))
