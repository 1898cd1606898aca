"""Graded traces: a customer is a run, an order an iteration, and each rule is broken in some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import grading
from veinwork.plans.registry import query
from veinwork.sources.tables import table

#: Rule, and which orders break it (SQL that both engines read; k is the order, c the customer). Orders that k % 3 = 0 accept, others reject an illegal change.
PLANTED = {
    "no_lesson": "k % 41 = 1", "trigger": "k % 43 = 2", "evidence": "k % 47 = 3", "reviewed": "k % 53 = 4", "late_review": "k % 59 = 5", "verdict": "k % 61 = 6",
    "policy": "k % 67 = 7", "class": "k % 71 = 8", "bounds": "k % 73 = 9", "protected": "k % 79 = 10", "proposal_sha": "k % 83 = 11", "attestation": "k % 89 = 12",
    "remote": "k % 97 = 13", "fixture": "k % 101 = 14", "evaluator": "k % 103 = 15", "source": "k % 107 = 16", "status": "k % 109 = 17", "decision": "k % 113 = 18",
    "rolled": "k % 127 = 19", "reference": "k % 131 = 20", "no_evaluation": "k % 137 = 21", "illegal": "k % 3 != 0", "changed": "k % 139 = 22",
}


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return orders.select("*", *(F.expr(rule).alias(name) for name, rule in PLANTED.items()))


def _trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, events and runs with everything planted."""
    p = _flagged(spark, sf_dir)
    text = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    pick = lambda flag, yes, no: F.when(F.col(flag), yes).otherwise(no)
    key = F.col("k").cast("string")
    proposal = text('{"proposal_id": "', key, '", "remote": ', pick("remote", "true", "false"), ', "mutations": [{"key": "', pick("class", "seed", "lr"), '", "value": ', pick("bounds", "9", "0.5"), "}]}")
    review = text('{"proposal_id": "', pick("reviewed", "other", key), '", "trigger": "', pick("trigger", "noon", "before_change"), '", "evidence_class": "', pick("evidence", "metric", "agent_text"), '"}')
    legality = text('{"proposal_id": "', pick("verdict", "other", key), '", "policy_sha256": "', pick("policy", "old", "p1"), '", "legal": ', pick("illegal", "false", "true"), "}")
    mutation = text('{"changes": ["lr"', pick("protected", ', "cutoff"', ""), "]}")
    execution = text('{"succeeded": true, "proposal_sha256": "', pick("proposal_sha", "x", F.sha2(proposal, 256)), '", "compute_attestation": "', pick("attestation", "cluster", "local-cpu"), '"}')
    evaluation = text('{"evaluator": "', pick("evaluator", "someone", "judge"), '", "source_sha256": "', pick("source", "ctl", "ev"), '", "scientific_status": "', pick("status", "publication", "non_scientific"), '", "legality_sha256": "', F.sha2(legality, 256), '", "metrics": {"mae": 0.5, "force": 1.0}}')
    decision = text('{"decision": "', F.when(F.col("decision"), "escalate").when(F.col("illegal"), "reject").when(F.col("no_evaluation"), "escalate").otherwise("reject"), '"}')
    lesson = text('{"evidence": ["run:proposal", "run:', pick("reference", "nowhere", "decision"), '"]}')
    fixture = text('{"uses_frozen_test_data": ', pick("fixture", "true", "false"), ', "uses_hidden_labels": false, "uses_protected_partitions": false, "uses_acquisition_pool_labels": false}')
    legal, always = ~F.col("illegal"), F.lit(True)
    kinds = {
        "proposal": (always, proposal), "review": (always, review), "legality": (always, legality), "decision": (always, decision), "lesson": (~F.col("no_lesson"), lesson), "fixture": (legal, fixture),
        "mutation": (legal | F.col("changed"), mutation), "execution": (legal, execution), "evaluation": (legal & ~F.col("no_evaluation"), evaluation), "rollback": ((legal | F.col("changed")) & ~F.col("rolled"), F.lit("{}")),
    }
    made = F.array_compact(F.array(*(F.when(there, F.struct(F.lit(k).alias("kind"), v.alias("payload"))) for k, (there, v) in kinds.items())))
    records = p.select(F.col("c").alias("run"), F.col("k").alias("iteration"), F.explode(made).alias("r")).select("run", "iteration", "r.*")
    steps = F.array(F.struct(pick("late_review", 9, 1).alias("sequence"), F.lit("review").alias("step")), F.struct(F.lit(5).alias("sequence"), F.lit("execution").alias("step")))
    events = p.select(F.col("c").alias("run"), F.col("k").alias("iteration"), F.explode(steps).alias("e")).select("run", "iteration", "e.*")
    bounds = F.expr("map('lr', named_struct('class', 'optimization', 'low', 0.1D, 'high', 1D), 'seed', named_struct('class', 'owner_gated', 'low', 0D, 'high', 10D))")
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run"), F.lit("judge").alias("evaluator"), F.lit("ctl").alias("controller_sha256"), F.lit("p1").alias("policy_sha256"), F.lit(False).alias("remote"), F.lit(0).alias("remote_jobs"),
        F.array(F.lit("optimization")).alias("classes"), F.array(F.lit("cutoff")).alias("protected"), bounds.alias("bounds"), F.lit("mae").alias("metric"), F.expr("map('mae', 0.5D)").alias("baseline"),
    )
    return records, events, runs


FOUND = f"""
    WITH p AS (SELECT *, {", ".join(f"{rule} AS {name}" for name, rule in PLANTED.items())} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
    m AS (SELECT c AS run, k AS iteration, 'missing_artifact' AS "check", 'missing: lesson' AS detail FROM p WHERE no_lesson),
    g AS (SELECT * FROM p WHERE NOT no_lesson),
    v AS (SELECT * FROM m
        UNION ALL SELECT c, k, 'review', 'not a declared boundary: noon' FROM g WHERE "trigger" UNION ALL SELECT c, k, 'review', 'a review is no evidence' FROM g WHERE evidence
        UNION ALL SELECT c, k, 'review', 'it reviewed another proposal' FROM g WHERE reviewed UNION ALL SELECT c, k, 'review', 'not once and before the execution' FROM g WHERE late_review
        UNION ALL SELECT c, k, 'legality', 'the verdict is on another proposal' FROM g WHERE verdict UNION ALL SELECT c, k, 'legality', 'checked against another policy' FROM g WHERE policy
        UNION ALL SELECT c, k, 'legality', 'changed although not legal' FROM g WHERE illegal AND changed UNION ALL SELECT c, k, 'mutation_bounds', 'class not allowed: seed' FROM g WHERE NOT illegal AND class
        UNION ALL SELECT c, k, 'mutation_bounds', 'out of bounds: lr' FROM g WHERE NOT illegal AND bounds AND NOT class
        UNION ALL SELECT c, k, 'immutable_preservation', 'protected key changed: cutoff' FROM g WHERE (NOT illegal OR changed) AND protected
        UNION ALL SELECT c, k, 'lineage', 'missing: evaluation' FROM g WHERE NOT illegal AND no_evaluation UNION ALL SELECT c, k, 'lineage', 'executed another proposal' FROM g WHERE NOT illegal AND proposal_sha
        UNION ALL SELECT c, k, 'remote_execution', 'not authorised: cluster' FROM g WHERE NOT illegal AND attestation UNION ALL SELECT c, k, 'remote_execution', 'no remote budget' FROM g WHERE NOT illegal AND remote
        UNION ALL SELECT c, k, 'protected_data', 'not denied: uses_frozen_test_data' FROM g WHERE NOT illegal AND fixture
        UNION ALL SELECT c, k, 'evaluator_independence', 'evaluated by someone' FROM g WHERE NOT illegal AND NOT no_evaluation AND evaluator
        UNION ALL SELECT c, k, 'evaluator_independence', 'the evaluator is the controller' FROM g WHERE NOT illegal AND NOT no_evaluation AND source
        UNION ALL SELECT c, k, 'unsupported_claims', 'claims status publication' FROM g WHERE NOT illegal AND NOT no_evaluation AND status
        UNION ALL SELECT c, k, 'decision_consistency', 'recorded escalate, derived reject' FROM g WHERE decision AND (illegal OR NOT no_evaluation)
        UNION ALL SELECT c, k, 'rollback', 'a change that wasn''t accepted stays' FROM g WHERE (NOT illegal OR changed) AND rolled
        UNION ALL SELECT c, k, 'lesson_evidence', 'no such record: nowhere' FROM g WHERE reference)
"""


def _violations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, events, runs = _trace(spark, sf_dir)
    return grading.violations(records, events, runs, ["before_change"], 0.05, {"force": 2.0}), records, runs


@query(f"{FOUND} SELECT * FROM v")
def trace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of every run: reviews, legality, bounds, protected keys, chain, remote work, fixtures, evaluators, claims, decisions, rollbacks and evidence."""
    return _violations(spark, sf_dir)[0]


@query(
    f"""{FOUND}, n AS (SELECT run, "check", count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT run, sum(n)::BIGINT AS n_violations, string_agg("check" || '=' || n, ',' ORDER BY "check" || '=' || n) AS checks FROM n GROUP BY 1),
    i AS (SELECT o_custkey AS run, count(*) AS n_iterations FROM orders GROUP BY 1)
    SELECT c_custkey AS run, coalesce(n_violations, 0) = 0 AS passed, coalesce(n_iterations, 0) AS n_iterations, coalesce(n_violations, 0) AS n_violations, coalesce(checks, '') AS checks
    FROM customer LEFT JOIN i ON i.run = c_custkey LEFT JOIN b ON b.run = c_custkey"""
)
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each run, with how often it broke each check."""
    found, records, runs = _violations(spark, sf_dir)
    return grading.report(found, runs, records)


@query(
    """WITH r AS (SELECT c_custkey AS run, c_custkey % 4 = 0 AS remote, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'publication' WHEN c_custkey % 4 = 0 THEN 'infrastructure_only' ELSE 'non_scientific' END AS status,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'all is well' WHEN c_custkey % 4 = 0 THEN 'an infrastructure_only run' ELSE 'a non_scientific run' END AS report FROM customer)
    SELECT run, 'unsupported_claims' AS "check", 'completion' AS location FROM r WHERE status = 'publication' UNION ALL SELECT run, 'missing_artifact', 'report' FROM r WHERE status IS NOT NULL AND report IS NULL
    UNION ALL SELECT run, 'unsupported_claims', 'report' FROM r WHERE status IS NOT NULL AND report = 'all is well'"""
)
def completion_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that claim another status at their end than they may, or whose report is missing or doesn't say it."""
    k = F.col("c_custkey")
    word = F.when(k % 4 == 0, "infrastructure_only").otherwise("non_scientific")
    runs = table(spark, sf_dir, "customer").select(
        k.alias("run"), (k % 4 == 0).alias("remote"), F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "publication").otherwise(word).alias("status"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "all is well").when(k % 4 == 0, "an infrastructure_only run").otherwise("a non_scientific run").alias("report"),
    )
    return grading.completion_honesty(runs)
