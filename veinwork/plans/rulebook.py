"""Rules of the experiment loop over the tables, each with violations of every rule planted by arithmetic on the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import scalars
from veinwork.operators import rules
from veinwork.operators.clearance import inside_folder
from veinwork.operators.events import latest_before
from veinwork.plans.registry import query
from veinwork.sources.tables import table


def _pick(values: tuple, place: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({place} + 1 as int)"))


def _values(rows: list[tuple]) -> str:
    """For SQL."""
    text = lambda x: "NULL" if x is None else str(list(x)) if isinstance(x, tuple) else repr(x) if isinstance(x, str) else str(x).lower()
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)


KEYS = ("learning_rate", "batch_size", "patience", "optimizer", "model_path", "seed", "gradient_clip", "unknown_key")
RULES = [("learning_rate", "optimization", 1, 40), ("batch_size", "optimization", 1, 30), ("patience", "schedule", 0, 50), ("optimizer", "architecture", 0, 50), ("model_path", "immutable", None, None), ("seed", "owner_gated", None, None), ("gradient_clip", "optimization", 0, 50)]
CONFIG = [("learning_rate", 10), ("batch_size", 8), ("patience", 5), ("optimizer", 1)]


@query(
    f"""WITH policy(name, class, low, high) AS (VALUES {_values(RULES)}), current(name, value) AS (VALUES {_values(CONFIG)}),
    c AS (SELECT p_brand || p_type AS proposal, p_partkey AS position, {list(KEYS)}[p_partkey % 8 + 1] AS name, p_size AS new_value FROM part),
    j AS (SELECT c.*, class, p.low AS l, p.high AS h, p.low AS low, CASE WHEN new_value % 10 = 3 THEN p.high + 1 ELSE p.high END AS high, v.value AS now, CASE WHEN position % 9 = 4 THEN v.value + 1 ELSE v.value END AS old_value,
          row_number() OVER (PARTITION BY proposal, c.name ORDER BY position) AS k FROM c LEFT JOIN policy p ON c.name = p.name LEFT JOIN current v ON c.name = v.name),
    r AS (SELECT *, CASE WHEN coalesce(class, 'immutable') = 'immutable' THEN 'immutable' WHEN class = 'owner_gated' THEN 'owner_gated' WHEN class NOT IN ('optimization', 'schedule') THEN 'class_not_permitted'
          WHEN l IS NOT NULL AND (low IS DISTINCT FROM l OR high IS DISTINCT FROM h) THEN 'range_mismatch' WHEN l IS NOT NULL AND new_value NOT BETWEEN l AND h THEN 'out_of_bounds'
          WHEN now IS NULL THEN 'absent_key' WHEN old_value IS DISTINCT FROM now THEN 'stale_old_value' END AS violation FROM j)
    SELECT proposal, position, name, 'duplicate' AS violation FROM r WHERE k > 1 UNION ALL SELECT proposal, position, name, violation FROM r WHERE violation IS NOT NULL"""
)
def change_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame(RULES, "name string, class string, low int, high int")
    current = spark.createDataFrame(CONFIG, "name string, value int")
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("proposal"), F.col("p_partkey").alias("position"), _pick(KEYS, "p_partkey % 8").alias("name"), F.col("p_size").alias("new_value"))
    asked = rows.join(policy.select("name", "low", "high"), "name", "left").join(current.withColumnRenamed("value", "now"), "name", "left")
    asked = asked.withColumn("high", F.when(F.col("new_value") % 10 == 3, F.col("high") + 1).otherwise(F.col("high"))).withColumn("old_value", F.when(F.col("position") % 9 == 4, F.col("now") + 1).otherwise(F.col("now")))
    return rules.change_violations(asked.drop("now"), policy, current, ["optimization", "schedule"])


PROVIDERS = [("local", True, ("none", "l4"), 1, False, True, None, False), ("colab", True, ("l4", "a100"), 1, False, False, 120, True), ("vessl", True, ("a100",), 2, True, True, 600, True), ("retired", False, ("l4",), 1, False, False, 60, False)]
ASKED = ("local", "colab", "vessl", "retired", "nowhere")
WORK = ("unit_test", "development_training", "primary_training", "active_learning", "production_research")
REPORTED = ("NVIDIA L4", " nvidia  A100 ", "Z9")
PROVIDERS_DDL = "provider string, enabled boolean, accelerators array<string>, max_gpus int, full_campaigns boolean, long_training boolean, max_minutes int, attested boolean"


@query(
    f"""WITH providers(provider, enabled, accelerators, max_gpus, full_campaigns, long_training, max_minutes, attested) AS (VALUES {_values(PROVIDERS)}),
    q AS (SELECT o_orderkey AS request_id, {list(ASKED)}[o_orderkey % 5 + 1] AS provider, ['none', 'l4', 'a100'][o_custkey % 3 + 1] AS accelerator, o_orderkey % 3 + 1 AS n_gpus, {list(WORK)}[(o_orderkey + o_custkey) % 5 + 1] AS workload,
          o_custkey % 300 AS minutes, ['l4', 'a100', NULL, NULL][o_custkey % 4 + 1] AS canonical, o_custkey % 4 < 3 AS seen FROM orders),
    d AS (SELECT q.*, enabled, concat_ws(',', CASE WHEN enabled IS NULL THEN 'unknown_provider' END, CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN NOT coalesce(list_contains(accelerators, accelerator), false) THEN 'accelerator' END,
        CASE WHEN n_gpus > max_gpus THEN 'too_many_gpus' END, CASE WHEN workload IN {rules.FULL_CAMPAIGNS} AND q.provider != 'vessl' AND NOT coalesce(full_campaigns, false) THEN 'full_campaign' END,
        CASE WHEN workload = 'development_training' AND q.provider = 'colab' AND NOT coalesce(long_training, false) AND (max_minutes IS NULL OR minutes > max_minutes) THEN 'unbounded_training' END,
        CASE WHEN NOT seen AND coalesce(attested, true) THEN 'no_attestation' END, CASE WHEN seen AND canonical IS NULL THEN 'unrecognized' END,
        CASE WHEN seen AND canonical IS NOT NULL AND NOT coalesce(list_contains(accelerators, canonical), false) THEN 'observed_not_listed' END, CASE WHEN seen AND canonical != accelerator THEN 'observed_differs' END) AS denials
        FROM q LEFT JOIN providers p ON q.provider = p.provider)
    SELECT request_id, denials, denials = '' AS allowed FROM d"""
)
def compute_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    observed = F.when(F.col("o_custkey") % 4 < 3, _pick((*REPORTED, ""), "o_custkey % 4"))
    asked = o.select(
        F.col("o_orderkey").alias("request_id"), _pick(ASKED, "o_orderkey % 5").alias("provider"), _pick(("none", "l4", "a100"), "o_custkey % 3").alias("accelerator"), (F.col("o_orderkey") % 3 + 1).alias("n_gpus"),
        _pick(WORK, "(o_orderkey + o_custkey) % 5").alias("workload"), (F.col("o_custkey") % 300).alias("minutes"), observed.alias("observed"),
    ).withColumn("canonical", scalars.normalised_name("observed", {"nvidia l4": "l4", "nvidia a100": "a100"}))
    got = rules.compute_denials(asked, spark.createDataFrame([(p, e, list(a), *r) for p, e, a, *r in PROVIDERS], PROVIDERS_DDL), "vessl")
    return got.select("request_id", F.array_join("denials", ",").alias("denials"), "allowed")


# Where kinds of work go.
ROUTES = [("unit_test", "local"), ("gpu_smoke_test", "colab"), ("preflight", "colab"), ("failure_reproduction", "colab"), ("development_training", "colab"), ("primary_training", "vessl"), ("active_learning", "vessl"), ("benchmark", "vessl"), ("production_research", "vessl")]


@query(
    f"""WITH routes(workload, provider) AS (VALUES {_values(ROUTES)}),
    q AS (SELECT o_orderkey AS request_id, {[w for w, _ in ROUTES]}[o_orderkey % 9 + 1] AS workload, CASE WHEN o_custkey % 10 = 0 THEN 'vessl' END AS wanted, o_custkey % 50 AS k, o_orderdate AS t, CASE WHEN o_custkey % 7 = 0 THEN 'lead' END AS approved_by FROM orders WHERE o_orderstatus != 'F'),
    f AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, o_orderdate AS t FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 20 = 0),
    r AS (SELECT q.*, coalesce(wanted, provider) AS to_provider, wanted IS NOT NULL AND wanted != provider AS override FROM q JOIN routes USING (workload)),
    m AS (SELECT r.*, (SELECT max(f.t) FROM f WHERE f.k = r.k AND f.t <= r.t) AS newest FROM r)
    SELECT request_id, to_provider AS provider, override, CASE WHEN NOT (to_provider = 'vessl' AND workload IN {rules.FULL_CAMPAIGNS}) THEN 'open'
        WHEN newest IS NOT NULL AND epoch_us(t) - epoch_us(newest) <= 240 * 3600000000 THEN 'valid' WHEN approved_by IS NOT NULL THEN 'emergency' ELSE 'denied' END AS gate FROM m"""
)
def preflight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders stand for passing preflights, the others for requests; a tenth ask for a provider themselves."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    asked = o.filter("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("request_id"), _pick(tuple(w for w, _ in ROUTES), "o_orderkey % 9").alias("workload"), F.when(F.col("o_custkey") % 10 == 0, "vessl").alias("wanted"), "k", F.col("o_orderdate").alias("at"), F.when(F.col("o_custkey") % 7 == 0, "lead").alias("approved_by"))
    passing = o.filter("o_orderstatus = 'F' AND o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("run_id"), "k", F.col("o_orderdate").alias("created"))
    routed = rules.routed(asked, spark.createDataFrame(ROUTES, "workload string, provider string"), "local")
    met = latest_before(routed, passing, ["k"], "at", "created", "run_id", within_hours=240)
    return met.select("request_id", "provider", "override", rules.preflight_gate(F.col("provider"), F.col("workload"), F.col("matched_id"), F.col("approved_by"), "vessl").alias("gate"))


RAW = """(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'AIMD-NVT' WHEN 1 THEN 'Vacancy' WHEN 2 THEN 'Elastic' WHEN 3 THEN 'Surface' WHEN 4 THEN 'Molten' ELSE 'AIMD-NVT' END AS grp,
    CASE p_size % 6 WHEN 0 THEN 'Snapshot ' || p_partkey % 40 || ' of 40 of AIMD NVT simulation at ' || p_size * 100 || ' K' WHEN 1 THEN 'Snapshot ' || (p_partkey % 20 + 1) || ' of 20 of Vacancy AIMD NVT simulation at ' || p_size || ' K'
    WHEN 2 THEN CASE WHEN p_partkey % 9 = 0 THEN 'ground state' ELSE 'Elastic mode ' || p_partkey % 6 || ', strain -0.0' || p_size END WHEN 3 THEN CASE WHEN p_partkey % 9 = 0 THEN 'slab' ELSE 'Cu_mp-30_(1_' || p_size % 2 || '_0) slab' END ELSE 'snapshot of something' END AS description FROM part)"""


@query(
    f"""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'aimd_nvt_' || p_size * 100 || 'k' WHEN 1 THEN 'vacancy_' || p_size || 'k' WHEN 2 THEN CASE WHEN p_partkey % 9 = 0 THEN 'elastic_ground_state' ELSE 'elastic_mode_' || p_partkey % 6 END
        WHEN 3 THEN CASE WHEN p_partkey % 9 != 0 THEN 'surface_1_' || p_size % 2 || '_0' END END AS group_id,
    CASE p_size % 6 WHEN 0 THEN 'aimd_nvt_' || p_size * 100 || 'k_block' || (p_partkey % 40) // 10 WHEN 1 THEN 'vacancy_' || p_size || 'k_block' || (p_partkey % 20) // 5 WHEN 2 THEN CASE WHEN p_partkey % 9 = 0 THEN 'elastic_ground_state' ELSE 'elastic_mode_' || p_partkey % 6 END
        WHEN 3 THEN CASE WHEN p_partkey % 9 != 0 THEN 'surface_1_' || p_size % 2 || '_0' END END AS split_unit FROM {RAW}
    JOIN part USING (p_partkey)"""
)
def record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL knows what each description means; here its words are read. Unknown ones are null (strict_records raises)."""
    s, k = F.col("p_size"), F.col("p_partkey")
    kind = s % 6
    group = F.when(kind == 1, "Vacancy").when(kind == 2, "Elastic").when(kind == 3, "Surface").when(kind == 4, "Molten").otherwise("AIMD-NVT")
    text = (
        F.when(kind == 0, F.format_string("Snapshot %d of 40 of AIMD NVT simulation at %d K", k % 40, s * 100))
        .when(kind == 1, F.format_string("Snapshot %d of 20 of Vacancy AIMD NVT simulation at %d K", k % 20 + 1, s))
        .when(kind == 2, F.when(k % 9 == 0, "ground state").otherwise(F.format_string("Elastic mode %d, strain -0.0%d", k % 6, s)))
        .when(kind == 3, F.when(k % 9 == 0, "slab").otherwise(F.format_string("Cu_mp-30_(1_%d_0) slab", s % 2)))
        .otherwise("snapshot of something")
    )
    found = rules.record_groups(group, text)
    return table(spark, sf_dir, "part").select("p_partkey", found["group_id"].alias("group_id"), found["split_unit"].alias("split_unit"))


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey % 5 AS top, o_orderkey % 97 = 0 AS bad_species, o_orderkey % 101 = 0 AS bad_label, o_orderkey % 103 = 0 AS flat, o_orderkey % 107 = 0 AS open, -4e0 - (o_orderkey % 11) * 0.06e0 AS each, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE (o_orderkey % 13) * 4.2e0 END AS f,
        o_custkey || '~' || floor(o_totalprice)::BIGINT % 50 AS h, o_custkey || '~' || floor(o_totalprice)::BIGINT % 10 AS g FROM orders),
    d AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad_species) AS s, count(*) FILTER (WHERE bad_label) AS l, count(*) FILTER (WHERE flat) AS c, count(*) FILTER (WHERE open) AS o, count(*) FILTER (WHERE NOT each BETWEEN -4.5 AND -3) AS e, count(*) FILTER (WHERE f IS NULL OR f > 50) AS f,
        count(*) - count(DISTINCT h) AS h, count(*) - count(DISTINCT g) AS g, 1 AS odd FROM c)
    SELECT * FROM (SELECT unnest(['species_allowlisted', 'labels_finite', 'cells_nonsingular', 'fully_periodic', 'energy_per_atom_in_window', 'force_magnitude_bounded', 'no_exact_duplicates', 'near_duplicates_reported', 'units_and_level_of_theory_declared', 'expected_total_count', 'expected_group_histogram']) AS "check",
        unnest([s = 0, l = 0, c = 0, o = 0, e = 0, f = 0, h = 0, true, true, n = 7, false]) AS passed, unnest([s, l, c, o, e, f, h, g - h, 0, n, (SELECT count(DISTINCT top) FROM c)]::BIGINT[]) AS observed FROM d)"""
)
def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cents = F.floor("o_totalprice")
    square = lambda x: F.array(F.array(x, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(4.0)))
    configs = o.select(
        F.when(k % 97 == 0, F.array(F.lit("Cu"), F.lit("Ni"))).otherwise(F.array(F.lit("Cu"), F.lit("Cu"))).alias("symbols"), F.lit(2).alias("n_atoms"),
        F.when(k % 101 == 0, (-4.0 - (k % 11) * 0.06) * 2).otherwise((-4.0 - (k % 11) * 0.06) * 2).alias("energy"), F.when(k % 101 == 0, F.lit(float("nan"))).otherwise((k % 13) * 4.2).alias("max_force"),
        square(F.when(k % 103 == 0, F.lit(0.0)).otherwise(F.lit(4.0))).alias("cell"), F.array(F.lit(True), k % 107 != 0, F.lit(True)).alias("pbc"),
        F.concat_ws("~", "o_custkey", cents % 50).alias("content_hash"), F.concat_ws("~", "o_custkey", cents % 10).alias("near_key"), (F.col("o_custkey") % 5).alias("top_group"),
    )
    expected = spark.createDataFrame([(i, 1) for i in range(5)], "top_group int, n long")
    return rules.qualification(configs, ["Cu"], (-4.5, -3.0), 50.0, True, 7, expected.withColumn("top_group", F.col("top_group").cast(configs.schema["top_group"].dataType)))


ROTATION = ("learning_rate", "gradient_clip", "force_loss_weight", "batch_size", "scheduler_patience", "energy_loss_weight")
BOUNDS = {"learning_rate": (1, 40), "gradient_clip": (1, 10), "force_loss_weight": (2, 50), "batch_size": (4, 64), "scheduler_patience": (1, 20), "energy_loss_weight": (1, 8)}


def _move_sql(name: str, factor: str) -> str:
    low, high = BOUNDS[name]
    moved = f"least({high}e0, greatest({low}e0, {name} * {factor}))"
    return f"CASE WHEN {name} IS NOT NULL AND {moved} != {name} THEN '{name}=' || round({moved} * 1000)::BIGINT END"


@query(
    f"""WITH r AS (SELECT p_partkey, p_partkey % 11 = 0 AS first, CASE WHEN p_partkey % 11 != 0 THEN {list(ROTATION)}[p_partkey % 6 + 1] END AS prior_key, CASE WHEN p_size % 2 = 0 THEN 0.5e0 ELSE 2e0 END AS factor,
        CASE WHEN p_size % 5 = 0 THEN 1e0 ELSE p_size::DOUBLE END AS learning_rate, 1e0 + p_size % 10 AS gradient_clip, 2e0 + p_size % 3 AS force_loss_weight, 4e0 + p_partkey % 4 AS batch_size, 1e0 + p_size % 20 AS scheduler_patience, CASE WHEN p_size % 2 = 1 THEN 8e0 END AS energy_loss_weight FROM part)
    SELECT p_partkey, CASE WHEN first THEN {_move_sql("learning_rate", "0.2e0")} ELSE coalesce({", ".join(f"CASE WHEN prior_key = '{k}' THEN {_move_sql(k, 'factor')} END" for k in ROTATION)},
        {", ".join(f"CASE WHEN prior_key != '{k}' THEN {_move_sql(k, '0.5e0')} END" for k in ROTATION)}) END AS move FROM r"""
)
def proposed_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    config = F.create_map(
        F.lit("learning_rate"), F.when(s % 5 == 0, 1.0).otherwise(s.cast("double")), F.lit("gradient_clip"), 1.0 + s % 10, F.lit("force_loss_weight"), 2.0 + s % 3,
        F.lit("batch_size"), 4.0 + k % 4, F.lit("scheduler_patience"), 1.0 + s % 20, F.lit("energy_loss_weight"), F.when(s % 2 == 1, 8.0),
    )
    first = k % 11 == 0
    runs = table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), F.when(~first, _pick(ROTATION, "p_partkey % 6")).alias("prior_key"), F.when(s % 2 == 0, 0.5).otherwise(2.0).alias("factor"), config.alias("config"))
    got = rules.proposed_moves(runs, ROTATION, BOUNDS)
    text = F.concat(F.col("move.name"), F.lit("="), F.round(F.col("move.value") * 1000).cast("long").cast("string"))
    return got.select("p_partkey", text.alias("move"))


@query("SELECT p_partkey, round(score, 6) AS score FROM (SELECT p_partkey, 2e0 * (1 + 0.1e0 * ((p_partkey * 7919 % 1000) / 250e0 - 2)) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 25) ORDER BY p_partkey")
def scored_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored_picks(table(spark, sf_dir, "part"), "p_partkey", (F.col("p_partkey") * 7919 % 1000) / 250.0 - 2, 2.0, 25).withColumn("score", F.round("score", 6))


@query(
    """WITH m AS (SELECT DISTINCT l_linenumber AS member, l_partkey AS key FROM lineitem WHERE l_linenumber <= 3), p AS (SELECT p_partkey AS key FROM part WHERE p_partkey % 40 != 3),
    w AS (SELECT member, key FROM (SELECT DISTINCT member FROM m), p)
    SELECT member, key, 'missing' AS problem FROM w ANTI JOIN m USING (member, key) UNION ALL SELECT member, key, 'unknown' FROM m ANTI JOIN p USING (key)"""
)
def member_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_linenumber").alias("member"), F.col("l_partkey").alias("key"))
    return rules.member_gaps(members, table(spark, sf_dir, "part").filter("p_partkey % 40 != 3").select(F.col("p_partkey").alias("key")), "member", "key")


PACKET = ("objective", "mutation_policy", "decision", "lesson")


@query(
    f"""WITH x AS (SELECT p_partkey // 4 AS packet_id, {[*PACKET]}[p_partkey % 4 + 1] AS a, p_partkey, p_size, p_name FROM part),
    r AS (SELECT packet_id, CASE WHEN p_partkey % 31 = 0 THEN 'raw_labels' WHEN p_partkey % 29 = 0 THEN 'decision' ELSE a END AS a, p_partkey % 23 = 0 AS changed FROM x WHERE p_partkey % 37 != 0),
    g AS (SELECT packet_id, list(DISTINCT a) AS held, count(*) AS n, count(*) FILTER (WHERE changed) AS c FROM r GROUP BY 1)
    SELECT packet_id, p AS problems FROM (SELECT packet_id, concat_ws(',', CASE WHEN list_contains(held, 'raw_labels') THEN 'not_allowed' END, CASE WHEN len(list_filter({[*PACKET]}, lambda k: NOT list_contains(held, k))) > 0 THEN 'missing' END,
        CASE WHEN n > len(held) THEN 'repeated' END, CASE WHEN c > 0 THEN 'changed' END) AS p FROM g) WHERE p != ''"""
)
def packet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 31 == 0, "raw_labels").when(k % 29 == 0, "decision").otherwise(_pick(PACKET, "p_partkey % 4"))
    payload = F.to_json(F.struct("p_name", "p_size"))
    rows = table(spark, sf_dir, "part").filter("p_partkey % 37 != 0").select(F.floor(k / 4).alias("packet_id"), name.alias("artifact_id"), payload.alias("payload"), F.sha2(F.when(k % 23 == 0, F.concat(payload, F.lit("x"))).otherwise(payload), 256).alias("bound_sha"))
    return rules.packet_problems(rows, PACKET).withColumn("problems", F.array_join("problems", ","))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 6 = 0 THEN 'authorization_missing' WHEN o_orderstatus != 'F' AND o_custkey % 6 = 1 THEN 'authorization_unexpected' END AS problem FROM orders
    WHERE o_orderstatus = 'F' AND o_custkey % 6 = 0 OR o_orderstatus != 'F' AND o_custkey % 6 = 1"""
)
def authorization_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    protected = F.col("o_orderstatus") == "F"
    given = F.when(protected & (F.col("o_custkey") % 6 != 0) | ~protected & (F.col("o_custkey") % 6 == 1), F.col("o_orderkey"))
    problem = rules.authorization_problem(F.when(protected, "protected").otherwise("validation"), given)
    return table(spark, sf_dir, "orders").select("o_orderkey", problem.alias("problem")).filter("problem IS NOT NULL")


@query(
    """WITH s AS (SELECT p_brand AS spec_id, p_name || p_partkey AS part, p_size AS requested, 5 + p_partkey % 3 AS minimum, p_partkey % 400 AS priority FROM part)
    SELECT spec_id, 'below_minimum' AS problem, part AS what FROM s WHERE requested < minimum
    UNION ALL SELECT spec_id, 'priority_repeated', priority::VARCHAR FROM s GROUP BY spec_id, priority HAVING count(*) > 1"""
)
def split_spec_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    specs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_id"), F.concat("p_name", k.cast("string")).alias("partition"), F.col("p_size").alias("requested"), (5 + k % 3).alias("minimum"), (k % 400).alias("priority"))
    return rules.split_spec_problems(specs)


@query(
    """WITH o AS (SELECT c_custkey AS objective_id, c_custkey % 4 = 0 AS im, c_custkey % 6 = 0 AS og, c_custkey % 5 IN (0, 1) AS t FROM customer)
    SELECT objective_id, concat_ws(',', CASE WHEN im THEN 'immutable' END, CASE WHEN og THEN 'owner_gated' END) AS forbidden_classes, t AS forbidden_tier FROM o WHERE im OR og OR t"""
)
def objective_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    permitted = F.array_compact(F.array(F.lit("optimization"), F.when(k % 6 == 0, F.lit("owner_gated")), F.when(k % 4 == 0, F.lit("immutable"))))
    tier = _pick(("replicated", "publication_eligible", "pilot_only", "pilot_only", "non_scientific"), "c_custkey % 5")
    rows = table(spark, sf_dir, "customer").select(k.alias("objective_id"), permitted.alias("permitted"), tier.alias("tier"))
    got = rules.objective_problems(rows, ["immutable", "owner_gated"], ["replicated", "publication_eligible"])
    return got.withColumn("forbidden_classes", F.array_join("forbidden_classes", ","))


@query(
    """WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS complete, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS wanted, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, o_orderkey % 3 = 0 AS claimed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus)
    SELECT run_id, p AS problems FROM (SELECT run_id, concat_ws(',', CASE WHEN complete AND done < wanted THEN 'complete_with_gaps' END, CASE WHEN NOT complete AND done >= wanted AND failed = 0 THEN 'not_marked_complete' END, CASE WHEN failed > 0 AND claimed THEN 'failed_step_claimed' END) AS p FROM r) WHERE p != ''"""
)
def dishonest_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("wanted"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("complete"), (F.col("o_orderkey") % 3 == 0).alias("claimed")).join(steps, "run_id")
    return rules.dishonest_completions(runs).withColumn("problems", F.array_join("problems", ","))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'file_name' WHEN p_partkey % 7 = 0 THEN 'size' WHEN p_size % 5 = 0 THEN 'sha256' END AS problem FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_size % 5 = 0")
def checkpoint_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    problem = rules.checkpoint_problem(F.when(k % 11 == 0, "other.model").otherwise("a.model"), F.when(k % 7 == 0, s + 1).otherwise(s), F.when(s % 5 == 0, F.lit(None)).otherwise(F.sha2("p_name", 256)), F.lit("a.model"), s, F.sha2("p_name", 256))
    return table(spark, sf_dir, "part").select("p_partkey", problem.alias("problem")).filter("problem IS NOT NULL")


@query(
    """SELECT user_id, event_id, CASE WHEN value > 100 THEN 'resource_exhausted' ELSE 'tool_error' END AS failure_class, value > 100 AS retryable, left(props, 200) AS summary, sha256(props) AS message_sha256 FROM events WHERE event_type = 'error'"""
)
def failure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    full = F.coalesce(F.col("value") > 100, F.lit(False))
    return rules.failure_records(e, "user_id", "event_id", "props", F.when(full, "resource_exhausted").otherwise("tool_error"), full)


@query(
    """WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id AS run_id, '# Run ' || user_id || chr(10) || chr(10) || string_agg('- ' || event_type || ': ' || n, chr(10) ORDER BY event_type) AS text FROM f GROUP BY 1"""
)
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("fact")).agg(F.count("*").cast("string").alias("value")).withColumn("place", F.lit(0))
    return rules.report_lines(facts)


@query(
    """WITH s AS (SELECT p_brand AS part, count(*) AS n, 80 AS requested, count(DISTINCT CASE WHEN p_brand < 'Brand#12' THEN 'x' ELSE p_type END) AS groups FROM part GROUP BY 1)
    SELECT part AS partition, part || ' has ' || n || ' rows instead of ' || requested AS warning FROM s WHERE n != requested UNION ALL SELECT part, part || ' holds a single group' FROM s WHERE groups = 1"""
)
def split_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_brand") < "Brand#12", "x").otherwise(F.col("p_type"))
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("partition")).agg(F.count("*").alias("n"), F.lit(80).alias("requested"), F.count_distinct(kind).alias("groups"))
    return rules.split_warnings(s)


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 IN (1, 2, 4)")
def escaping_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a structure set may not name: they leave the run's folder, whatever they begin with."""
    path = _pick(("run/a/../set.json", "run/../x.json", "run10/set.json", "./run//b/./set.json", "../run/set.json"), "p_partkey % 5")
    return table(spark, sf_dir, "part").filter(~inside_folder(path, "run/")).select("p_partkey")
