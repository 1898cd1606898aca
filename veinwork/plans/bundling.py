"""Evaluations, subsets and signals with a planted break of each rule, and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import bundles
from veinwork.plans.geometry import _structures
from veinwork.plans.registry import query
from veinwork.sources import exports
from veinwork.sources.tables import table

BREAKS = [(name, 11 + 2 * i) for i, (name, _, _) in enumerate(bundles.PROVENANCE)] + [("units", 11 + 2 * len(bundles.PROVENANCE))]
CASES = ", ".join(f"CASE WHEN p_partkey % {m} = 1 THEN '{n}' END" for n, m in BREAKS)


@query(f"SELECT * FROM (SELECT p_partkey, concat_ws(',', {CASES}) AS broken FROM part) WHERE broken != ''")
def provenance_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are evaluations; each of the twelve bindings is broken in some, half of the time by a missing value."""
    modulo = dict(BREAKS)
    k = F.col("p_partkey")
    columns = []
    for name, says, equals in bundles.PROVENANCE:
        broken = k % modulo[name] == 1
        columns += [F.when(broken & (k % 2 == 0), F.lit(None)).when(broken, "other").otherwise(F.col("p_brand")).alias(says), F.col("p_brand").alias(equals)]
    rows = table(spark, sf_dir, "part").select("p_partkey", *columns, F.when(k % modulo["units"] == 1, "kcal").otherwise("eV").alias("energy_unit"), F.lit("eV/angstrom").alias("force_unit"))
    return bundles.provenance_breaks(rows, "p_partkey").withColumn("broken", F.array_join("broken", ","))


@query(
    """WITH s AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'F' THEN 'initial' WHEN o_orderstatus = 'O' THEN 'validation' ELSE 'pool' END AS partition FROM orders),
    u AS (SELECT CASE WHEN partition = 'initial' THEN 'train' ELSE 'validate' END AS role, record_id, partition FROM s WHERE partition != 'pool' OR record_id % 5 = 0),
    w AS (SELECT role, record_id, partition FROM u UNION ALL SELECT 'train', record_id, partition FROM u WHERE role = 'validate' AND record_id % 31 = 3 UNION ALL SELECT role, record_id, partition FROM u WHERE record_id % 37 = 4),
    m AS (SELECT role, record_id, partition, count(*) AS n FROM w GROUP BY ALL),
    t AS (SELECT record_id FROM m WHERE role = 'train')
    SELECT role, record_id, 'outside' AS problem FROM m WHERE partition != CASE role WHEN 'train' THEN 'initial' ELSE 'validation' END
    UNION ALL SELECT min(role), record_id, 'overlap' FROM m GROUP BY record_id HAVING count(*) > 1
    UNION ALL SELECT role, record_id, 'repeated' FROM m WHERE n > 1
    UNION ALL SELECT 'train', record_id, 'not_in_lineage' FROM t WHERE record_id % 41 = 5
    UNION ALL SELECT 'train', record_id, 'lineage_not_used' FROM s WHERE record_id % 41 != 5 AND partition = 'pool' AND record_id % 43 = 6 AND record_id NOT IN (SELECT record_id FROM t)"""
)
def subset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are records: subsets that leave their partition, overlap, repeat records or differ from the training lineage."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    split = table(spark, sf_dir, "orders").select(k.alias("record_id"), F.when(status == "F", "initial").when(status == "O", "validation").otherwise("pool").alias("partition"))
    used = split.filter("partition != 'pool' OR record_id % 5 = 0").select(F.when(F.col("partition") == "initial", "train").otherwise("validate").alias("role"), "record_id")
    moved = used.filter("role = 'validate' AND record_id % 31 = 3").withColumn("role", F.lit("train"))
    subsets = used.unionByName(moved).unionByName(used.filter("record_id % 37 = 4"))
    lineage = subsets.filter("role = 'train'").select("record_id").unionByName(split.filter("partition = 'pool' AND record_id % 43 = 6").select("record_id")).filter("record_id % 41 != 5")
    return bundles.subset_problems(subsets, split, {"train": "initial", "validate": "validation"}, lineage)


@query(
    """WITH s AS (SELECT DISTINCT p_partkey AS c, m FROM part, (SELECT unnest(['a', 'b', 'c']) AS m) WHERE NOT (p_partkey % 29 = 3 AND m = 'b')),
    p AS (SELECT p_partkey AS c FROM part WHERE p_partkey % 31 != 4)
    SELECT p_partkey AS candidate_id, 'not_in_pool' AS problem FROM part WHERE p_partkey % 31 = 4 UNION ALL SELECT c, 'no_descriptor' FROM p WHERE c % 37 = 5 UNION ALL SELECT c, 'not_scored:b' FROM p WHERE c % 29 = 3"""
)
def signal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the pool doesn't know, that lack a descriptor, or that a member hasn't scored."""
    p, k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id")), F.col("candidate_id")
    signals = p.select("candidate_id", F.explode(F.array(*map(F.lit, "abc"))).alias("member")).filter(~((k % 29 == 3) & (F.col("member") == "b")))
    return bundles.signal_problems(signals, p.filter(k % 31 != 4), p.filter(k % 37 != 5), ["a", "b", "c"])


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(abs(l_quantity - l_discount * 100)), 6) AS mean, round(max(abs(l_quantity - (l_quantity + l_tax))), 6) AS rerun_delta,
    round(quantile_cont(abs(l_quantity - l_discount * 100), 0.95), 6) AS p95 FROM lineitem GROUP BY 1"""
)
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("p"), (F.col("l_discount") * 100).alias("t"), (F.col("l_quantity") + F.col("l_tax")).alias("q"))
    found = bundles.residual_summary(rows, ["l_returnflag"], "p", "t", "q")
    return found.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "rerun_delta", "p95")))


ATOM = "l_returnflag || ' ' || printf('%.10f %.10f %.10f', l_quantity, l_discount * 100, l_tax * 100)"
SORTED = "l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_tax"


@query(
    f"""SELECT l_orderkey, sha256(count(*) || chr(10) || 'Lattice="' || array_to_string(list_transform([60, 0, 0, 0, 60, 0, 0, 0, 60], lambda x: printf('%.10f', x::DOUBLE)), ' ') || '" Properties=species:S:1:pos:R:3:REF_forces:R:3 REF_energy='
    || printf('%.10f', l_orderkey::DOUBLE) || ' pbc="T T F" config_id=' || l_orderkey || chr(10) || string_agg({ATOM} || ' ' || printf('%.10f %.10f %.10f', l_tax * 100, l_discount * 100, l_quantity), chr(10) ORDER BY {SORTED})) AS frame_sha256 FROM lineitem GROUP BY 1"""
)
def xyz_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their lattice, periodic directions and id."""
    s = _structures(spark, sf_dir).withColumn("forces", F.transform("positions", F.reverse)).withColumn("pbc", F.array(F.lit(True), F.lit(True), F.lit(False))).withColumn("energy", F.col("l_orderkey").cast("double"))
    return exports.xyz_frames(s, "l_orderkey").select("l_orderkey", F.sha2("text", 256).alias("frame_sha256"))


@query(
    f"""WITH k AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS kinds FROM lineitem GROUP BY 1),
    a AS (SELECT l.l_orderkey, count(*) AS n, string_agg(i || ' ' || list_position(kinds, l_returnflag) || printf(' %.10f %.10f %.10f', l_quantity, l_discount * 100, l_tax * 100), chr(10) ORDER BY i) AS atoms
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SORTED}) AS i FROM lineitem) l JOIN k USING (l_orderkey) GROUP BY 1)
    SELECT l_orderkey, CASE WHEN NOT list_contains(kinds, 'R') THEN n || ' atoms' || chr(10) || len(kinds) || ' atom types' || chr(10) || chr(10) || '0.0 60.0000000000 xlo xhi' || chr(10) || '0.0 60.0000000000 ylo yhi' || chr(10) || '0.0 60.0000000000 zlo zhi' || chr(10) || chr(10) || 'Masses' || chr(10) || chr(10)
        || array_to_string(list_transform(kinds, lambda x, i: i || printf(' %.6f  # ', CASE x WHEN 'A' THEN 1.008e0 ELSE 15.999e0 END) || x), chr(10)) || chr(10) || chr(10) || 'Atoms  # atomic' || chr(10) || chr(10) || atoms END AS text FROM a JOIN k USING (l_orderkey)"""
)
def data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files; a structure with an element of unknown mass has none."""
    masses = spark.createDataFrame([("A", 1.008), ("N", 15.999)], "symbol string, mass double")
    return exports.data_file(_structures(spark, sf_dir), masses, "l_orderkey")


# The keys in their rotation, with bounds and whether they are integers.
MOVES = {"learning_rate": (1.0, 20.0, False), "gradient_clip": (1.0, 16.0, False), "batch_size": (2.0, 9.0, True)}


@query(
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'refine' WHEN 1 THEN 'reject' WHEN 2 THEN 'accept' END AS decision, p_partkey % 8 = 1 AS failed, p_size % 2 = 0 AS down,
        least(20e0, greatest(1e0, p_size % 5)) AS lr, 1e0 + p_size % 16 AS clip, 2e0 + p_size % 8 AS batch FROM part),
    m AS (SELECT *, greatest(1e0, lr * 0.2e0) AS lr1, greatest(1e0, lr * 0.5e0) AS lr2, least(16e0, clip * 2) AS clip2, greatest(1e0, clip * 0.5e0) AS clip1, round_even(greatest(2e0, batch * 0.5e0), 0) AS batch2,
        CASE WHEN down THEN greatest(1e0, lr * 0.5e0) ELSE least(20e0, lr * 2) END AS on1 FROM r),
    t AS (SELECT p_partkey, CASE WHEN decision IS NULL THEN CASE WHEN lr1 != lr THEN 'learning_rate=' || round(lr1 * 1000)::BIGINT ELSE 'first_move' END
        WHEN decision = 'refine' THEN CASE WHEN lr2 != lr THEN 'learning_rate=' || round(lr2 * 1000)::BIGINT WHEN clip2 != clip THEN 'gradient_clip=' || round(clip2 * 1000)::BIGINT ELSE 'no_stability_repair' END
        WHEN decision = 'reject' AND failed THEN CASE WHEN batch2 != batch THEN 'batch_size=' || round(batch2 * 1000)::BIGINT ELSE 'no_resource_repair' END
        WHEN decision = 'accept' AND on1 != lr THEN 'learning_rate=' || round(on1 * 1000)::BIGINT
        ELSE CASE WHEN clip1 != clip THEN 'gradient_clip=' || round(clip1 * 1000)::BIGINT WHEN batch2 != batch THEN 'batch_size=' || round(batch2 * 1000)::BIGINT ELSE 'no_key_moves' END END AS move FROM m)
    SELECT * FROM t"""
)
def next_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are runs whose last change was of the learning rate: the next move, or why there is none."""
    from veinwork.operators.moves import next_mutation

    k, s = F.col("p_partkey"), F.col("p_size")
    config = F.create_map(F.lit("learning_rate"), F.least(F.lit(20.0), F.greatest(F.lit(1.0), (s % 5).cast("double"))), F.lit("gradient_clip"), 1.0 + s % 16, F.lit("batch_size"), 2.0 + s % 8)
    decision = F.when(k % 4 == 0, "refine").when(k % 4 == 1, "reject").when(k % 4 == 2, "accept")
    runs = table(spark, sf_dir, "part").select("p_partkey", decision.alias("decision"), (k % 8 == 1).alias("constraint_failed"), F.lit("learning_rate").alias("mutated_key"), (s % 2 == 0).alias("was_decrease"), config.alias("config"))
    moved = F.concat(F.col("move.key"), F.lit("="), F.round(F.col("move.new") * 1000).cast("long").cast("string"))
    return next_mutation(runs, list(MOVES), MOVES).select("p_partkey", F.coalesce(moved, "blocked").alias("move"))
