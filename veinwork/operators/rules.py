"""Rules of the experiment loop written out: changes to a configuration, compute requests, raw records, qualification, packets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.scalars import determinant3
from veinwork.operators.policy import reasons

# Kinds of work that are whole campaigns.
FULL_CAMPAIGNS = ("primary_training", "active_learning", "benchmark", "production_research")
# Frames of a trajectory in a block.
BULK_BLOCK, VACANCY_BLOCK = 10, 5


def change_violations(changes: DataFrame, policy: DataFrame, current: DataFrame, permitted: Sequence[str]) -> DataFrame:
    """Every violation of every proposed change: proposal, position, name, violation.

    changes: proposal, position, name, old_value, new_value, low, high. policy: name, class, low, high. current: name, value.
    A second change of one name is a violation by itself. Besides, of these the first that holds: a name that the policy
    doesn't know or calls immutable, an owner-gated one, a class that isn't permitted, another range than the policy's, a value
    outside it, a name that the configuration lacks, an old value that isn't the current one.
    """
    rules = policy.select("name", F.col("class").alias("_class"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    now = current.select("name", F.col("value").alias("_now"), F.lit(True).alias("_there"))
    joined = changes.join(rules, "name", "left").join(now, "name", "left")
    kind, bounded = F.coalesce("_class", F.lit("immutable")), F.col("_low").isNotNull()
    first = (
        F.when(kind == "immutable", "immutable")
        .when(kind == "owner_gated", "owner_gated")
        .when(~kind.isin(list(permitted)), "class_not_permitted")
        .when(bounded & ~(F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))), "range_mismatch")
        .when(bounded & ~F.coalesce(F.col("new_value").between(F.col("_low"), F.col("_high")), F.lit(False)), "out_of_bounds")
        .when(F.col("_there").isNull(), "absent_key")
        .when(~F.col("old_value").eqNullSafe(F.col("_now")), "stale_old_value")
    )
    earlier = F.row_number().over(Window.partitionBy("proposal", "name").orderBy("position")) > 1
    found = joined.select("proposal", "position", "name", F.array_compact(F.array(F.when(earlier, F.lit("duplicate")), first)).alias("violations"))
    return found.select("proposal", "position", "name", F.explode("violations").alias("violation"))


def compute_denials(requests: DataFrame, providers: DataFrame, primary: str) -> DataFrame:
    """requests with denials (in the rules' order) and allowed. A request of an unknown provider is denied.

    requests: provider, accelerator, n_gpus, workload, minutes, observed (as reported), canonical (its known name, null for an
    unknown one). providers: provider, enabled, accelerators, max_gpus, full_campaigns, long_training, max_minutes, attested.
    """
    p = requests.join(providers, "provider", "left")
    seen, known = F.col("observed").isNotNull(), F.col("canonical").isNotNull()
    listed = lambda name: F.coalesce(F.array_contains("accelerators", name), F.lit(False))
    broken = reasons({
        "unknown_provider": F.col("enabled").isNull(),
        "disabled": F.coalesce(~F.col("enabled"), F.lit(False)),
        "accelerator": ~listed(F.col("accelerator")),
        "too_many_gpus": F.coalesce(F.col("n_gpus") > F.col("max_gpus"), F.lit(False)),
        "full_campaign": F.col("workload").isin(*FULL_CAMPAIGNS) & (F.col("provider") != primary) & ~F.coalesce("full_campaigns", F.lit(False)),
        "unbounded_training": (F.col("workload") == "development_training") & (F.col("provider") == "colab") & ~F.coalesce("long_training", F.lit(False)) & (F.col("max_minutes").isNull() | (F.col("minutes") > F.col("max_minutes"))),
        "no_attestation": ~seen & F.coalesce("attested", F.lit(True)),
        "unrecognized": seen & ~known,
        "observed_not_listed": seen & known & ~listed(F.col("canonical")),
        "observed_differs": seen & known & (F.col("canonical") != F.col("accelerator")),
    })
    return p.select(*requests.columns, broken.alias("denials"), (F.size(broken) == 0).alias("allowed"))


def routed(requests: DataFrame, routes: DataFrame, otherwise: str) -> DataFrame:
    """requests with the provider that the table routes(workload, provider) gives for their kind of work, or that they ask for
    themselves (wanted), and whether that overrides the table."""
    by_table = F.coalesce("_provider", F.lit(otherwise))
    joined = requests.join(routes.select("workload", F.col("provider").alias("_provider")), "workload", "left")
    return joined.select(*requests.columns, F.coalesce("wanted", by_table).alias("provider"), (F.col("wanted").isNotNull() & (F.col("wanted") != by_table)).alias("override"))


def preflight_gate(provider: Column, workload: Column, preflight: Column, approved_by: Column, primary: str) -> Column:
    """open where no gate stands; with one: valid, else emergency if a human approved it, else denied."""
    gated = (provider == primary) & workload.isin(*FULL_CAMPAIGNS)
    return F.when(~gated, "open").when(preflight.isNotNull(), "valid").when(F.coalesce(F.length(approved_by), F.lit(0)) > 0, "emergency").otherwise("denied")


def record_groups(group: Column, description: Column) -> Column:
    """group_id and split_unit of a raw record; both null for a description or group that isn't known.

    Bulk frames count from 0, vacancy frames from 1; a block is BULK_BLOCK or VACANCY_BLOCK of them.
    """
    # The forms of a description.
    bulk, vacancy = r"^Snapshot (\d+) of \d+ of AIMD NVT simulation at (\d+) K$", r"^Snapshot (\d+) of \d+ of Vacancy AIMD NVT simulation at (\d+) K$"
    elastic, surface = r"mode (\d+), strain (-?\d+\.\d+)", r"Cu_mp-30_\(([\d_]+)\)"

    def trajectory(name: str, pattern: str, block: int, first: int) -> Column:
        run = F.concat(F.lit(f"{name}_"), F.regexp_extract(description, pattern, 2), F.lit("k"))
        number = F.floor((F.regexp_extract(description, pattern, 1).try_cast("int") - first) / block)
        return F.when(description.rlike(pattern), F.struct(run.alias("group_id"), F.concat(run, F.lit("_block"), number.cast("string")).alias("split_unit")))

    def same(text: Column) -> Column:
        return F.struct(text.alias("group_id"), text.alias("split_unit"))

    mode = F.when(description.rlike(elastic), F.concat(F.lit("elastic_mode_"), F.regexp_extract(description, elastic, 1).try_cast("int").cast("string"))).otherwise("elastic_ground_state")
    face = F.concat(F.lit("surface_"), F.regexp_extract(description, surface, 1))
    return (
        F.when(group == "AIMD-NVT", trajectory("aimd_nvt", bulk, BULK_BLOCK, 0))
        .when(group == "Vacancy", trajectory("vacancy", vacancy, VACANCY_BLOCK, 1))
        .when(group == "Elastic", same(mode))
        .when((group == "Surface") & description.rlike(surface), same(face))
    )


def strict_records(rows: DataFrame, group: str, description: str) -> DataFrame:
    """rows with group_id and split_unit; a record that isn't recognised fails the load."""
    found = record_groups(F.col(group), F.col(description))
    named = F.when(found.isNull(), F.raise_error(F.concat(F.lit("unrecognised record: "), F.col(group), F.lit(" / "), F.col(description))).cast("string"))
    return rows.withColumns({"group_id": F.coalesce(named, found["group_id"]), "split_unit": found["split_unit"]})


def qualification(configs: DataFrame, species: Sequence[str], window: tuple[float, float], max_force: float, units_declared: bool, expected_total: int | None = None, expected_groups: DataFrame | None = None) -> DataFrame:
    """check, passed: nine checks of a dataset, and two more where totals are expected.

    configs: symbols, energy, n_atoms, cell, pbc, max_force (null or NaN for labels that aren't finite), content_hash, near_key, top_group.
    expected_groups: top_group, n. One pass for the sums, one count for each of the two keys.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    energy, force, each = F.col("energy"), F.col("max_force"), F.col("energy") / F.col("n_atoms")
    allowed = F.array(*map(F.lit, species))
    sums = configs.agg(
        F.count("*").alias("n"),
        F.count_if(F.size(F.array_except("symbols", allowed)) > 0).alias("species"),
        F.count_if(bad(energy) | bad(force)).alias("labels"),
        F.count_if(F.coalesce(F.abs(determinant3(F.col("cell"))) < 1.0, F.lit(True))).alias("cells"),
        F.count_if(~F.coalesce(F.forall("pbc", lambda x: x), F.lit(False))).alias("open"),
        F.count_if(~F.coalesce(each.between(*window), F.lit(False)) | F.isnan(each)).alias("energies"),
        F.count_if(~F.coalesce(force <= max_force, F.lit(False)) | F.isnan(force)).alias("forces"),
    )
    spare = lambda key: configs.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"spare_{key}"))
    both = sums.join(spare("content_hash")).join(spare("near_key"))  # one row each
    found = [
        ("species_allowlisted", F.col("species") == 0, "species"), ("labels_finite", F.col("labels") == 0, "labels"), ("cells_nonsingular", F.col("cells") == 0, "cells"),
        ("fully_periodic", F.col("open") == 0, "open"), ("energy_per_atom_in_window", F.col("energies") == 0, "energies"), ("force_magnitude_bounded", F.col("forces") == 0, "forces"),
        ("no_exact_duplicates", F.col("spare_content_hash") == 0, "spare_content_hash"), ("near_duplicates_reported", F.lit(True), "near"), ("units_and_level_of_theory_declared", F.lit(units_declared), None),
    ]
    if expected_total is not None:
        found.append(("expected_total_count", F.col("n") == expected_total, "n"))
    if expected_groups is not None:
        got = configs.groupBy("top_group").agg(F.count("*").alias("n"))
        odd = got.unionByName(expected_groups.select("top_group", (-F.col("n")).alias("n"))).groupBy("top_group").agg(F.sum("n").alias("d")).filter("d != 0")
        both = both.join(odd.agg(F.count("*").alias("histogram")))
        found.append(("expected_group_histogram", F.col("histogram") == 0, "histogram"))
    both = both.withColumn("near", F.col("spare_near_key") - F.col("spare_content_hash"))
    rows = F.array(*(F.struct(F.lit(c).alias("check"), ok.alias("passed"), (F.col(v) if v else F.lit(0)).cast("long").alias("observed")) for c, ok, v in found))
    return both.select(F.explode(rows).alias("x")).select("x.*")


def proposed_moves(runs: DataFrame, rotation: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """runs with move(name, value): the first proposal takes the learning rate times 0.2. Later ones move the key that was
    moved before by its factor; where that stands at its bound, the first other key of the rotation that halving still moves.

    runs: first, prior_key, factor, config (map of values). A move is kept within the key's range; null if no key can move.
    """

    def move(name: str, factor: Column) -> Column:
        low, high = ranges[name]
        now = F.element_at("config", name)
        then = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), now * factor))
        return F.when(now.isNotNull() & (then != now), F.struct(F.lit(name).alias("name"), then.alias("value")))

    own = F.coalesce(*(F.when(F.col("prior_key") == k, move(k, F.col("factor"))) for k in rotation))
    others = F.coalesce(*(F.when(F.coalesce("prior_key", F.lit(rotation[0])) != k, move(k, F.lit(0.5))) for k in rotation))
    return runs.withColumn("move", F.when(F.col("first"), move("learning_rate", F.lit(0.2))).otherwise(F.coalesce(own, others)))


def scored_picks(pool: DataFrame, place: str, noise: Column, scale: float, budget: int) -> DataFrame:
    """Places of the budget's rows with the highest score scale * (1 + 0.1 * noise), in their own order; ties go to the smaller place."""
    score = F.lit(scale) * (1 + 0.1 * noise)
    return pool.select(place, score.alias("score")).orderBy(F.desc("score"), place).limit(budget).orderBy(place)


def member_gaps(members: DataFrame, pool: DataFrame, member: str, key: str) -> DataFrame:
    """Per member the keys of the pool that it lacks and its keys that the pool doesn't know: empty if all cover the pool."""
    rows, asked = members.select(member, key).distinct(), pool.select(key).distinct()
    known = rows.join(asked, key, "left_semi")
    # Only the members that lack something meet the pool's keys; those that hold as many of them as there are lack none.
    counts = rows.select(member).distinct().join(known.groupBy(member).agg(F.count("*").alias("_held")), member, "left")
    size = asked.agg(F.count("*").alias("_size"))
    short = counts.join(F.broadcast(size)).filter(F.coalesce("_held", F.lit(0)) < F.col("_size")).select(member)
    missing = short.join(asked).join(known, [member, key], "left_anti").select(member, key, F.lit("missing").alias("problem"))
    return missing.unionByName(rows.join(pool, key, "left_anti").select(member, key, F.lit("unknown").alias("problem")))


def packet_problems(packets: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """What is wrong with review packets: artifacts that aren't allowed, allowed ones that are missing, contents that don't
    have the hash that the packet binds. packets: packet_id, artifact_id, payload, bound_sha."""
    per = packets.groupBy("packet_id").agg(
        F.array_sort(F.collect_set("artifact_id")).alias("held"),
        F.count_if(~F.sha2("payload", 256).eqNullSafe(F.col("bound_sha"))).alias("changed"),
        F.count("*").alias("n"),
    )
    names = F.array(*map(F.lit, sorted(allowed)))
    problem = reasons({
        "not_allowed": F.size(F.array_except("held", names)) > 0,
        "missing": F.size(F.array_except(names, F.col("held"))) > 0,
        "repeated": F.col("n") > F.size("held"),
        "changed": F.col("changed") > 0,
    })
    return per.select("packet_id", problem.alias("problems")).filter(F.size("problems") > 0)


def authorization_problem(partition: Column, authorization: Column, protected: str = "protected") -> Column:
    """A protected partition needs an authorization, any other must have none; null if that holds."""
    return F.when((partition == protected) & authorization.isNull(), "authorization_missing").when((partition != protected) & authorization.isNotNull(), "authorization_unexpected")


def split_spec_problems(specs: DataFrame) -> DataFrame:
    """specs: spec_id, partition, requested, minimum, priority. Partitions that ask for less than their minimum, priorities given twice."""
    low = specs.filter(F.col("requested") < F.col("minimum")).select("spec_id", F.lit("below_minimum").alias("problem"), F.col("partition").alias("what"))
    twice = specs.groupBy("spec_id", "priority").agg(F.count("*").alias("n")).filter("n > 1").select("spec_id", F.lit("priority_repeated").alias("problem"), F.col("priority").cast("string").alias("what"))
    return low.unionByName(twice)


def objective_problems(objectives: DataFrame, classes: Sequence[str], tiers: Sequence[str]) -> DataFrame:
    """Objectives that permit a class of changes or a claim tier which no objective may. objectives: objective_id, permitted, tier."""
    forbidden = F.array_sort(F.array_intersect("permitted", F.array(*map(F.lit, classes))))
    bad_tier = F.col("tier").isin(list(tiers))
    found = objectives.select("objective_id", forbidden.alias("forbidden_classes"), F.coalesce(bad_tier, F.lit(False)).alias("forbidden_tier"))
    return found.filter((F.size("forbidden_classes") > 0) | F.col("forbidden_tier"))


def dishonest_completions(runs: DataFrame) -> DataFrame:
    """Runs that call themselves complete without having done all, or that claim a failed step's result. runs: run_id, complete, done, wanted, failed, claimed."""
    problem = F.array_compact(F.array(F.when(F.col("complete") & (F.col("done") < F.col("wanted")), F.lit("complete_with_gaps")), F.when(~F.col("complete") & (F.col("done") >= F.col("wanted")) & (F.col("failed") == 0), F.lit("not_marked_complete")), F.when((F.col("failed") > 0) & F.col("claimed"), F.lit("failed_step_claimed"))))
    return runs.select("run_id", problem.alias("problems")).filter(F.size("problems") > 0)


def checkpoint_problem(name: Column, size: Column, sha: Column, want_name: Column, want_size: Column, want_sha: Column) -> Column:
    """The first of file name, size and hash that doesn't match; null if all do."""
    return F.when(~name.eqNullSafe(want_name), "file_name").when(~size.eqNullSafe(want_size), "size").when(~sha.eqNullSafe(want_sha), "sha256")


def failure_records(events: DataFrame, run: str, step: str, message: str, kind: Column, retryable: Column) -> DataFrame:
    """A record per failed step: run, step, class, retryable, a short message and a hash of the whole of it."""
    return events.select(run, step, kind.alias("failure_class"), retryable.alias("retryable"), F.substring(message, 1, 200).alias("summary"), F.sha2(message, 256).alias("message_sha256"))


def report_lines(sections: DataFrame) -> DataFrame:
    """A run report in Markdown, one row of text per run: a heading, then a bullet for each fact in order. sections: run_id, place, fact, value."""
    bullet = F.format_string("- %s: %s", "fact", "value")
    lines = F.array_sort(F.collect_list(F.struct("place", "fact", bullet.alias("line"))))
    return sections.groupBy("run_id").agg(lines.alias("l")).select("run_id", F.concat(F.lit("# Run "), F.col("run_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def split_warnings(summary: DataFrame) -> DataFrame:
    """Partitions whose size misses the request, and those of one group only, in words. summary: partition, n, requested, groups."""
    off = F.when(F.col("n") != F.col("requested"), F.format_string("%s has %d rows instead of %d", "partition", "n", "requested"))
    one = F.when(F.col("groups") == 1, F.format_string("%s holds a single group", "partition"))
    return summary.select("partition", F.explode(F.array_compact(F.array(off, one))).alias("warning"))
