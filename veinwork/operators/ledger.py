"""The label budget: reveals by round, idempotent, charged once, never over budget."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.scalars import canonical_text
from veinwork.operators.policy import reasons

#: What the first entry of a chain follows.
GENESIS = "0" * 64


def charge(requests: DataFrame, round_budget: int | None = None) -> DataFrame:
    """requests: campaign, round, record_id. Each record is charged in the first round that asks for it.

    One row per campaign and round: requested, charged (new records), over_round. The first round is a minimum
    per record, so a record asked for by very many rounds is summed in parts.
    """
    asked = requests.distinct()
    first = asked.groupBy("campaign", "record_id").agg(F.min("round").alias("round")).groupBy("campaign", "round").agg(F.count("*").alias("charged"))
    counts = asked.groupBy("campaign", "round").agg(F.count("*").alias("requested"))
    out = counts.join(first, ["campaign", "round"], "left").withColumn("charged", F.coalesce("charged", F.lit(0)))
    return out.withColumn("over_round", F.col("charged") > round_budget if round_budget is not None else F.lit(False))


def balance(charges: DataFrame, budget: int) -> DataFrame:
    """charges with what each campaign has spent up to and with the round, and what remains; a row is refused if that is below 0."""
    w = Window.partitionBy("campaign").orderBy("round")
    spent = F.sum("charged").over(w)
    return charges.withColumn("spent", spent).withColumn("remaining", budget - spent).withColumn("refused", budget - spent < 0)


def rejections(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """Requests for records outside the pool, with the reason."""
    return requests.distinct().join(pool.select("record_id"), "record_id", "left_anti").withColumn("reason", F.lit("not_in_pool"))


def conflicts(requests: DataFrame, again: DataFrame) -> DataFrame:
    """Rounds asked for twice with different records; equal repeats are idempotent and not listed."""
    content = lambda df: df.distinct().groupBy("campaign", "round").agg(F.count("*").alias("n"), F.sum(F.xxhash64("record_id").cast("decimal(38,0)")).alias("h"))
    a, b = content(requests), content(again).withColumnsRenamed({"n": "n2", "h": "h2"})
    return a.join(b, ["campaign", "round"]).filter("n != n2 OR h != h2").select("campaign", "round")


def training_set(initial: DataFrame, revealed: DataFrame) -> DataFrame:
    """record_id and its origin: the initial records and the revealed ones, each once."""
    both = initial.select("record_id", F.lit("initial").alias("origin")).unionByName(revealed.select("record_id", F.lit("revealed").alias("origin")))
    return both.groupBy("record_id").agg(F.min("origin").alias("origin"), F.count_distinct("origin").alias("n_origins"))


def heads(states: DataFrame, campaign: str, length: str) -> DataFrame:
    """The longest history of each campaign, and whether it is the only one of that length."""
    longest = states.groupBy(campaign).agg(F.max(length).alias("history_length"))
    tied = states.groupBy(campaign, length).agg(F.count("*").alias("n_states")).withColumnRenamed(length, "history_length")
    return longest.join(tied, [campaign, "history_length"]).select(campaign, "history_length", (F.col("n_states") == 1).alias("unique_head"))


def requests_by_identity(requests: DataFrame, *pins: Column) -> DataFrame:
    """One row per campaign and round: n_requested, request_id (a hash of campaign, round, pins and the sorted ids), problems.

    requests: campaign, round, record_id, with repeats. pins: hashes of the dataset and split that every request is bound to. A
    request's ids are a round's budget at most, so they are one row. Equal requests have equal ids whatever the order of their records.
    """
    asked = requests.groupBy("campaign", "round").agg(F.array_sort(F.collect_list("record_id")).alias("ids"))
    distinct = F.array_distinct("ids")
    identity = F.sha2(F.concat_ws("|", F.col("campaign").cast("string"), F.coalesce(F.col("round").cast("string"), F.lit("~")), *(p.cast("string") for p in pins), F.array_join(distinct.cast("array<string>"), ",")), 256)
    wrong = reasons({"no_round": F.coalesce(F.col("round").cast("string"), F.lit("")) == "", "repeated_ids": F.size(distinct) < F.size("ids")})
    return asked.select("campaign", "round", F.size(distinct).cast("long").alias("n_requested"), identity.alias("request_id"), wrong.alias("problems"))


def chained(entries: DataFrame, key: str, order: str, content: Sequence[str]) -> DataFrame:
    """entries with position (from 0 in each key), prior_sha256 and sha256: each entry's hash covers its position, content and the hash before it.

    The only thing that is folded in order is 32 bytes for each key: rows are dealt by key, sorted, and streamed, so a long history needs
    no memory; it is one task's work, as a chain has to be. Nothing else (chain_problems) is sequential.
    """
    columns = ["position", "prior_sha256", "sha256"]
    rows = entries.withColumn("_content", canonical_text(*content)).repartition(key).sortWithinPartitions(key, order)
    names = entries.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, position, prior = object(), 0, GENESIS
        for b in batches:
            made: tuple[list, list, list] = ([], [], [])
            for k, text in zip(b.column(key).to_pylist(), b.column("_content").to_pylist(), strict=True):
                position, prior, at = (position + 1, prior, at) if k == at else (0, GENESIS, k)
                own = hashlib.sha256(f"{prior}|{position}|{text}".encode()).hexdigest()
                for column, value in zip(made, (position, prior, own), strict=True):
                    column.append(value)
                prior = own
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())], names=[*names, *columns])

    return rows.mapInArrow(fold, f"{types}, position long, prior_sha256 string, sha256 string")


def chain_heads(chain: DataFrame, key: str) -> DataFrame:
    """The last entry of each chain: length and head_sha256, to be kept elsewhere, as a chain alone can't tell that its end was cut off."""
    return chain.groupBy(key).agg((F.max("position") + 1).alias("length"), F.max_by("sha256", "position").alias("head_sha256"))


def chain_problems(chain: DataFrame, key: str, content: Sequence[str], heads: DataFrame | None = None) -> DataFrame:
    """key, position, problem: content (an entry doesn't match its own hash), link (it doesn't follow the one before it), gap (there is none before it),
    repeated (a position is there twice), and with the heads that were kept, head (the last entry is another) or lost (the chain is gone).

    Every entry is checked by itself and against its stored predecessor, joined on key and position, so a long chain spreads over all tasks.
    """
    own = F.sha2(F.concat_ws("|", "prior_sha256", F.col("position").cast("string"), canonical_text(*content)), 256)
    here = chain.select(key, "position", "prior_sha256", "sha256", (~F.col("sha256").eqNullSafe(own)).alias("changed"))
    before = chain.groupBy(key, (F.col("position") + 1).alias("position")).agg(F.min("sha256").alias("before"), F.count("*").alias("n"))
    joined = here.join(before.select(key, "position", "before"), [key, "position"], "left")
    first = F.col("position") == 0
    wrong = reasons({
        "content": F.col("changed"),
        "link": F.when(first, F.col("prior_sha256") != GENESIS).otherwise(F.col("before").isNotNull() & (F.col("prior_sha256") != F.col("before"))),
        "gap": ~first & F.col("before").isNull(),
    })
    found = joined.select(key, "position", F.explode(wrong).alias("problem")).distinct()
    twice = before.filter("n > 1").select(key, (F.col("position") - 1).alias("position"), F.lit("repeated").alias("problem"))
    out = found.unionByName(twice)
    if heads is not None:
        now = chain_heads(chain, key).withColumnsRenamed({"length": "l", "head_sha256": "h"})
        compared = heads.join(now, key, "left")
        differs = F.when(F.col("l").isNull(), "lost").when(~F.col("h").eqNullSafe(F.col("head_sha256")) | (F.col("l") != F.col("length")), "head")
        out = out.unionByName(compared.select(key, (F.col("length") - 1).alias("position"), differs.alias("problem")).filter("problem IS NOT NULL"))
    return out


def contract_breaks(states: DataFrame, contract: DataFrame, key: str, pinned: Sequence[str]) -> DataFrame:
    """States (by key) that a resumed run may not go on with, each with the pinned fields that differ from the contract's, in order; "unknown" without a contract."""
    terms = contract.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in pinned), F.lit(True).alias("_known"))
    joined = states.join(terms, states[key] == terms["_key"], "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    wrong = reasons({"unknown": ~known, **{c: known & ~states[c].eqNullSafe(F.col(f"_{c}")) for c in pinned}})
    return joined.select(states[key], wrong.alias("broken")).filter(F.size("broken") > 0)


def ledger_inconsistencies(ledger: DataFrame, rounds: DataFrame) -> DataFrame:
    """campaign and the broken rules of its ledger(campaign, total_budget, charged_total, remaining, n_revealed) and rounds(campaign, round, charged, budget):
    total, revealed, negative_round, rounds (their charges don't add up), over_round."""
    sums = rounds.groupBy("campaign").agg(F.sum("charged").alias("s"), F.min(F.least("charged", "budget")).alias("low"), F.max((F.col("charged") > F.col("budget")).cast("int")).alias("over"))
    wrong = reasons({
        "total": F.col("charged_total") + F.col("remaining") != F.col("total_budget"),
        "revealed": F.col("charged_total") != F.col("n_revealed"),
        "negative_round": F.coalesce(F.col("low"), F.lit(0)) < 0,
        "rounds": F.coalesce(F.col("s"), F.lit(0)) != F.col("charged_total"),
        "over_round": F.coalesce(F.col("over"), F.lit(0)) > 0,
    })
    return ledger.join(sums, "campaign", "left").select("campaign", wrong.alias("broken")).filter(F.size("broken") > 0)
