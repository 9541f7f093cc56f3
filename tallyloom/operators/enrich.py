"""Signals, classification, tier votes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import complexity, json_list


def signals(turns: Column, files: Column, debug: Column, correction: Column, subagents: Column, tests: Column) -> Column:
    """The names of the signals that fire, in their fixed order."""
    fired = [
        F.when(files >= C.MIN_DISTINCT_FILES, "distinct_files"), F.when(turns >= C.MIN_TURNS, "turn_count"), F.when(debug, "debugging_language"),
        F.when(correction, "self_correction"), F.when(subagents > 0, "subagent_use"), F.when(tests >= C.MIN_TEST_RUNS, "repeated_test_runs"),
    ]
    return F.filter(F.array(*fired), lambda x: x.isNotNull())


def tool_counts(calls: DataFrame, *keys: str) -> DataFrame:
    """What the rules read of the tool calls of each key: counted by target first, so that distinct targets are rows."""
    path = F.contains("target", F.lit("/"))
    count = lambda cond, name: F.count_if(cond).alias(name)
    web = F.col("tool_name").isin(*C.WEB_TOOLS)
    by_target = calls.groupBy(*keys, "target").agg(
        F.count("*").alias("tool_calls"), count(F.col("tool_name") == "Bash", "bash_calls"), count(F.col("tool_name").isin(*C.EDIT_TOOLS), "edit_calls"),
        count(F.col("tool_name").isin(*C.SUBAGENT_TOOLS), "subagent_calls"), count(~web, "other_calls"), count(F.col("tool_name").isin(*C.HANDS), "hand_calls"),
    )
    total = lambda name: F.sum(name).alias(name)
    return by_target.groupBy(*keys).agg(
        total("tool_calls"), total("bash_calls"), total("edit_calls"), total("subagent_calls"), F.sum(F.when(F.col("target").isin(*C.TEST_VERBS), F.col("tool_calls")).otherwise(0)).alias("test_runs"),
        count(path, "distinct_files"), count(path & (F.col("other_calls") > 0), "signal_files"),
        (F.sum("hand_calls") > 0).alias("hands"), F.coalesce(F.bool_or(risky_target(F.col("target"))), F.lit(False)).alias("risky"),
    )


def risky_target(target: Column) -> Column:
    """Whether a target's suffix or path segment marks risk."""
    risky, low = F.array(*[F.lit(x) for x in C.HIGH_STAKES_SEGMENTS]), F.lower(target)
    segments = F.split(low, "/")
    bare = F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]*$", ""))
    return F.endswith(low, F.lit(C.HIGH_STAKES_SUFFIXES[0])) | F.endswith(low, F.lit(C.HIGH_STAKES_SUFFIXES[1])) | F.arrays_overlap(segments, risky) | F.arrays_overlap(bare, risky)


def risky_name(skill: Column) -> Column:
    """Whether a part of a skill's name marks risk."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(skill, F.lit(""))), "_", "-"), "-")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in C.HIGH_STAKES_SEGMENTS]))


def prompt_scores(units: DataFrame, calls: DataFrame) -> DataFrame:
    """Prompt units with the signals that fire and the score."""
    counted = tool_counts(calls.where("prompt_unit_id is not null"), "prompt_unit_id").withColumnRenamed("prompt_unit_id", "id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fired = signals(F.col("turns"), zero("signal_files"), F.col("has_debug_language"), F.col("has_self_correction"), zero("subagent_calls"), zero("test_runs"))
    return units.join(counted, "id", "left").withColumn("fired", fired).select(*units.columns, "fired", F.size("fired").alias("score"))


def best_prompts(calls: DataFrame, scored: DataFrame) -> DataFrame:
    """For each work unit the signals of its highest prompt that it overlaps (the first on ties), and how many prompts
    overlap it. Units and prompts are runs of a session's turns, so two overlap where they share a call."""
    met = calls.where("prompt_unit_id is not null").select("work_unit_id", "prompt_unit_id").distinct()
    spans = scored.select(F.col("id").alias("prompt_unit_id"), F.col("start_turn").alias("p_start"), "fired", "score")
    best = F.max_by(F.struct("fired", "score"), F.struct("score", (-F.col("p_start")).alias("early"))).alias("best")
    return met.join(spans, "prompt_unit_id").groupBy("work_unit_id").agg(best, F.count("*").alias("prompt_units")).select(F.col("work_unit_id").alias("id"), "best.fired", "best.score", "prompt_units")


def classified(work: DataFrame, best: DataFrame, calls: DataFrame, activities: dict[str, str]) -> DataFrame:
    """A classification for each work unit; without a prompt it is Unscored, never 0."""
    counted = tool_counts(calls.where("work_unit_id is not null"), "work_unit_id").select(F.col("work_unit_id").alias("id"), "hands", "risky")
    known = F.create_map(*[F.lit(x) for k, v in activities.items() if v in C.ACTIVITIES for x in (k, v)]) if activities else F.create_map().cast("map<string,string>")
    rows = work.join(best, "id", "left").join(counted, "id", "left")
    scored = F.col("prompt_units").isNotNull()  # as the score is
    kind = F.when(~scored | F.col("anchor_skill").isNotNull() | F.coalesce("hands", F.lit(False)), "Agentic").otherwise("Retrieval")
    rule = '{"ai_activity": "rule", "work_type": "rule", "task_complexity": "rule", "stakes": "rule"}'
    return rows.select(
        F.col("id").alias("unit_id"), F.lit("work_unit").alias("unit_grain"), F.lit(C.CLASSIFIER_VERSION).alias("classifier_version"),
        F.coalesce(F.when(F.col("anchor_skill").isNotNull(), known[F.col("anchor_skill")]), F.lit("other")).alias("ai_activity"), kind.alias("work_type"),
        F.when(scored, complexity(F.col("score"))).otherwise("Unscored").alias("task_complexity"),
        F.when(scored & (F.coalesce("risky", F.lit(False)) | risky_name(F.col("anchor_skill"))), "high").otherwise("routine").alias("stakes"),
        F.col("score").cast("int").alias("complexity_score"), json_list(F.coalesce("fired", F.array().cast("array<string>"))).alias("signals"),
        F.when(scored, 0.5).otherwise(0.0).alias("confidence"), F.when(scored, rule).otherwise('{"task_complexity": "unscored"}').alias("provenance"), "prompt_units",
    )


def classified_prompts(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("id").alias("unit_id"), F.lit("prompt_unit").alias("unit_grain"), F.lit(C.CLASSIFIER_VERSION).alias("classifier_version"), F.lit("other").alias("ai_activity"),
        F.lit("Agentic").alias("work_type"), complexity(F.col("score")).alias("task_complexity"), F.lit("routine").alias("stakes"), F.col("score").cast("int").alias("complexity_score"),
        json_list(F.col("fired")).alias("signals"), F.lit(0.5).alias("confidence"), F.lit('{"task_complexity": "rule"}').alias("provenance"),
    )


def ordinal(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in C.TIERS]), tier).cast("int") - 1


def tier_votes(calls: DataFrame) -> DataFrame:
    """For each work unit and pool the tier of most value (then calls, then rank), and the highest used."""
    known = calls.where(F.col("billable") & F.col("model_tier").isin(*C.TIERS) & F.col("work_unit_id").isNotNull())
    per = known.groupBy("work_unit_id", "allowance_pool", "model_tier").agg(F.sum("value_e8").alias("value"), F.count("*").alias("n")).withColumn("rank", ordinal(F.col("model_tier")))
    return per.groupBy("work_unit_id", "allowance_pool").agg(F.max_by("model_tier", F.struct("value", "n", "rank")).alias("used_tier"), F.max_by("model_tier", "rank").alias("max_tier"))


def expected_tier(work_type: Column, complexity_: Column, stakes: Column) -> Column:
    matrix = F.create_map(*[F.lit(x) for (w, c), t in C.TIER_MATRIX.items() for x in (f"{w}/{c}", t)])
    rank = ordinal(matrix[F.concat(work_type, F.lit("/"), complexity_)]) + F.when(stakes == "high", 1).otherwise(0)
    return F.array(*[F.lit(t) for t in C.TIERS])[F.least(rank, F.lit(2))]


def decide(complexity_: Column, stakes: Column, delta: Column, under: Column) -> Column:
    """The verdict of a tier difference; two under-provisioning signals override it."""
    return (
        F.when(under >= 2, "Underprovisioned").when((delta >= 2) | ((delta == 1) & (complexity_ == "Low")), "Overprovisioned").when(delta == 1, "Acceptable")
        .when(delta == 0, "Justified").when(stakes == "high", "Acceptable (high stakes)").otherwise("Acceptable")
    )


def verdicts(classes: DataFrame, votes: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """A verdict for each scored work unit and pool that has a billable call. With outcome
    signals two of them say Underprovisioned, and the evidence names them; without, no unit can be
    Underprovisioned, and the evidence says so."""
    rows = classes.where("task_complexity <> 'Unscored'").join(votes, F.col("unit_id") == F.col("work_unit_id")).withColumn("expected_tier", expected_tier(F.col("work_type"), F.col("task_complexity"), F.col("stakes")))
    rows = rows.withColumn("tier_delta", ordinal(F.col("used_tier")) - ordinal(F.col("expected_tier")))
    if outcomes is None:
        under, last = F.lit(0), F.lit('"underprovisioned_unreachable": true')
    else:
        rows = rows.join(outcomes.select("work_unit_id", F.col("fired").alias("outcome")), "work_unit_id", "left")
        rows = rows.withColumn("outcome", F.coalesce("outcome", F.array().cast("array<string>")))
        under, last = F.size("outcome"), F.concat(F.lit('"outcome_signals": '), json_list(F.col("outcome")))
    said = decide(F.col("task_complexity"), F.col("stakes"), F.col("tier_delta"), under)
    evidence = F.format_string('{"signals": %s, "score": %d, "prompt_units": %d, %s}', "signals", "complexity_score", "prompt_units", last)
    return rows.select("work_unit_id", F.lit(C.RULES_VERSION).alias("rules_version"), "allowance_pool", said.alias("justification"), "expected_tier", "used_tier", "max_tier", "tier_delta", evidence.alias("evidence"))
