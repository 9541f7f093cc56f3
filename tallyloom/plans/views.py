"""The catalogue of views over a ledger's tables. Values are notional list value, pools
never sum, and every classification is provisional."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PROVISIONAL, VALUE_LABEL
from ..functions.text import rounded, usd
from ..operators.enrich import tool_counts
from .ledger import Ledger

#: caveat, summary, detail
CAVEATS = (
    ("no_headroom", "Every dollar figure is notional list value, not money billed", "Seats are subscriptions; no view shows headroom, as a pool's capacity is known only where a limit has struck, and then roughly."),
    ("no_underprovisioned", "The verdict Underprovisioned is not given", "Unless outcome signals are asked for; as it overrides all others, without them every number leans towards over-provisioned."),
    ("provisional_classification", "Every classification is provisional and must not be acted on", "The classifier is a deterministic heuristic that no gold set has validated."),
    ("work_type_partial", "Synthesis and Reasoning are never assigned", "Anchored arcs are Agentic by rule; see the work type distribution before reading a verdict."),
    ("score_zero_gap", "The share of score 0 differs from the hand-read figure", "The gap is reported; the thresholds were not adjusted to close it."),
    ("language_threshold_is_judgement", "Two of the six signals rest on a threshold nobody measured", "They fire when a quarter of a unit's turns use the vocabulary."),
    ("unscored_arcs", "Arcs without a prompt unit are left unscored", "They get no verdict; a score of 0 would make missing evidence read as over-provisioned."),
    ("upper_bound", "Any reclaimable figure is an upper bound", "It assumes that the cheaper model needs the same tokens."),
)
_WORK = "unit_grain = 'work_unit'"


def _classes(t: Ledger) -> DataFrame:
    return t.classification.where(_WORK).withColumnRenamed("unit_id", "id").drop("unit_grain")


def _verdicts(t: Ledger) -> DataFrame:
    return t.verdict.withColumnRenamed("work_unit_id", "id")


def caveats(t: Ledger) -> DataFrame:
    return t.work_unit.sparkSession.createDataFrame(CAVEATS, "caveat string, summary string, detail string")


def prompt_unit_value(t: Ledger) -> DataFrame:
    calls = t.api_call.select(F.col("prompt_unit_id").alias("id"), "allowance_pool", "value_e8")
    sums = calls.where("id is not null").groupBy("id", "allowance_pool").agg(F.sum("value_e8").alias("value_e8"), F.count("*").alias("api_calls"))
    return t.prompt_unit.select("id", "session", "work_unit_id", "repo", "turns").join(sums, "id").select(F.col("id").alias("prompt_unit_id"), "session", "work_unit_id", "repo", "turns", "allowance_pool", usd(F.col("value_e8")).alias("notional_list_value_usd"), "api_calls")


def activity_ledger(t: Ledger) -> DataFrame:
    """Verdicts are joined within their pool, so units of several pools are not repeated."""
    rows = t.work_unit.select("id", "allowance_pool", "value_e8").join(_classes(t), "id").join(_verdicts(t).select("id", "allowance_pool", "used_tier", "justification"), ["id", "allowance_pool"], "left")
    keys = ["ai_activity", "allowance_pool", "work_type", "task_complexity", "used_tier", "justification"]
    return rows.groupBy(*keys).agg(F.count_distinct("id").alias("work_units"), usd(F.sum("value_e8")).alias("notional_list_value_usd")).withColumn("classification_status", F.lit(PROVISIONAL))


def activity_other_share(t: Ledger) -> DataFrame:
    rows = t.work_unit.select("id", "allowance_pool", "value_e8").join(_classes(t).select("id", "ai_activity"), "id")
    other = F.sum(F.when(F.col("ai_activity") == "other", F.col("value_e8")).otherwise(0))
    sums = rows.groupBy("allowance_pool").agg(other.alias("other"), F.sum("value_e8").alias("total"))
    return sums.select("allowance_pool", usd(F.col("other")).alias("other_notional_list_value_usd"), usd(F.col("total")).alias("total_notional_list_value_usd"), _percent("other", "total").alias("other_pct"), F.lit(10.0).alias("review_threshold_pct"))


def _percent(part: str, whole: str):
    """A percentage with one decimal, rounded half up in whole numbers."""
    return F.expr(f"cast((2000 * {part} + {whole}) div nullif(2 * {whole}, 0) as double) / 10D")


def work_type_distribution(t: Ledger) -> DataFrame:
    rows = t.work_unit.select("id", "allowance_pool", "value_e8").join(_classes(t).select("id", "work_type", "provenance"), "id")
    return rows.groupBy("work_type", "provenance", "allowance_pool").agg(F.count("*").alias("work_units"), usd(F.sum("value_e8")).alias("notional_list_value_usd"))


def unattributable(t: Ledger) -> DataFrame:
    return t.work_unit.where("kind = 'unattributable'").select("session", "allowance_pool", "turns", "notional_list_value_usd", F.lit("work before a session first anchor, or a session with no anchor at all").alias("why"))


def routine_ledger(t: Ledger) -> DataFrame:
    rows = t.work_unit.where("kind = 'arc'").groupBy(F.col("anchor_skill").alias("routine"), "allowance_pool").agg(F.count("*").alias("runs"), F.sum("value_e8").alias("v"), F.sum("turns").alias("turns"))
    return rows.select("routine", "allowance_pool", "runs", usd(F.col("v")).alias("notional_list_value_usd"), rounded(F.expr("v div runs"), 2).alias("mean_per_run_notional_list_value_usd"), "turns")


def data_quality(t: Ledger) -> DataFrame:
    """Fifteen health figures, each from one aggregation over its table."""
    raw = t.raw_event.agg(F.count("*").alias("raw_events"), F.count_distinct("session_id").alias("sessions"), F.max("ingested_at").alias("last_ingest"))
    calls = t.api_call.agg(F.count("*").alias("api_calls"), F.count_if(F.col("model_tier") == "unknown").alias("calls_with_unknown_tier"), F.count_if(F.col("work_unit_id").isNull()).alias("orphaned_calls"), F.count_if(F.col("error_kind").isNotNull()).alias("error_records"), F.count_if(F.col("error_kind") == "rate_limit").alias("limit_hits"), F.max("started_at").alias("last_api_call"))
    units = t.work_unit.agg(F.count("*").alias("work_units"), F.count_if(F.col("parse_degraded") == 1).alias("degraded_work_units"))
    latest = t.normalize_run.orderBy(F.desc("run_id")).limit(1) if "run_id" in t.normalize_run.columns else t.normalize_run
    run = latest.select(F.col("parse_failures").alias("parse_failures_last_run"), F.col("unscored_arcs").alias("unscored_arcs_last_run"), F.col("unknown_models").alias("unknown_models_last_run"), F.col("ran_at").alias("last_normalize"))
    return raw.crossJoin(calls).crossJoin(units).crossJoin(run)  # one row each


def unscored_arcs(t: Ledger) -> DataFrame:
    rows = t.work_unit.join(t.unscored, "id")
    return rows.select("id", "session", "anchor_skill", "project_family", "turns", "allowance_pool", "notional_list_value_usd", F.lit("no prompt unit covers this arc").alias("why"))


def work_unit_ledger(t: Ledger) -> DataFrame:
    rows = t.work_unit.join(_classes(t), "id").join(_verdicts(t), ["id", "allowance_pool"], "left")
    return rows.select("id", "ai_activity", F.col("anchor_skill").alias("routine"), "project_family", "kind", "turns", "task_complexity", "complexity_score", "signals", "justification", "expected_tier", "used_tier", "max_tier", "tier_delta", "allowance_pool", "notional_list_value_usd", F.lit(PROVISIONAL).alias("classification_status"), F.lit(VALUE_LABEL).alias("value_label"))


def work_unit_shape(t: Ledger) -> DataFrame:
    """Counts of each unit: one aggregation of its tools and one of its calls, joined."""
    names = ["tool_calls", "bash_calls", "edit_calls", "subagent_calls", "distinct_files"]
    tools = tool_counts(t.tool_call.where("work_unit_id is not null"), "work_unit_id").select(F.col("work_unit_id").alias("id"), *names)
    calls = t.api_call.groupBy(F.col("work_unit_id").alias("id")).agg(F.count_if("is_sidechain").alias("sidechain_calls"), F.count_if(F.col("error_kind") == "rate_limit").alias("rate_limit_hits"), F.count_distinct("model").alias("distinct_models"))
    micros = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c)))
    minutes = F.round((micros("ended_at") - micros("started_at")) / F.lit(6e7)).cast("long")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in [*names, "sidechain_calls", "rate_limit_hits", "distinct_models"]]
    return t.work_unit.join(tools, "id", "left").join(calls, "id", "left").select("id", "session", "kind", "anchor_skill", "project_family", "repo", "git_branch_kind", "turns", "started_at", "ended_at", minutes.alias("elapsed_minutes"), *zero, "allowance_pool", "value_e8", "notional_list_value_usd")


def work_unit_verbs(t: Ledger) -> DataFrame:
    counts = t.tool_call.where("tool_name = 'Bash' and target is not null and target <> 'other' and work_unit_id is not null").groupBy("work_unit_id", "target").agg(F.count("*").alias("n"))
    order = Window.partitionBy("work_unit_id").orderBy(F.desc("n"), "target")
    top = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return top.groupBy("work_unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]), "/").alias("top_verbs"))


def _lines(t: Ledger) -> DataFrame:
    """The shape of each unit, with its line."""
    shape = work_unit_shape(t).join(work_unit_verbs(t).withColumnRenamed("work_unit_id", "id"), "id", "left")
    m = F.col("elapsed_minutes")
    span = F.when(m.isNull(), "unknown span").when(m < 60, F.concat(m, F.lit("m"))).when(m < 2880, F.concat(F.expr("elapsed_minutes div 60"), F.lit("h"))).otherwise(F.concat(F.expr("elapsed_minutes div 1440"), F.lit("d")))
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.lit(" · "), F.col(c), F.lit(word))).otherwise("")
    head = F.when(F.col("kind") == "unattributable", "unattributed work in this session").otherwise(F.coalesce("anchor_skill", F.lit("untagged work")))
    verbs = F.when(F.col("top_verbs").isNotNull(), F.concat(F.lit(" ("), "top_verbs", F.lit(")"))).otherwise("")
    line = F.concat(head, F.lit(" · "), span, F.lit(" · "), F.col("turns"), F.lit(" turns"), part("bash_calls", " bash"), verbs, part("edit_calls", " edits"), part("distinct_files", " files"), part("subagent_calls", " subagents"), F.when(F.col("rate_limit_hits") > 0, " · HIT LIMIT").otherwise(""))
    return shape.withColumn("summary", line)


def work_unit_summary(t: Ledger) -> DataFrame:
    rows = _lines(t).join(_classes(t).select("id", "ai_activity", "task_complexity"), "id", "left").join(_verdicts(t).select("id", "allowance_pool", "justification"), ["id", "allowance_pool"], "left")
    return rows.select("id", F.coalesce("anchor_skill", F.lit("(no routine)")).alias("routine"), "ai_activity", "task_complexity", "justification", rounded(F.col("value_e8"), 2).alias("notional_list_value_usd"), "summary", "project_family", "git_branch_kind", "elapsed_minutes", "turns", "tool_calls", "distinct_files", "subagent_calls", "started_at", "allowance_pool", F.lit(PROVISIONAL).alias("classification_status"), F.lit(VALUE_LABEL).alias("value_label"))


def verdict_readable(t: Ledger) -> DataFrame:
    work = _lines(t).select("id", "anchor_skill", "value_e8", "project_family", "turns", "started_at", "summary")
    rows = _verdicts(t).join(work, "id").join(_classes(t).select("id", "ai_activity", "work_type", "task_complexity", "complexity_score", "signals"), "id", "left")
    used, wanted = F.concat(F.lit("used "), "used_tier"), F.col("expected_tier")
    cell = F.concat("work_type", F.lit("/"), "task_complexity")
    plural = F.when(F.col("tier_delta") == 1, "").otherwise("s")
    mild = F.when(F.col("tier_delta") > 0, F.concat(used, F.lit(" against an expected "), wanted, F.lit(" — a mild overshoot, not an overspend"))).otherwise(F.concat(used, F.lit(" below the expected "), wanted, F.lit(" and the work completed — a downgrade that worked")))
    j = F.col("justification")
    reason = (
        F.when(j == "Overprovisioned", F.concat(used, F.lit(" where "), cell, F.lit(" expects "), wanted, F.lit(" — "), F.col("tier_delta"), F.lit(" tier"), plural, F.lit(" above")))
        .when(j == "Justified", F.concat(used, F.lit(", which is exactly what "), cell, F.lit(" expects"))).when(j == "Acceptable", mild)
        .when(j == "Acceptable (high stakes)", F.concat(used, F.lit(" below the expected "), wanted, F.lit(" on HIGH-STAKES work — a risk flag for review, not a saving")))
        .when(j == "Underprovisioned", "two or more under-provisioning signals fired").otherwise(j)
    )
    plain = F.regexp_replace("signals", r'[\[\]"]', "")
    evidence = F.when(F.col("task_complexity") == "Unscored", "no prompt unit covers this arc — deliberately unscored").when(F.col("signals").isNull() | (F.col("signals") == "[]"), "no complexity signal fired (score 0 of 6)").otherwise(F.concat(F.lit("score "), F.coalesce("complexity_score", F.lit(0)), F.lit(" of 6: "), plain))
    return rows.select(F.coalesce("anchor_skill", F.lit("(no routine)")).alias("routine"), "ai_activity", j.alias("verdict"), F.col("summary").alias("what_happened"), reason.alias("reasoning"), evidence.alias("evidence"), rounded(F.col("value_e8"), 2).alias("notional_list_value_usd"), "expected_tier", "used_tier", "max_tier", "tier_delta", "project_family", "turns", "allowance_pool", "started_at", "rules_version", F.lit(PROVISIONAL).alias("classification_status"), F.lit(VALUE_LABEL).alias("value_label"), F.lit("Underprovisioned is never emitted by this slice — see v_caveats").alias("known_gap"), F.col("id").alias("work_unit_id"))


def summary(t: Ledger) -> DataFrame:
    rows = t.work_unit.select("id", "allowance_pool", "turns", "value_e8").join(_classes(t).select("id", "ai_activity"), "id", "left").join(_verdicts(t).select("id", "allowance_pool", "justification"), ["id", "allowance_pool"], "left")
    over = F.col("justification") == "Overprovisioned"
    sums = rows.groupBy("allowance_pool", "ai_activity").agg(F.count("*").alias("work_units"), F.sum("turns").alias("turns"), F.sum("value_e8").alias("v"), F.count_if(over).alias("overprovisioned_units"), F.sum(F.when(over, F.col("value_e8")).otherwise(0)).alias("o"))
    sums = sums.withColumn("pool", F.sum("v").over(Window.partitionBy("allowance_pool")))
    return sums.select("allowance_pool", "ai_activity", "work_units", "turns", rounded(F.col("v"), 2).alias("notional_list_value_usd"), _percent("v", "pool").alias("pct_of_pool"), "overprovisioned_units", rounded(F.col("o"), 2).alias("overprovisioned_notional_usd"), F.lit("upper bound — assumes the cheaper tier finishes in the same tokens").alias("overprovisioned_caveat"), F.lit(VALUE_LABEL).alias("value_label"), F.lit(PROVISIONAL).alias("classification_status"))


#: view name -> (function, column to show first by, descending)
VIEWS: dict[str, tuple[Callable[[Ledger], DataFrame], str | None]] = {
    "v_caveats": (caveats, None), "v_prompt_unit_value": (prompt_unit_value, "notional_list_value_usd"), "v_activity_ledger": (activity_ledger, "notional_list_value_usd"),
    "v_activity_other_share": (activity_other_share, None), "v_work_type_distribution": (work_type_distribution, "notional_list_value_usd"), "v_unattributable": (unattributable, "notional_list_value_usd"),
    "v_routine_ledger": (routine_ledger, "notional_list_value_usd"), "v_data_quality": (data_quality, None), "v_unscored_arcs": (unscored_arcs, "notional_list_value_usd"),
    "v_work_unit_ledger": (work_unit_ledger, "notional_list_value_usd"), "v_work_unit_shape": (work_unit_shape, "notional_list_value_usd"), "v_work_unit_verbs": (work_unit_verbs, None),
    "v_work_unit_summary": (work_unit_summary, "notional_list_value_usd"), "v_verdict_readable": (verdict_readable, "notional_list_value_usd"), "v_summary": (summary, "notional_list_value_usd"),
}


#: view name -> (title, what it shows and how to read it)
ABOUT: dict[str, tuple[str, str]] = {
    "v_summary": ("Value by activity and pool", "A row for each activity of a pool. Pools are ceilings of their own and are never added up; what is over-provisioned is an upper bound, as the cheaper tier may need more tokens"),
    "v_verdict_readable": ("Verdicts in words", "What a unit did, why its verdict follows from the rule, and what its score is made of. Without outcome signals no unit can be Underprovisioned"),
    "v_work_unit_summary": ("Work units in a line each", "Span, turns, tools, most used verbs, files, subagents and limits. No prompt, file name or command is kept"),
    "v_caveats": ("What the figures don't show", "Known gaps. To be read before any other view"),
    "v_work_unit_ledger": ("Work units with their verdicts", "Activity, complexity, signals, tiers and value of each unit, by pool"),
    "v_work_unit_shape": ("Shape of work units", "Counts of tools, files, models, sidechains and limits of each unit"),
    "v_work_unit_verbs": ("Most used verbs", "Up to three command verbs of each unit, most used first, by name on ties"),
    "v_activity_ledger": ("Value by activity, work type and verdict", "A unit of several pools is judged in each of them once"),
    "v_activity_other_share": ("Share of unnamed activity", "How much of a pool's value no skill names; above a tenth the map of skills needs work"),
    "v_work_type_distribution": ("Work types and where they come from", "Rules name two of the four types only"),
    "v_unattributable": ("Work before a session's first anchor", "Turns that belong to no arc, with their value"),
    "v_routine_ledger": ("Routines", "Runs, value and mean value of each anchoring skill"),
    "v_prompt_unit_value": ("Prompts by value", "Turns, calls and value of each prompt, by pool"),
    "v_data_quality": ("Quality of the data", "Counts of records, calls and units, and of what could not be parsed, priced or scored in the last run"),
    "v_unscored_arcs": ("Arcs without a score", "No prompt covers them; they have no verdict"),
}


def catalogue(t: Ledger) -> DataFrame:
    """name, title, description, sort_desc and columns of each view."""
    rows = [(name, *ABOUT[name], by, view(t).columns) for name, (view, by) in VIEWS.items()]
    return t.work_unit.sparkSession.createDataFrame(rows, "name string, title string, description string, sort_desc string, columns array<string>")


def register(t: Ledger) -> None:
    """Tables and views as temporary views for SQL."""
    t.register()
    for name, (view, _) in VIEWS.items():
        view(t).createOrReplaceTempView(name)


def shown(t: Ledger, name: str) -> DataFrame:
    """A view in the order in which it is meant to be read."""
    view, by = VIEWS[name]
    return view(t).orderBy(F.desc(by)) if by else view(t)
