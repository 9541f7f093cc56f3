"""Outcome signals of work units, and reports beyond the shipped views: cache use, cohorts, limit episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.pricing import current
from ..functions.text import record_text, self_correction
from .enrich import ordinal
from .prompts import boundaries, latest
from .scan import Sizes, apart, previous, sizes

#: Files edited so often are thrashed; corrections that count; prompts back that a prompt is compared with; percent of words that make it a restatement.
THRASH, CORRECTIONS, PROMPTS_BACK, ALIKE = 4, 2, 5, 80
#: Accuracy of the cohorts' quantile sketches: a rank is off by one in so many at most.
ACCURACY = 10_000


def cache_efficiency(calls: DataFrame) -> DataFrame:
    """For each pool and model: tokens by class and how many of a thousand prompt tokens came from the cache."""
    sums = calls.groupBy("allowance_pool", "model").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens")])
    return sums.withColumn("cached_per_mille", F.expr("(1000 * cache_read_tokens) div nullif(input_tokens + cache_write_tokens + cache_read_tokens, 0)"))


def cohorts(units: DataFrame, classes: DataFrame, excess: float = 1.5) -> DataFrame:
    """Work units with the 75th percentile of turns of their (activity, work type), and
    whether they have more than ``excess`` times as many."""
    rows = units.select("id", "turns").join(classes.where("unit_grain = 'work_unit'").select(F.col("unit_id").alias("id"), "ai_activity", "work_type"), "id")
    p75 = rows.groupBy("ai_activity", "work_type").agg(F.expr("percentile(turns, 0.75)").alias("p75_turns"))
    return rows.join(p75, ["ai_activity", "work_type"]).withColumn("turn_excess", F.col("turns") > excess * F.col("p75_turns"))


def limit_episodes(calls: DataFrame, quiet_minutes: int = 60) -> DataFrame:
    """Rate-limit hits of a pool, joined to one episode while no longer apart than ``quiet_minutes``."""
    hits = calls.where("error_kind = 'rate_limit'").select("allowance_pool", "session", "started_at", F.unix_micros(F.try_to_timestamp("started_at")).alias("at"))
    order = Window.partitionBy("allowance_pool", "session").orderBy("at", "started_at")
    new = F.coalesce(F.col("at") - F.lag("at").over(order) > quiet_minutes * 60_000_000, F.lit(True))
    marked = hits.withColumn("new", new.cast("int")).withColumn("episode", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("allowance_pool", "session", "episode").agg(F.count("*").alias("hits"), F.min("started_at").alias("first_hit"), F.max("started_at").alias("last_hit"))


#: What a limit says: which, and when it ends, on the wall clock of a zone; the date is left out for short ones.
RESET = r"hit your (\w+) limit.*?resets (?:([A-Z][a-z]{2}) (\d{1,2})(?:,| at)? )?(\d{1,2})(?::(\d{2}))?(am|pm) \(([A-Za-z_/+-]+)\)"


def limit_resets(records: DataFrame) -> DataFrame:
    """Limits by what they say about their end: limit, resets_at (microseconds), hits, sessions, first_hit, last_hit. One
    limit strikes all live sessions, so hits that name the same end are one. A time without a date is its next
    occurrence after the hit. Hits that name no end (or an unknown zone) are one row for each session, limit
    ``unstated``, without resets_at."""
    spark = records.sparkSession
    zones = sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray() if z != "SystemV")
    hits = records.where("type = 'assistant' and error_kind = 'rate_limit'").select("session", "ts", F.try_to_timestamp("ts").alias("at"), record_text(F.col("is_text"), F.col("text"), F.col("blocks")).alias("said"))
    part = lambda n: F.regexp_extract("said", RESET, n)
    read = hits.select("session", "ts", "at", *[part(n).alias(c) for n, c in enumerate(("limit", "month", "day", "hour", "minute", "half", "zone"), 1)])
    known = F.col("at").isNotNull() & F.col("zone").isin(*zones) & F.col("hour").try_cast("int").between(1, 12) & (F.coalesce(F.col("minute").try_cast("int"), F.lit(0)) < 60)
    read = read.withColumn("zone", F.when(known, F.col("zone"))).withColumn("local", F.from_utc_timestamp("at", F.col("zone")))
    minutes = F.expr("(try_cast(hour as int) % 12 + if(half = 'pm', 12, 0)) * 60 + coalesce(try_cast(minute as int), 0)")
    clock = lambda day: day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    today = clock(F.to_date("local"))
    named = lambda year: clock(F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), "month", "day"), F.lit("yyyy MMM d")).cast("date"))
    this, following = named(F.year("local")), named(F.year("local") + 1)
    now = F.col("local").cast("timestamp_ntz")
    end = F.when(F.col("month") != "", F.when(this >= now, this).otherwise(following)).otherwise(F.when(today > now, today).otherwise(today + F.expr("interval 1 day")))
    ended = read.withColumn("resets_at", F.unix_micros(F.to_utc_timestamp(end.cast("timestamp"), F.col("zone"))))
    stated = F.col("resets_at").isNotNull()
    keyed = ended.select(F.when(stated, F.col("limit")).otherwise("unstated").alias("limit"), "resets_at", F.when(~stated, F.col("session")).alias("alone"), "session", "ts")
    return keyed.groupBy("limit", "resets_at", "alone").agg(F.count("*").alias("hits"), F.count_distinct("session").alias("sessions"), F.min("ts").alias("first_hit"), F.max("ts").alias("last_hit")).drop("alone")


def headroom(calls: DataFrame, verdicts: DataFrame, rates: DataFrame) -> DataFrame:
    """For each Overprovisioned verdict what a cheaper tier would have saved of its pool: value_e8, repriced_e8, reclaimable_e8 and its
    parts per million of the pool's whole use. Calls above the expected tier are priced anew by the dearest rates of that tier in
    the pool. It is an upper bound: it takes for granted that the cheaper model needs as many tokens."""
    over = verdicts.where("justification = 'Overprovisioned'").select("work_unit_id", "allowance_pool", "expected_tier")
    cents = ("in_cents", "out_cents", "write_cents", "read_cents")
    tiers = current(rates).where("billable").groupBy(F.col("tier").alias("expected_tier"), F.col("pool").alias("allowance_pool")).agg(*[F.max(c).alias(c) for c in cents])
    used = calls.where(F.col("billable") & F.col("model_tier").isin(*C.TIERS)).join(over, ["work_unit_id", "allowance_pool"]).join(F.broadcast(tiers), ["expected_tier", "allowance_pool"])  # a row a tier and pool
    anew = F.expr("input_tokens * in_cents + output_tokens * out_cents + cache_write_tokens * write_cents + cache_read_tokens * read_cents")
    priced = F.when(ordinal(F.col("model_tier")) > ordinal(F.col("expected_tier")), F.least(anew, F.col("value_e8"))).otherwise(F.col("value_e8"))
    sums = used.groupBy("work_unit_id", "allowance_pool", "expected_tier").agg(F.sum("value_e8").alias("value_e8"), F.sum(priced).alias("repriced_e8"))
    pools = calls.groupBy("allowance_pool").agg(F.sum("value_e8").alias("pool_e8"))
    out = sums.join(pools, "allowance_pool").withColumn("reclaimable_e8", F.col("value_e8") - F.col("repriced_e8"))
    share = F.expr("cast(cast(reclaimable_e8 as decimal(28, 0)) * 1000000 div nullif(pool_e8, 0) as long)")
    return out.select("work_unit_id", F.col("allowance_pool").alias("headroom_pool"), "expected_tier", "value_e8", "repriced_e8", "reclaimable_e8", share.alias("share_ppm"), F.lit(True).alias("upper_bound"))


def user_marks(records: DataFrame, calls: DataFrame, known: Sizes | None = None) -> DataFrame:
    """For each work unit: failed tool results, interruptions, and the turn after which the last of these came. A
    user's record belongs to the last turn that is not later."""
    prose = record_text(F.col("is_text"), F.col("text"), F.col("blocks"))
    failed = F.coalesce(F.size(F.filter("blocks", lambda b: (b["type"] == "tool_result") & b["is_error"])), F.lit(0))
    rows = records.where("type = 'user' and session is not null and session <> ''").select("session", "ts", F.greatest(failed, F.lit(0)).alias("errors"), F.startswith(prose, F.lit(C.INTERRUPTED)).alias("interrupted"))
    placed = latest(rows.where("errors > 0 or interrupted"), calls, "idx", "work_unit_id", known=known).where("idx is not null")
    return placed.groupBy("work_unit_id").agg(F.sum("errors").alias("tool_errors"), F.count_if("interrupted").alias("user_interrupted"), F.max(F.when(F.col("interrupted"), F.col("idx"))).alias("interrupted_at"))


def escalations(calls: DataFrame, known: Sizes | None = None) -> DataFrame:
    """How often a work unit's billable calls, without sidechains, went on with a higher tier."""
    keys = ["session"] if known else []
    used = calls.where(F.col("billable") & ~F.col("sidechain") & F.col("model_tier").isin(*C.TIERS)).select(*keys, "work_unit_id", "idx", ordinal(F.col("model_tier")).alias("rank"))
    whole = lambda rows: rows.withColumn("before", F.lag("rank").over(Window.partitionBy("work_unit_id").orderBy("idx")))
    cut = lambda rows: previous(rows, "rank", "before", "idx", "work_unit_id")
    # a unit is part of a session: where sessions' sizes are known, units need no count of their own
    pairs = apart(known, whole, cut, used) if known else apart(sizes(used, by="work_unit_id"), whole, cut, used, by="work_unit_id")
    return pairs.withColumn("up", F.expr("rank > before")).groupBy("work_unit_id").agg(F.count_if("up").alias("model_escalated"))


def restatements(records: DataFrame, prompts: DataFrame, back: int = PROMPTS_BACK, alike: int = ALIKE, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame, known: Sizes | None = None) -> DataFrame:
    """For each work unit: prompts that correct, and prompts that repeat one of the ``back`` prompts before them
    (``alike`` percent of the distinct words of both together). Prompts meet by blocks of
    ``back`` ordinals of a session, so a prompt meets a bounded number of others however long a session is."""
    said = boundaries(records, said=True, known=known).withColumn("id", F.concat_ws(":", "session", F.lit("prompt"), "prompt")).join(prompts.select("id", "work_unit_id"), "id")
    words = F.array_distinct(F.filter(F.split(F.lower("said"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    rows = hold(said.select("work_unit_id", "prompt", "said")).select("work_unit_id", "prompt", self_correction(F.col("said")).alias("corrects"), F.when(~F.startswith("said", F.lit(C.INTERRUPTED)), words).alias("words"))
    spoken = rows.where(F.size("words") > 0)
    block = F.expr(f"prompt div {back}")
    earlier = spoken.select("work_unit_id", F.col("prompt").alias("other"), F.col("words").alias("others"), F.explode(F.array(block, block + 1)).alias("block"))
    met = spoken.withColumn("block", block).join(earlier, ["work_unit_id", "block"]).where(f"other < prompt and other >= prompt - {back}")
    again = met.where(100 * F.size(F.array_intersect("words", "others")) >= alike * F.size(F.array_union("words", "others"))).select("work_unit_id", "prompt").distinct().withColumn("again", F.lit(True))
    return rows.join(again, ["work_unit_id", "prompt"], "left").groupBy("work_unit_id").agg(F.count_if("corrects").alias("corrective_turns"), F.count_if("again").alias("prompt_restated"))


def signals(records: DataFrame, calls: DataFrame, work: DataFrame, prompts: DataFrame, tools: DataFrame, classes: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame, known: Sizes | None = None) -> DataFrame:
    """A row for each work unit: what it took, the thresholds of its cohort (activity, work type) and the signals that
    ``fired``, in their fixed order. Thresholds are 75th percentiles by mergeable sketches: exact for cohorts
    of up to ACCURACY units, one rank in ACCURACY off beyond. No tool call: no error rate."""
    owned = tools.where("work_unit_id is not null")
    edits = owned.where(F.col("tool_name").isin(*C.EDIT_TOOLS) & (F.col("target") != "")).groupBy("work_unit_id", "target").count().groupBy("work_unit_id").agg(F.max("count").alias("edit_thrash"))
    done = F.col("tool_name").isin(*C.EDIT_TOOLS) | ((F.col("tool_name") == "Bash") & (F.col("target") == "git"))
    used = owned.groupBy("work_unit_id").agg(F.count("*").alias("tool_calls"), F.bool_or(done).alias("completed"))
    rows = work.select(F.col("id").alias("work_unit_id"), "turns", "end_turn").join(classes.where("unit_grain = 'work_unit'").select(F.col("unit_id").alias("work_unit_id"), "ai_activity", "work_type"), "work_unit_id")
    for more in (used, edits, user_marks(records, calls, known), escalations(calls, known), restatements(records, prompts, hold=hold, known=known)):
        rows = rows.join(more, "work_unit_id", "left")
    counts = ("tool_calls", "tool_errors", "edit_thrash", "user_interrupted", "model_escalated", "corrective_turns", "prompt_restated")
    rows = rows.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "completed": F.coalesce("completed", F.lit(False))})
    rows = rows.withColumn("tool_error_ppm", F.expr("(1000000 * tool_errors) div nullif(tool_calls, 0)"))
    rows = hold(rows)  # for the thresholds and for the signals
    p75 = lambda c: F.percentile_approx(c, 0.75, ACCURACY).alias(f"p75_{c}")
    cohorts = rows.groupBy("ai_activity", "work_type").agg(p75("turns"), p75("tool_error_ppm"))
    rows = rows.join(F.broadcast(cohorts), ["ai_activity", "work_type"])  # a row for each fixed activity and work type
    fired = [
        F.when(2 * F.col("turns") > 3 * F.col("p75_turns"), "turn_excess"), F.when(F.col("tool_error_ppm") > F.col("p75_tool_error_ppm"), "tool_error_rate"), F.when(F.col("edit_thrash") >= THRASH, "edit_thrash"),
        F.when(F.col("model_escalated") > 0, "model_escalated"), F.when(F.col("corrective_turns") >= CORRECTIONS, "corrective_turns"), F.when(F.col("prompt_restated") > 0, "prompt_restated"),
        F.when((F.col("interrupted_at") == F.col("end_turn")) & ~F.col("completed"), "abandoned"),
    ]
    return rows.withColumn("fired", F.filter(F.array(*fired), lambda x: x.isNotNull())).select("work_unit_id", "ai_activity", "work_type", "turns", *counts, "tool_error_ppm", "completed", "p75_turns", "p75_tool_error_ppm", "fired")
