"""Use of allowance pools over trailing windows, and their capacities as far as limits show them.

A pool may have most of all calls, so no task takes a pool whole. Time is cut into steps:
calls are summed up to each instant within their (pool, step) only, steps are summed over a pool, which
has as many of them as time has, and a window is the difference of two such sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trailing windows in seconds.
WINDOWS = {"5h": 5 * 3600, "week": 7 * 86400}
STEP = 300


def trailing_use(calls: DataFrame, windows: dict[str, int] | None = None, step: int = STEP) -> DataFrame:
    """id, allowance_pool, at (microseconds), limited, value_e8 of each call with a time, and used_<window>_e8: the value of
    its pool's calls later than ``at`` less the window, up to ``at`` (all of the same instant included).
    Calls with an unreadable time have no window and are left out."""
    windows = WINDOWS if windows is None else windows
    timed = calls.select("id", "session", "turn_index", "allowance_pool", "value_e8", F.coalesce(F.col("error_kind") == "rate_limit", F.lit(False)).alias("limited"), F.unix_micros(F.try_to_timestamp("started_at")).alias("at")).where("at is not null")
    back = F.array(F.struct(F.lit("now").alias("w"), F.lit(0).cast("long").alias("us")), *[F.struct(F.lit(w).alias("w"), F.lit(s * 1_000_000).cast("long").alias("us")) for w, s in windows.items()])
    # a call asks for the sum up to its own instant and up to each window's start
    asked = timed.withColumn("b", F.explode(back)).select("session", "turn_index", "id", "allowance_pool", "limited", "value_e8", F.col("b.w").alias("w"), (F.col("at") - F.col("b.us")).alias("t"))
    asked = asked.withColumns({"step": F.expr(f"floor(t / {step * 1_000_000})"), "adds": F.when(F.col("w") == "now", F.col("value_e8")).otherwise(F.lit(0))})
    inside = Window.partitionBy("allowance_pool", "step").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = asked.groupBy("allowance_pool", "step").agg(F.sum("adds").alias("total"))
    upto = Window.partitionBy("allowance_pool").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.withColumn("before", F.coalesce(F.sum("total").over(upto), F.lit(0))).drop("total")
    sums = asked.withColumn("within", F.sum("adds").over(inside)).join(before, ["allowance_pool", "step"]).withColumn("sum", F.col("within") + F.col("before"))
    pick = lambda w: F.max(F.when(F.col("w") == w, F.col("sum")))
    out = sums.groupBy("session", "turn_index", "id", "allowance_pool", "limited", "value_e8").agg(F.max(F.when(F.col("w") == "now", F.col("t"))).alias("at"), *[(pick("now") - pick(w)).alias(f"used_{w}_e8") for w in windows])
    return out.drop("session", "turn_index")


def capacities(used: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """For each pool and window what limits show of its capacity: limit_hits, reached_e8 (the most in use when a limit
    was hit, null without one), passed_e8 (the most in use at a call that passed, so the capacity is
    no less) and capacity_e8, the larger of the two where a limit was hit, else null: then only
    shares of the period's total can be told, not shares of a ceiling."""
    windows = WINDOWS if windows is None else windows
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"used_{w}_e8").alias("used")) for w in windows])).alias("x")
    rows = used.select("allowance_pool", "limited", each).select("allowance_pool", "limited", "x.*")
    reached, passed = F.max(F.when(F.col("limited"), F.col("used"))), F.max(F.when(~F.col("limited"), F.col("used")))
    out = rows.groupBy("allowance_pool", "window").agg(F.count_if("limited").alias("limit_hits"), reached.alias("reached_e8"), passed.alias("passed_e8"))
    return out.withColumn("capacity_e8", F.when(F.col("reached_e8").isNotNull(), F.greatest("reached_e8", F.coalesce("passed_e8", "reached_e8"))))


def fitted(used: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """The limit events with the capacity as known at each: the running maximum of use at limits so far, by pool and window."""
    windows = WINDOWS if windows is None else windows
    order = Window.partitionBy("allowance_pool").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return used.where("limited").select("id", "allowance_pool", "at", *[f"used_{w}_e8" for w in windows], *[F.max(f"used_{w}_e8").over(order).alias(f"capacity_{w}_e8") for w in windows])


def shares(used: DataFrame, known: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Each call's use in parts per million of its pool's capacity, null where that isn't known."""
    windows = WINDOWS if windows is None else windows
    wide = known.groupBy("allowance_pool").agg(*[F.max(F.when(F.col("window") == w, F.col("capacity_e8"))).alias(f"c_{w}") for w in windows])
    rows = used.join(wide, "allowance_pool", "left")
    return rows.select("id", "allowance_pool", "at", *[F.expr(f"(1000000 * used_{w}_e8) div nullif(c_{w}, 0)").alias(f"share_{w}_ppm") for w in windows])
