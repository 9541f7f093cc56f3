"""Reconciliation of two sources of calls: transcripts and metric records.

Both have session, uuid, ts and the token counts, and an id of their own. Records of one session
and uuid are the same call; what is left is matched by time, 2 s apart at most. A record is
matched once. Tokens come from the metrics where there are any, never from both; the difference is told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .turns import TOKENS

SECONDS = 2
TRANSCRIPT, METRICS = 1, 2
#: A difference of more than so many percent is a fault, not rounding.
ALARM_PERCENT = 2


def _timed(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(F.col("id").alias(f"{side}_id"), "session", "uuid", F.unix_micros(F.try_to_timestamp("ts")).alias(f"{side}_at"))


def by_uuid(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of the same session and uuid; of repeated ones the n-th by time with the n-th."""
    nth = lambda side: F.row_number().over(Window.partitionBy("session", "uuid").orderBy(f"{side}_at", f"{side}_id"))
    one, other = (_timed(rows, side).where("uuid is not null and session is not null").withColumn("n", nth(side)) for rows, side in ((left, "left"), (right, "right")))
    return one.join(other, ["session", "uuid", "n"]).select("left_id", "right_id")


def by_time(left: DataFrame, right: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """left_id, right_id of one session within ``seconds``, each the other's nearest (the smaller id on
    ties). Times meet in steps of ``seconds``: a left row in its own, a right row in its own and its two neighbours."""
    size = seconds * 1_000_000
    step = lambda side: F.floor(F.col(f"{side}_at") / size)
    one = _timed(left, "left").where("session is not null and left_at is not null").withColumn("step", step("left")).drop("uuid")
    other = _timed(right, "right").where("session is not null and right_at is not null").drop("uuid")
    other = other.withColumn("step", F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: step("right") + x)))
    pairs = one.join(other, ["session", "step"]).withColumn("gap", F.abs(F.col("left_at") - F.col("right_at"))).where(F.col("gap") <= size)
    nearest = pairs.groupBy("left_id").agg(F.min(F.struct("gap", "right_id")).alias("best")).select("left_id", F.col("best.right_id").alias("right_id"))
    back = pairs.groupBy("right_id").agg(F.min(F.struct("gap", "left_id")).alias("best")).select(F.col("best.left_id").alias("left_id"), "right_id")
    return nearest.join(back, ["left_id", "right_id"])


def reconciled(transcripts: DataFrame, metrics: DataFrame, seconds: int = SECONDS, rounds: int = 2) -> DataFrame:
    """Every record of either source once: transcript_id, metric_id, session, ts, sources (bits: 1 transcript, 2 metrics),
    the token counts of the authoritative one and reconciliation_delta, metrics less transcript over all
    tokens, where both are there. Records whose nearest was taken by another are matched in further ``rounds``."""
    found = by_uuid(transcripts, metrics)
    for _ in range(rounds):
        left = transcripts.join(found, transcripts.id == found.left_id, "left_anti")
        right = metrics.join(found, metrics.id == found.right_id, "left_anti")
        found = found.unionByName(by_time(left, right, seconds))
    total = sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))
    one = transcripts.select(F.col("id").alias("transcript_id"), F.struct("session", "ts", *TOKENS, total.alias("total")).alias("t"))
    other = metrics.select(F.col("id").alias("metric_id"), F.struct("session", "ts", *TOKENS, total.alias("total")).alias("m"))
    matched = one.join(found.withColumnsRenamed({"left_id": "transcript_id", "right_id": "metric_id"}), "transcript_id", "left")
    both = matched.join(other, "metric_id", "full_outer")
    taken = F.when(F.col("m").isNotNull(), F.col("m")).otherwise(F.col("t"))
    bits = F.when(F.col("t").isNotNull(), TRANSCRIPT).otherwise(0).bitwiseOR(F.when(F.col("m").isNotNull(), METRICS).otherwise(0))
    rows = both.select("transcript_id", "metric_id", F.coalesce("t.session", "m.session").alias("session"), F.coalesce("t.ts", "m.ts").alias("ts"), bits.alias("sources"), taken.alias("x"), (F.col("m.total") - F.col("t.total")).alias("reconciliation_delta"))
    return rows.select("transcript_id", "metric_id", "session", "ts", "sources", *[F.col(f"x.{c}").alias(c) for c in TOKENS], "reconciliation_delta")


def coverage(rows: DataFrame, percent: int = ALARM_PERCENT) -> DataFrame:
    """How many records each combination of sources has, their tokens and differences, and whether these are an alarm."""
    total = sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))
    sums = rows.groupBy("sources").agg(F.count("*").alias("records"), F.sum(total).alias("tokens"), F.coalesce(F.sum(F.abs("reconciliation_delta")), F.lit(0)).alias("delta"))
    return sums.withColumn("alarm", 100 * F.col("delta") > percent * F.col("tokens"))
