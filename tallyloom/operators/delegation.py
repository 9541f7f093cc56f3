"""Calls that a session hands to another provider's agent, joined to that agent's own logs.

A delegation is what the wrapper at the call site noted (id, run_id, parent_prompt_id, cwd, ts), an agent run
what the agent logged (id, run_id, cwd, ts, tokens). They are joined in order of trust: the
same run_id; else the same working directory and a beginning within ``SECONDS`` after the call. A
run is given to one delegation and a delegation gets one run. What is left is flagged, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How long after the call an agent's log may begin.
SECONDS = 20


def by_run_id(delegations: DataFrame, runs: DataFrame) -> DataFrame:
    """delegation_id, agent_id: of a repeated run_id the n-th by time with the n-th."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "id"))
    one, other = (rows.where("run_id is not null").withColumn("n", nth).select("run_id", "n", F.col("id").alias(name)) for rows, name in ((delegations, "delegation_id"), (runs, "agent_id")))
    return one.join(other, ["run_id", "n"]).select("delegation_id", "agent_id")


def by_beginning(delegations: DataFrame, runs: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """delegation_id, agent_id of one directory: the run that begins next after the call, if the call is also the last one
    before the run (smaller ids first on ties). Times meet in steps of ``seconds``: a run in its own, a call in its own and the next."""
    size = seconds * 1_000_000
    timed = lambda rows, name: rows.select(F.col("id").alias(name), "cwd", F.unix_micros(F.try_to_timestamp("ts")).alias(f"{name}_at")).where(F.col(f"{name}_at").isNotNull() & F.col("cwd").isNotNull())
    calls, begun = timed(delegations, "delegation_id"), timed(runs, "agent_id").withColumn("step", F.floor(F.col("agent_id_at") / size))
    step = F.floor(F.col("delegation_id_at") / size)
    pairs = calls.withColumn("step", F.explode(F.array(step, step + 1))).join(begun, ["cwd", "step"]).withColumn("wait", F.col("agent_id_at") - F.col("delegation_id_at")).where((F.col("wait") >= 0) & (F.col("wait") <= size))
    one = pairs.groupBy("delegation_id").agg(F.min(F.struct("wait", "agent_id")).alias("best")).select("delegation_id", F.col("best.agent_id").alias("agent_id"))
    other = pairs.groupBy("agent_id").agg(F.min(F.struct("wait", "delegation_id")).alias("best")).select(F.col("best.delegation_id").alias("delegation_id"), "agent_id")
    return one.join(other, ["delegation_id", "agent_id"])


def attributed(delegations: DataFrame, runs: DataFrame, seconds: int = SECONDS, rounds: int = 2) -> DataFrame:
    """Every delegation and every run once: delegation_id, agent_id, parent_prompt_id, cwd, ts, tokens, trust (``run_id``, ``time`` or ``none``)
    and orphaned, which is a delegation without a run, so that its cost is missing, not nought."""
    found = by_run_id(delegations, runs).withColumn("trust", F.lit("run_id"))
    for _ in range(rounds):
        left = delegations.join(found.select(F.col("delegation_id").alias("id")), "id", "left_anti")
        right = runs.join(found.select(F.col("agent_id").alias("id")), "id", "left_anti")
        found = found.unionByName(by_beginning(left, right, seconds).withColumn("trust", F.lit("time")))
    one = delegations.select(F.col("id").alias("delegation_id"), "parent_prompt_id", F.col("cwd").alias("cwd_d"), F.col("ts").alias("ts_d"))
    other = runs.select(F.col("id").alias("agent_id"), F.col("cwd").alias("cwd_a"), F.col("ts").alias("ts_a"), "tokens")
    both = one.join(found, "delegation_id", "left").join(other, "agent_id", "full_outer")
    return both.select("delegation_id", "agent_id", "parent_prompt_id", F.coalesce("cwd_d", "cwd_a").alias("cwd"), F.coalesce("ts_d", "ts_a").alias("ts"), "tokens", F.coalesce("trust", F.lit("none")).alias("trust"), F.col("agent_id").isNull().alias("orphaned"))
