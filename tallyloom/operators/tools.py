"""Tool calls of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import target
from .prompts import latest
from .scan import Sizes, numbered


def tool_calls(records: DataFrame, turns: DataFrame, *more: str, known: Sizes | None = None) -> DataFrame:
    """One row for each named tool_use block of every assistant record, repeated lines
    included: session, ordinal, tool_name, target, sidechain, ts and turn_index (the last
    turn that is not later; -1 before the first), with ``more`` of that turn. Only the reduced target is kept."""
    rows = records.where("type = 'assistant' and session is not null and session <> ''")
    blocks = rows.select("session", "ts", "pos", "sidechain", F.posexplode_outer(F.filter("blocks", lambda b: b["type"] == "tool_use")).alias("place", "b")).where("b.name is not null and b.name <> ''")
    given = F.coalesce(F.from_json("b.input", "map<string,string>"), F.create_map().cast("map<string,string>"))
    read = blocks.select("session", "ts", F.coalesce("sidechain", F.lit(False)).alias("sidechain"), F.col("b.name").alias("tool_name"), given.alias("given"), "pos", "place")  # parsed once
    calls = read.withColumn("target", target(F.col("tool_name"), F.col("given"))).drop("given")
    owned = latest(numbered(calls, "ordinal", "pos", "place", known=known).drop("pos", "place"), turns, "idx", *more, known=known)
    return owned.withColumn("turn_index", F.coalesce("idx", F.lit(-1))).drop("idx")
