"""Prompt boundaries and as-of attachment by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import debug_language, record_text, self_correction
from .scan import Sizes, apart, in_order, numbered, running, sizes, upto


def boundaries(records: DataFrame, said: bool = False, known: Sizes | None = None) -> DataFrame:
    """session, ts and ordinal of each prompt: a user record, neither meta nor sidechain,
    of non-blank text or of text or image blocks without a tool result. With its prose, if asked for."""
    kinds = F.transform("blocks", lambda b: b["type"])
    listed = F.arrays_overlap(kinds, F.array(F.lit("text"), F.lit("image"))) & ~F.array_contains(kinds, "tool_result")
    spoken = F.when(F.col("is_text"), F.col("text").rlike(r"(?U)\S")).otherwise(listed)
    rows = records.where("type = 'user' and session is not null and session <> ''").where(~F.coalesce("meta", F.lit(False)) & ~F.coalesce("sidechain", F.lit(False)) & F.coalesce(spoken, F.lit(False)))
    prose = [record_text(F.col("is_text"), F.col("text"), F.col("blocks")).alias("said")] if said else []
    return numbered(rows.select("session", F.coalesce("ts", F.lit("")).alias("ts"), "pos", *prose), "prompt", "ts", "pos", known=known).drop("pos")


def as_of(rows: DataFrame, marks: DataFrame, name: str, known: Sizes | None = None) -> DataFrame:
    """Adds ``name``: the number, less one, of the marks (session, ts) of a row's session
    that are not later than the row; null where there are none. Ties count: of one time the marks
    come first. Rows without a session go."""
    time = F.coalesce("ts", F.lit(""))

    def both(rows: DataFrame, marks: DataFrame) -> DataFrame:
        return rows.withColumn("_mark", F.lit(0)).unionByName(marks.select("session", "ts", F.lit(1).alias("_mark")), allowMissingColumns=True)

    whole = lambda *of: both(*of).withColumn(name, F.sum("_mark").over(upto(time, F.desc("_mark"))))
    cut = lambda *of: running(in_order(both(*of), "session", time, F.desc("_mark"), F.xxhash64(*rows.columns)), F.col("_mark"), name).drop("at")
    counted = apart(_sizes(rows, marks) if known is None else known, whole, cut, rows, marks).where("_mark = 0").drop("_mark")
    return counted.withColumn(name, F.when(F.col(name) > 0, (F.col(name) - 1).cast("int")))


def _sizes(rows: DataFrame, marks: DataFrame) -> Sizes:
    return sizes(rows.select("session").unionByName(marks.select("session")))


def latest(rows: DataFrame, turns: DataFrame, *carried: str, known: Sizes | None = None) -> DataFrame:
    """Adds ``carried`` (idx among them) of the last of the turns (session, ts, idx), numbered from 0 in order of time, that is not
    later than a row; null where there is none. Ties count. Rows without a session go."""
    time = F.coalesce("ts", F.lit(""))

    def whole(rows: DataFrame, turns: DataFrame) -> DataFrame:
        both = rows.withColumn("_turn", F.lit(None).cast(turns.select(F.struct(*carried)).schema[0].dataType)).withColumn("_mark", F.lit(0)).unionByName(turns.select("session", "ts", F.struct(*carried).alias("_turn"), F.lit(1).alias("_mark")), allowMissingColumns=True)
        seen = both.withColumn("_turn", F.last("_turn", ignorenulls=True).over(upto(time, F.desc("_mark"), F.col("_turn.idx"))))
        return seen.where("_mark = 0").select(*rows.columns, "_turn.*")

    def cut(rows: DataFrame, turns: DataFrame) -> DataFrame:
        return as_of(rows, turns, "idx", Sizes(known.large, False)).join(turns.select("session", *carried), ["session", "idx"], "left").select(*rows.columns, *carried)

    known = _sizes(rows, turns) if known is None else known
    return apart(known, whole, cut, rows, turns)


def language(records: DataFrame, marks: DataFrame, known: Sizes | None = None) -> DataFrame:
    """session, prompt and the share of its non-blank records that use each vocabulary. Records are
    reduced to what their prose uses before they are put in order."""
    spoken = records.where("type in ('user', 'assistant') and session is not null and session <> ''")
    prose = spoken.select("session", "ts", record_text(F.col("is_text"), F.col("text"), F.col("blocks")).alias("said")).where(F.col("said").rlike(r"(?U)\S"))
    used = prose.select("session", "ts", debug_language(F.col("said")).cast("int").alias("debug"), self_correction(F.col("said")).cast("int").alias("correction"))
    marked = as_of(used, marks, "prompt", known).where("prompt is not null")
    return marked.groupBy("session", "prompt").agg(F.avg("debug").alias("debug_share"), F.avg("correction").alias("correction_share"))
