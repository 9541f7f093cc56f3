"""From usage records to turns, anchor runs and arcs.

A record table has one row for each transcript line: pos (its place, of any ordered
type), session, type, ts, message_id, request_id, model, the four token counts, skill,
sidechain, meta, cwd, branch, version, error_kind, api_error_status, is_text, text and
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .prompts import as_of
from .scan import Sizes, apart, numbered, previous, running, sizes, upto

TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
FIRST_SEEN = ("session", "model", "ts", "cwd", "branch", "version", "api_error_status")


def deduplicated(records: DataFrame, fields: tuple[str, ...] = FIRST_SEEN) -> DataFrame:
    """One row for each (message_id, request_id) over all sessions: the largest of each
    token count, the first record's fields, any sidechain, the first skill and error
    that are not empty. ``fields``: those of the first record that are asked for."""
    first = F.min(F.struct("pos", *fields)).alias("first")
    present = [F.expr(f"min(struct(pos, {c})) filter (where {c} is not null and {c} <> '')").alias(c) for c in ("skill", "error_kind")]
    most = [F.max(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS]
    grouped = records.where("type = 'assistant'").groupBy("message_id", "request_id").agg(first, *present, *most, F.coalesce(F.bool_or("sidechain"), F.lit(False)).alias("sidechain"))
    return grouped.select("message_id", "request_id", "first.*", F.col("skill.skill").alias("skill"), F.col("error_kind.error_kind").alias("error_kind"), *TOKENS, "sidechain")


def _order() -> tuple[Column | str, ...]:
    return (F.coalesce("ts", F.lit("")), F.coalesce("message_id", F.lit("")), "pos", "request_id")


def sequenced(turns: DataFrame, known: Sizes | None = None) -> DataFrame:
    """Turns numbered from 0 in each session; turns without a session are set aside."""
    return numbered(turns.where("session is not null and session <> ''"), "idx", *_order(), known=known)


def _run_start() -> Column:
    return F.col("skill").isNotNull() & ~F.col("skill").eqNullSafe(F.col("before"))


def with_arcs(turns: DataFrame, known: Sizes | None = None) -> DataFrame:
    """Adds run_start (a skill that the turn before doesn't have) and arc (-1 before the first)."""

    def cut(rows: DataFrame) -> DataFrame:
        marked = previous(rows, "skill", "before", "idx").withColumn("run_start", _run_start()).drop("before")
        return running(marked, F.col("run_start").cast("int"), "arc", "idx").withColumn("arc", (F.col("arc") - 1).cast("int"))

    def whole(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("before", F.lag("skill").over(Window.partitionBy("session").orderBy("idx"))).withColumn("run_start", _run_start()).drop("before")
        return marked.withColumn("arc", (F.sum(F.col("run_start").cast("int")).over(upto("idx")) - 1).cast("int"))

    return apart(sizes(turns) if known is None else known, whole, cut, turns)


def walked(turns: DataFrame, marks: DataFrame | None = None, known: Sizes | None = None) -> DataFrame:
    """Turns as ``sequenced``, ``with_arcs`` and, with marks (session, ts), ``prompts.as_of`` (column prompt) leave them, but
    with the small sessions dealt and sorted once: of one time the marks come first."""
    turns = turns.where("session is not null and session <> ''")
    known = sizes(turns) if known is None else known
    if known.large and known.small:
        turns = stored(turns, "turns")
    only_large = Sizes(known.large, False)
    time, *rest = _order()

    def numbered_arcs(rows: DataFrame, *order: Column | str, before: Column, idx: Column) -> DataFrame:
        marked = rows.withColumns({"idx": idx, "before": before}).withColumn("run_start", _run_start())
        return marked.withColumn("arc", (F.sum(F.col("run_start").cast("int")).over(upto(*order)) - 1).cast("int")).drop("before")

    def whole(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("session").orderBy(time, *rest)
        return numbered_arcs(rows, time, *rest, before=F.lag("skill").over(inside), idx=F.row_number().over(inside) - 1)

    def whole_marked(rows: DataFrame, at: DataFrame) -> DataFrame:
        both = rows.withColumn("_mark", F.lit(0)).unionByName(at.select("session", "ts", F.lit(1).alias("_mark")), allowMissingColumns=True)
        order = (time, F.desc("_mark"), *rest)
        earlier = Window.partitionBy("session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        before = F.last(F.when(F.col("_mark") == 0, F.struct("skill")), ignorenulls=True).over(earlier)["skill"]
        counted = both.withColumn("prompt", F.sum("_mark").over(upto(*order)))
        arced = numbered_arcs(counted, *order, before=before, idx=(F.sum(1 - F.col("_mark")).over(upto(*order)) - 1).cast("int"))
        return arced.where("_mark = 0").drop("_mark").withColumn("prompt", F.when(F.col("prompt") > 0, (F.col("prompt") - 1).cast("int")))

    cut = lambda rows: with_arcs(sequenced(rows, only_large), only_large)
    if marks is None:
        return apart(known, whole, cut, turns)
    return apart(known, whole_marked, lambda rows, at: as_of(cut(rows), at, "prompt", only_large), turns, marks)


def anchor_runs(turns: DataFrame) -> DataFrame:
    """session, arc, skill, start_turn and tag_end of each run of one skill. In an arc the turns with its
    skill come first, since a skill after a gap begins an arc of its own."""
    return turns.where("arc >= 0 and skill is not null").groupBy("session", "arc").agg(F.min_by("skill", "idx").alias("skill"), F.min("idx").alias("start_turn"), F.max("idx").alias("tag_end"))


def arcs(turns: DataFrame) -> DataFrame:
    """session, arc, skill, start_turn and end_turn (included): from a run's start to the next one's."""
    return turns.where("arc >= 0").groupBy("session", "arc").agg(F.min_by("skill", "idx").alias("skill"), F.min("idx").alias("start_turn"), F.max("idx").alias("end_turn"))


def tagged_only(turns: DataFrame) -> DataFrame:
    """The rejected rule that ends an arc with its tag."""
    return anchor_runs(turns).withColumnRenamed("tag_end", "end_turn")


def to_session_end(turns: DataFrame) -> DataFrame:
    """The rejected rule that ends every arc with its session."""
    last = turns.groupBy("session").agg(F.max("idx").alias("end_turn"))
    return arcs(turns).drop("end_turn").join(last, "session")


def claims(turns: DataFrame, rule: DataFrame, known: Sizes | None = None) -> DataFrame:
    """How many arcs of a rule claim each turn: a running sum of the arcs that begin at a turn less those that ended before it."""
    changes = rule.select("session", F.col("start_turn").alias("idx"), F.lit(1).alias("change")).unionByName(rule.select("session", (F.col("end_turn") + 1).alias("idx"), F.lit(-1).alias("change")))

    def whole(rows: DataFrame, at: DataFrame) -> DataFrame:
        both = rows.select("session", "idx", F.lit(True).alias("turn"), F.lit(0).alias("change")).unionByName(at.select("session", "idx", F.lit(False).alias("turn"), "change"))
        so_far = Window.partitionBy("session").orderBy("idx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("claimed", F.sum("change").over(so_far)).where("turn").drop("turn", "change")

    def cut(rows: DataFrame, at: DataFrame) -> DataFrame:
        at_turn = at.groupBy("session", "idx").agg(F.sum("change").alias("change"))
        return running(rows.select("session", "idx").join(at_turn, ["session", "idx"], "left"), F.coalesce("change", F.lit(0)), "claimed", "idx").drop("change")

    return apart(sizes(turns) if known is None else known, whole, cut, turns, changes)
