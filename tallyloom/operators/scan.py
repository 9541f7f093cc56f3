"""Running sums and neighbours within a session, of which no task takes more than a piece.

Most sessions have no more than PIECE rows: they are dealt by session, and one window takes a session whole. The
others, which one count finds (``sizes``), are put in order by a sort of their own, and a session's places are cut into pieces of
PIECE places. A window runs within a piece; each piece's total (or last value) is one row, a
window over a session's pieces carries it on, and a join by session and piece brings it back. So a session that holds
a third of all rows is spread over as many tasks as it fills pieces; results are those of one window a session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Places of a piece: the most rows of one session that a window takes.
PIECE = 1 << 20


@dataclass(frozen=True)
class Sizes:
    """The sessions of more than PIECE rows (fewer than there are rows / PIECE), and whether there are others."""

    large: tuple[str, ...]
    small: bool


def sizes(rows: DataFrame, weight: Column | None = None, by: str = "session") -> Sizes:
    """Sizes of the sessions of these rows. A row counts as ``weight`` rows: an upper bound of what it is split into."""
    known = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    found = known.agg(F.collect_list(F.when(F.col("n") > PIECE, F.col(by))).alias("large"), F.count_if(F.col("n") <= PIECE).alias("small")).first()
    return Sizes(tuple(sorted(found["large"])), found["small"] > 0)


def apart(known: Sizes, whole: Callable[..., DataFrame], cut: Callable[..., DataFrame], *frames: DataFrame, by: str = "session") -> DataFrame:
    """``whole`` of the frames' rows of small sessions and ``cut`` of those of large ones. Rows without a session go."""
    if not known.large:
        return whole(*[f.where(F.col(by).isNotNull()) for f in frames])
    is_large = F.col(by).isin(*known.large)
    if not known.small:
        return cut(*[f.where(is_large) for f in frames])
    return whole(*[f.where(~is_large) for f in frames]).unionByName(cut(*[f.where(is_large) for f in frames]))


def upto(*order: str | Column, by: str = "session"):
    """The window of a session's rows up to this one."""
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows, stored, with ``at``: a long that ascends with the order, with gaps. ``order`` should tell all rows
    apart, equal ones stay in one task."""
    return stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")


def _pieces(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("_piece", F.expr(f"{at} div {PIECE}"))


def running(rows: DataFrame, value: Column, name: str, at: str = "at", by: str = "session") -> DataFrame:
    """Adds ``name``: the sum of ``value``, which is never null, over a ``by``'s rows up to this one. Rows without a ``by`` go."""
    cut = _pieces(rows, at).withColumn("_value", value.cast("long"))
    earlier = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(by, "_piece").agg(F.sum("_value").alias("_sum")).select(by, "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(by, "_piece").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_inside", F.sum("_value").over(inside)).join(carried, [by, "_piece"]).withColumn(name, F.col("_carried") + F.col("_inside")).drop("_piece", "_value", "_inside", "_carried")


def previous(rows: DataFrame, column: str, name: str, at: str = "at", by: str = "session") -> DataFrame:
    """Adds ``name``: ``column`` of the row before, null for the first. Rows without a ``by`` go."""
    cut = _pieces(rows, at)
    pieces = cut.groupBy(by, "_piece").agg(F.max_by(column, at).alias("_last"))
    carried = pieces.select(by, "_piece", F.lag("_last").over(Window.partitionBy(by).orderBy("_piece")).alias("_carried"))
    inside = Window.partitionBy(by, "_piece").orderBy(at)
    near = cut.withColumns({"_nth": F.row_number().over(inside), "_near": F.lag(column).over(inside)})
    return near.join(carried, [by, "_piece"]).withColumn(name, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_near"))).drop("_piece", "_nth", "_near", "_carried")


def numbered(rows: DataFrame, name: str, *order: str | Column, known: Sizes | None = None) -> DataFrame:
    """Adds ``name``: the row's number in its session, from 0, in this order. ``known``: sizes of the sessions, or upper
    bounds, where they are found with less work than in the rows."""
    whole = lambda r: r.withColumn(name, F.row_number().over(Window.partitionBy("session").orderBy(*order)) - 1)
    return apart(sizes(rows) if known is None else known, whole, lambda r: _placed(r, name, *order), rows)


def _placed(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """In a partition of the sort ``at`` has no gaps, so a row's number follows from its partition's first place and the rows
    of the partitions before; no window takes rows."""
    placed = in_order(rows, "session", *order).withColumn("_part", F.shiftright("at", 33))
    earlier = Window.partitionBy("session").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("session", "_part").agg(F.min("at").alias("_first"), F.count("*").alias("_rows"))
    begun = parts.select("session", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_begun"))
    return placed.join(begun, ["session", "_part"]).withColumn(name, (F.col("at") + F.col("_begun")).cast("int")).drop("at", "_part", "_begun")
