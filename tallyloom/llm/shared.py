"""Joins whose plan is the same at all sizes; tables and folders that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import folder, stored  # noqa: F401

#: Bits of the map of wanted keys that goes to every task (8 MB), and of a row of it.
BITS, ROW_BITS = 1 << 26, 1 << 15
#: Fewer keys than this can have more than one in so many of all rows.
HEAVY = 4096


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Texts pass between Spark and Python in small Arrow batches, by rows and bytes."""
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(4 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark


def marked(frame: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``frame`` with a column ``maybe``: false where the keys are not among those of the
    stored frame ``wanted``. A map of BITS bits of the keys' hashes goes to all tasks, at
    any size of ``wanted``; the fuller it is, the more other keys are taken for wanted."""
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1
    bits = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bits_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = frame.withColumns({"bits_row": F.bitmap_bucket_number(place), "bits_at": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "bits_row", "left")
    bit = F.expr("cast(conv(hex(substring(bits, cast(bits_at div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bits_at % 8 as int))")
    return at.withColumn("maybe", F.coalesce(bit != 0, F.lit(False))).drop("bits_row", "bits_at", "bits")


def picked(frame: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The inner join with the stored frame ``wanted``, which has a row a key: only rows of
    ``frame`` that the map of bits lets through are shuffled. One plan at any size."""
    return marked(frame, wanted, *keys).where("maybe").drop("maybe").join(wanted.hint("merge"), list(keys))


def with_columns_of(frame: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The left join with the stored frame ``found``, which has a row a key: rows of
    ``frame`` that the map of bits rules out stay where they are, the others are shuffled."""
    rows = marked(frame, found, *keys)
    near = rows.where("maybe").drop("maybe").join(found.hint("merge"), list(keys), "left")
    return near.unionByName(rows.where("not maybe").drop("maybe"), allowMissingColumns=True)


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "inner", sparse: bool = False) -> DataFrame:
    """The stored ``left`` joined (inner, left) with the stored ``right``, which has a row a key and in ``size``
    the number of the left's rows of that key. Keys of more than a HEAVY-th of those rows, so
    fewer than HEAVY of them, go to all tasks; the others are shuffled, if ``sparse`` behind
    the map of bits."""
    limit = (right.agg(F.sum(size)).first()[0] or 0) / HEAVY
    heavy, light = right.where(F.col(size) > limit), right.where(F.col(size) <= limit)
    known = left.join(F.broadcast(heavy), keys)  # no key of these is null
    others = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return known.unionByName(picked(others, light, *keys) if sparse else others.join(light.hint("merge"), keys, how))
