"""The rate registry: models resolve to the longest matching pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import POOL, RATES, RATES_FROM, RATES_VERSION

REGISTRY_SCHEMA = (
    "version string, provider string, pattern string, tier string, pool string, billable boolean, "
    "in_cents long, out_cents long, write_cents long, read_cents long, effective_from string"
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(RATES_VERSION, "anthropic", p, t, POOL, b, *cents, RATES_FROM) for p, t, b, *cents in RATES], REGISTRY_SCHEMA)


def current(rates: DataFrame) -> DataFrame:
    """The rows of the latest version; an empty registry is an error."""
    latest = rates.agg(F.max("version").alias("v")).first()["v"]
    if latest is None:
        raise LookupError("the rate registry is empty")
    return rates.where(F.col("version") == latest)


def resolve(models: DataFrame, rates: DataFrame) -> DataFrame:
    """For each distinct ``model`` its tier, pool and rates; models without a pattern are
    missing. The glob join runs over distinct models only and keeps one row for each."""
    like = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    names = models.select("model").where("model is not null").distinct()
    pairs = names.join(F.broadcast(current(rates)), F.regexp(F.col("model"), like))  # the registry is a fixed, small table
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "tier", "pool", "billable", "in_cents", "out_cents", "write_cents", "read_cents")).alias("r")
    return pairs.groupBy("model").agg(best).select("model", "r.pattern", "r.tier", "r.pool", "r.billable", "r.in_cents", "r.out_cents", "r.write_cents", "r.read_cents")


def priced(calls: DataFrame, rates: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Calls with model_tier, allowance_pool, billable and value_e8 (1e-8 dollars, exact).
    Unknown models have tier ``unknown`` and value 0. ``models``: where the calls' models are found with less work than in them."""
    known = resolve(calls if models is None else models, rates)
    out = calls.join(F.broadcast(known), "model", "left")  # a row for each model that a pattern names: a few names, of which each may have most of all calls
    value = F.expr("input_tokens * in_cents + output_tokens * out_cents + cache_write_tokens * write_cents + cache_read_tokens * read_cents")
    return out.withColumns({
        "model_tier": F.coalesce("tier", F.lit("unknown")), "allowance_pool": F.coalesce("pool", F.lit("unknown")),
        "billable": F.coalesce("billable", F.lit(False)), "value_e8": F.coalesce(value, F.lit(0)).cast("long"),
    }).drop("tier", "pool", "pattern", "in_cents", "out_cents", "write_cents", "read_cents")
