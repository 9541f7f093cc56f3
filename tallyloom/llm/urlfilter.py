"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule (host, path) becomes the canonical key ``reversed host / path``. The URLs that
fit it are those with a key, for their host or one of its parent domains, in the
interval of strings that begin with the rule's key; intervals either nest or are
apart. Each URL gets a key for every suffix of its host that some rule names. URLs
and rule starts of one host are then sorted by path, and the sweep carries the last
rule start with its stack: the rules still open there, which are the rules whose key
it begins with. Of the stack, the rules that the URL's key begins with are those that
fit; the longest of them, over all suffixes, decides.

Distinct URLs are judged once and joined back, the few that a large part of all rows
have by a copy in every task. Keys of one host are dealt over as many groups as its
URLs ask for, ``group`` in each, with the host's rules in every group, so a host with a
third of all rows is no single task at any size.

Defined results: a null URL and one without ``://`` have empty host and path, which no
rule fits; rules with a null or empty host or a null path are ignored; of rules that
are equal, ``block`` counts; of fitting rules of equal length the one with the longer host counts;
repeated rows are judged alike; null page_ids are carried through; an empty rule
table leaves every URL with the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_by, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs of a host that are swept together.
GROUP = 100_000
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, ASCII lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _rules(rules: DataFrame) -> DataFrame:
    """Valid rules, one for each host and path, with the stack that is open where each starts."""
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host <> '' and path is not null and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict")).withColumn("domain", _reversed(F.split("host", r"\.", -1)))
    entry = F.struct(F.length("path").alias("size"), "path", "host", "verdict").alias("entry")
    opened = known.select("domain", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"), F.col("path").alias("start")).select("domain", "start", F.expr("left(start, n)").alias("path"))
    return opened.join(known, ["domain", "path"]).groupBy("domain", "start").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def match_urls(urls: DataFrame, rules: DataFrame, group: int = GROUP) -> DataFrame:
    """For each distinct ``url`` that a rule fits: url, n (its rows), rule, verdict."""
    stacks = stored(_rules(rules), "rule-stacks")
    known = urls.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).where("host <> ''")
    labels = F.split("host", r"\.", -1)
    keyed = known.select("url", "n", "host", "path", labels.alias("labels")).select("url", "n", "host", "path", F.explode(F.expr("transform(sequence(1, size(labels)), n -> array_join(reverse(slice(labels, -n, n)), '.'))")).alias("domain"))
    domains = stacks.select("domain").distinct()
    keyed = stored(keyed.join(domains, "domain", "left_semi"), "keyed-urls")
    sizes = stored(keyed.groupBy("domain").agg(F.count("*").alias("size")).withColumn("salts", F.ceil(F.col("size") / group)), "host-sizes")
    salted = joined_by(keyed, sizes, ["domain"], "size")
    events = salted.select("domain", F.pmod(F.xxhash64("url"), "salts").alias("salt"), F.col("path").alias("key"), F.lit(1).alias("kind"), "url", "n", "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.join(sizes, "domain").select("domain", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col("start").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("host"), "stack")
    sweep = Window.partitionBy("domain", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = swept.select("url", "n", "host", F.col("key").alias("path"), F.expr("try_element_at(filter(open, r -> startswith(key, r.path)), -1)").alias("r")).where("r is not null")
    best = F.max(F.struct((F.length("r.host") + F.length("r.path")).alias("size"), F.length("r.host").alias("wide"), "r"))["r"].alias("r")
    return fits.groupBy("url", "n").agg(best).select("url", "n", F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, group: int = GROUP) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict for every page."""
    pages = pages.select("page_id", "url")
    found = stored(match_urls(pages, rules, group), "judged-urls")
    known, others = pages.where("url is not null"), pages.where("url is null")
    rows = joined_by(known, found, ["url"], "n", "left").unionByName(others, allowMissingColumns=True)
    return rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
