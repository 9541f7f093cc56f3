"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, jaccard, licenses, lines, lloyd, quality, substrings, suffixes, topk, urlfilter, warc
from .shared import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_lines(table(spark, sf_dir, "documents"), min_tokens=1).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), longest=5, least=100, first=2000)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"), k=40, size=64, rounds=5, seed="2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc_zip": op2_warc_zip,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_topk_search": op12_topk_search,
    "op13_lloyd": op13_lloyd,
}

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WINDOWS = """
    with docs as (select row_number() over () as r, doc_id, {words} as ws from documents),
    windows as (select r, doc_id, i, array_to_string(ws[i:i + {k} - 1], ' ') as w from (select *, unnest(range(1, len(ws) - {k} + 2)) as i from docs) x),
    first as (select w, min(doc_id) as m from windows group by w),
    hit as (select r, i, m from windows join first using (w) where m < doc_id),
    gone as (select distinct r, unnest(range(i, i + {k})) as p from hit)"""


#: Phrases by their words, cuts by joins with the counts of their parts.
_COLLOCATIONS = r"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
    totals as (select lang, sum(len(ws))::bigint as n from lists group by lang),
    starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
    grams as (select lang, array_to_string(ws[i:i + k - 1], ' ') as s from starts, range(1, 6) t(k) where i + k - 1 <= len(ws)),
    freq as materialized (select lang, string_split(s, ' ') as p, count(*) as a from grams group by lang, s having count(*) >= 100),
    cuts as (select f.lang, f.p, f.a, k, l.a as l, r.a as r, n, cast((1000::hugeint * f.a * n) // (l.a::hugeint * r.a) as bigint) as score from freq f join totals using (lang), range(1, 5) t(k)
        join freq l on l.lang = f.lang and l.p = f.p[1:k] join freq r on r.lang = f.lang and r.p = f.p[k + 1:] where k < len(f.p)),
    best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
    inner_parts as (select lang, p[:-2] as p, a from freq where len(p) > 2 union all select lang, p[2:] as p, a from freq where len(p) > 2),
    left_over as (select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score from best anti join inner_parts using (lang, p, a))
    select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from left_over) x where rank <= 2000"""


def _lloyd_sql(k: int = 40, size: int = 64, rounds: int = 5) -> str:
    """The rounds one after another, a component a row."""
    near = """a{i} as materialized (select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from
            (select v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as d from parts v join c{i} c using (place) group by v.r, c.cluster) x group by r)"""
    steps = [near.format(i=0)]
    for i in range(1, rounds + 1):
        steps.append(f"""m{i} as (select cluster, place, sum(x)::bigint as s, count(*) as n from a{i - 1} join parts using (r) group by cluster, place),
            c{i} as materialized (select c.cluster, c.place, case when n is null then c.x else (s - (((s % n) + n) % n)) // n end as x from c{i - 1} c left join m{i} using (cluster, place))""")
        steps.append(near.format(i=i))
    return f"""
        with v as (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (select r, place, cast(floor(256 * cast(embedding[place] as double)) as bigint) as x from v, range(1, {size + 1}) t(place)),
        c0 as materialized (select cluster, place, x from (select r, row_number() over (order by sha256('2:' || vec_id)) - 1 as cluster from v where vec_id is not null qualify cluster < {k}) f join parts using (r)),
        {", ".join(steps)},
        digest as (select cluster, sha256(string_agg(x::varchar, ',' order by place)) as centroid_sha256 from c{rounds} group by cluster)
        select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
        from a{rounds} join v using (r) join digest using (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": _WINDOWS.format(words=_WORDS.format(t="coalesce(text, '')"), k=13) + """,
        kept as (select r, string_agg(x, ' ' order by p) as t from (select r, unnest(ws) as x, generate_subscripts(ws, 1) as p from docs) w anti join gone using (r, p) group by r),
        lost as (select r, count(*) as n from gone group by r)
        select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join lost using (r) left join kept using (r)""",
    "op7_suffix_dedup": _WINDOWS.format(words=_WORDS.format(t="coalesce(text, '')"), k=50) + """,
        runs as (select r, min(p) as a, max(p) as b from (select r, p, p - row_number() over (partition by r order by p) as g from gone) x group by r, g)
        select doc_id, a - 1 as start_word, b as end_word, b - a + 1 as n_words, m as source_doc_id from runs join hit on hit.r = runs.r and hit.i = runs.a join docs on docs.r = runs.r""",
    "op9_ngram_jaccard": """
        with recursive docs as (select doc_id, """ + _WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ as ws from documents),
        sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as s from docs),
        tokens as materialized (select doc_id, unnest(s) as t from sets),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
        links as materialized (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
        both_ways as (select a, b from links union all select b, a from links),
        reach as (select a as x, b as y from both_ways union select reach.x, both_ways.b from reach join both_ways on both_ways.a = reach.y)
        select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce((select min(y) from reach where x = doc_id), doc_id)) as component_id from sets""",
    "op2_warc_zip": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as payload_bytes, body, upper(sha1(body)) as h from p),
        f as (select *, min(page_id) over (partition by h) as first_id from d)
        select page_id, payload_bytes,
            array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i::int, 5))::int >> (15 - 5 * j::int)) & 31)::int, 1)), '')), '') as payload_digest,
            case when first_id is null or page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
            case when first_id is not null and page_id is distinct from first_id then first_id end as refers_to
        from f""",
    "op5_url_filter": """
        with rules(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        p as (select row_number() over () as r, page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
        best as (select r, arg_max(x.host || x.path, length(x.host) * 100000 + length(x.host || x.path)) as rule, arg_max(verdict, length(x.host) * 100000 + length(x.host || x.path)) as verdict
                from p join rules x on (p.host = x.host or ends_with(p.host, '.' || x.host)) and starts_with(p.path, x.path) group by r)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (r)""",
    "op11_collocations": _COLLOCATIONS,
    "op12_topk_search": """
        with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
            from v q, v c where q.vec_id % 50 = 0 and q.r <> c.r)
        select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from pairs) x where rank <= 5""",
    "op13_lloyd": _lloyd_sql(),
}
