"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeated rows, odd
vectors, empty tables and extra columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import collocations, lloyd, topk
from tallyloom.llm.mph import PerfectHash, shard_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# perfect hashes ------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 200_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = PerfectHash.loads(PerfectHash(keys).dumps())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))  # minimal: no slot is left out
    assert (made.keys[made.slots(keys)] == keys).all()
    others = np.setdiff1d(np.arange(5000, dtype=np.uint64) * np.uint64(977), keys)
    assert (made.slots(others) == -1).all()  # a key that isn't stored is told from those that are
    assert set(shard_of(keys, 7).tolist()) <= set(range(7))


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([5, 5], np.uint64))


# 11 ------------------------------------------------------------------------------


def phrases_of(rows, longest, least, first):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, all_of in counts.items():
        known = {p: a for p, a in all_of.items() if a >= least}
        longer = [p for p in known if len(p) > 2]
        inside = {q for p in longer for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and known[p] >= known[q]}
        rows = []
        for p, a in known.items():
            if len(p) > 1 and p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (known[p[:k]] * known[p[k:]]), k, known[p[:k]], known[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def talk(seed=5, n=150):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "New", "York", "City", "é\x00", "\x1cx", "straße", "日本", "-", "'"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!", "?;"]
    rows = []
    for i in range(n):
        said = "".join(rnd.choice(vocabulary) + rnd.choice(marks) for _ in range(rnd.randint(0, 60)))
        if i % 3 == 0:
            said += "new york city hall of fame and new york city hall "
        rows.append((i, rnd.choice(["en", "de", None, "und"]), rnd.choice([said, said, said.upper(), None, "", " .,\n"])))
    rows += [(n, "en", "the cat " * 20000), (n + 1, "fr", "alone " * 30), rows[0], (None, "en", rows[3][2])]
    return rows


NAMES = "doc_id long, lang string, text string"


def said(spark, rows, names=NAMES):
    return spark.createDataFrame([(*r, 3, b"x", "y") for r in rows], names + ", key long, slots binary, word string").repartition(5)


@pytest.mark.parametrize(("longest", "least", "first"), [(5, 20, 2000), (3, 10, 7), (2, 30, 2000), (5, 10**9, 5)])
def test_collocations(spark, longest, least, first):
    rows = talk()
    got = collocations.mine(said(spark, rows), longest, least, first)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_of([r[1:] for r in rows], longest, least, first)


def test_collocations_in_small_shards_rounds_blocks_and_tasks(spark, monkeypatch):
    """Neither shards, rounds, blocks, the tree's width nor what a task holds changes a row."""
    for name, value in (("SHARD_KEYS", 7), ("ROUND_KEYS", 15), ("BLOCK", 4), ("FAN_IN", 2), ("HELD", 5)):
        monkeypatch.setattr(collocations, name, value)
    rows = talk(6, 90)
    got = collocations.mine(said(spark, rows), 4, 3, 2000)
    want = phrases_of([r[1:] for r in rows], 4, 3, 2000)
    assert len(want) > 20 and sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want


def test_collocations_of_nothing(spark):
    assert collocations.mine(said(spark, [])).count() == 0
    assert collocations.mine(said(spark, [(1, None, None), (2, "en", "")]), least=1).count() == 0
    assert collocations.mine(said(spark, [(1, "en", "one"), (2, "en", "one")]), least=2).count() == 0


def test_scores_pass_64_bits(spark):
    """1000 * a * n is beyond 64 bits here, and so is l * r."""
    a, n, half = 5 * 10**9, 10**13, 7 * 10**9
    found = spark.createDataFrame([("en", ["x", "y"], a, [half, a], [half + 1, a])], "lang string, words array<string>, a long, pre array<long>, suf array<long>")
    row = collocations.scored(found, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert (row.l, row.r, row.score) == (half, half + 1, 1000 * a * n // (half * (half + 1)))


def test_streams_hold_breaks():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "en", "de"], "text": ["a b. c", None, " ,", "A"]})
    keys, known, ends = collocations._text_keys(batch)
    assert known.tolist() == [False, True, True, False, True, False, False, False, True] and ends.tolist() == [5, 6, 7, 9]
    assert keys[1] != keys[8]  # the same word of another language


# 12 and 13 -----------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed, n, size):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, size))
    rows = [(i, [float(np.float32(v)) for v in (centers[i % 5] + 0.4 * rng.normal(size=size)) * 0.1]) for i in range(n)]
    rows += [(n, None), (n + 1, [float("nan")] * size), (n + 2, [1.0] * (size - 1) + [float("inf")]), (n + 3, [None] + [0.1] * (size - 1)), (0, rows[0][1]), (20, rows[1][1]), (None, rows[2][1]), (-20, rows[20][1]), rows[20]]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", row long, x string, cluster int").repartition(3)


def whole(rows):
    return [(i, [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def best(rows, k, every):
    known, out = whole(rows), []
    for at, (i, q) in enumerate(known):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), 1 << 62 if j is None else j, j) for other, (j, v) in enumerate(known) if other != at)
            out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=5, every=20):
    got = topk.nearest(table(spark, rows), F.col("vec_id") % every == 0, k)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("shard", "queries", "batch", "chunk"), [(4096, 1024, 128, 8), (64, 5, 3, 2), (7, 2, 1, 1), (1, 1, 1, 64)])
def test_topk(spark, monkeypatch, shard, queries, batch, chunk):
    for name, value in (("SHARD", shard), ("QUERIES", queries), ("BATCH", batch), ("CHUNK", chunk)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(1, 200, 16)
    assert found(spark, rows) == best(rows, 5, 20)


def test_topk_without_a_broadcast(spark, monkeypatch):
    """Queries beyond the broadcast threshold: partitions of both sides are paired, and rows are the same."""
    monkeypatch.setattr(topk, "SHARD", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = vectors(8, 150, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = topk.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "BroadcastNestedLoop" not in plan
        assert found(spark, rows) == best(rows, 5, 20)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_topk_of_few_ragged_and_huge_vectors(spark):
    rows = [(0, []), (20, [1.0]), (40, [-1.0, 2.0, 3.0]), (3, [1e30, -1e30]), (60, [3e5, 1.0]), (61, [-2.5e5])]
    assert found(spark, rows) == best(rows, 5, 20)
    assert found(spark, rows[:1]) == [] and found(spark, []) == [] and found(spark, [(7, [1.0]), (8, [1.0])]) == []


def test_topk_ties_go_to_smaller_ids(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60, -1, -1)]
    assert [r[2] for r in found(spark, rows) if r[0] == 0] == [1, 2, 3, 4, 5]


def test_terms_are_probed_only_while_competitive():
    """With floors known, some terms are non-essential and most documents are dropped before them."""
    rng = np.random.default_rng(2)
    scale = np.exp(-np.arange(32) / 4)
    columns = np.round(rng.normal(size=(32, 3000)) * 200 * scale[:, None]).astype(np.int32)
    queries = np.round(rng.normal(size=(20, 32)) * 200 * scale).astype(np.int32)
    shard = topk.Shard(np.arange(3000), np.arange(3000), columns)
    exact = queries.astype(np.int64) @ columns.astype(np.int64)
    floor = np.sort(exact, 1)[:, -5].astype(float)
    seen = []
    real = np.einsum
    np.einsum = lambda *a, **b: (seen.append(a[1].shape[0]), real(*a, **b))[1]
    try:
        at, place, score = topk.search(shard, queries, np.full(20, -1), floor, 5)
    finally:
        np.einsum = real
    assert sorted(zip(at.tolist(), place.tolist(), score.tolist())) == sorted((i, j, exact[i, j]) for i, j in zip(*np.nonzero(exact >= floor[:, None])))
    assert seen and max(seen) < 0.1 * exact.size


def lloyd_of(rows, k, size, rounds, seed):
    kept = [(i, v) for i, v in whole(rows) if len(v) == size]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in done:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in done), key=repr)


@pytest.mark.parametrize(("k", "rounds", "seed"), [(8, 5, "2"), (40, 3, "s"), (1, 2, "2"), (5, 0, "2"), (500, 1, "2")])
def test_lloyd(spark, k, rounds, seed):
    rows = vectors(3, 150, 16) + [(900, [1e30] * 16), (901, [-3.0e38] * 16), (902, [0.1] * 15), (903, [])]
    got = lloyd.clusters(table(spark, rows), k, 16, rounds, seed)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == lloyd_of(rows, k, 16, rounds, seed)


def test_lloyd_empty_clusters_and_tables(spark):
    """Equal vectors tie to the lowest number, so the other centroids stay empty and where they are."""
    rows = [(i, [0.25] * 4) for i in range(30)]
    got = lloyd.clusters(table(spark, rows), 3, 4, 2)
    assert {(r.cluster, r.distance, r.inertia) for r in got.collect()} == {(0, 0, 0)}
    assert lloyd.clusters(table(spark, []), 3, 4, 2).count() == 0
    assert lloyd.clusters(table(spark, [(1, [0.5])]), 3, 4, 2).count() == 0
    assert lloyd.clusters(table(spark, [(None, [0.5] * 4)]), 3, 4, 2).count() == 0  # no row with an id, no centroid
