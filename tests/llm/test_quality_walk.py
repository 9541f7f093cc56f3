"""The verdicts of operator 8 against features counted in plain Python and trees walked node by node."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyloom.llm import quality, queries

DATA = "/root/testdata/sf0.001"


def counted(text):
    """BASE and the features of a text."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = lambda chars: sum(c in chars for c in t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    chars, n = sum(map(len, w)), max(len(w), 1)
    capitals, letters = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(c.isascii() and c.isalpha() for c in t)
    symbols, dup = count("#*$%&|<>"), len(lines) - len(set(lines))
    features = [np.log1p(len(w)), chars / n, symbols / n, dup / len(t.split("\n")), len(inside) / n, capitals / max(letters, 1), count("!") / n, count("|") / n, count("0123456789") / max(chars, 1), len(set(w)) / n, len(t.split("\n")) / n, count(".,;:?") / n]
    return (len(w), chars, symbols, dup, len(inside)), features


def walked(forest, x):
    """The probability by a walk from each root to a leaf."""
    total = forest.base
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = int(forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
        total += forest.value[node]
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def test_verdicts_against_a_plain_walk(spark):
    docs, labels = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels")
    forest = quality.train(docs.select("doc_id", "text"), labels)
    assert len(forest.roots) > 1
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = queries.op8_quality_rules(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base, features = counted(texts[r.doc_id])
        assert base == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        score = walked(forest, features)
        assert r.base_failed == failed and r.score == pytest.approx(score, abs=1e-9)
        if abs(score - quality.KEEP_FROM) > 1e-6:
            assert r.kept == (not failed and score >= quality.KEEP_FROM)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_training_is_the_same_again(spark):
    """Rows in another order and partitioning give the same trees."""
    docs, labels = queries.table(spark, DATA, "documents").select("doc_id", "text"), queries.table(spark, DATA, "labels")
    one, other = quality.train(docs, labels), quality.train(docs.repartition(7), labels.repartition(5))
    assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in ("roots", "feature", "threshold", "left", "right", "value"))
