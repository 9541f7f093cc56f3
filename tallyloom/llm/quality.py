"""Quality rules: fixed limits and gradient-boosted trees over document statistics.

Statistics are counted over whole texts with numpy, a few megabytes of text at a
time, in one pass that shuffles nothing. The trees are fitted on a bounded sample of
labelled rows (``MAX_TRAINING_ROWS``) and sent to every task as flat node arrays, a
few thousand numbers. More symbols, repeated lines, repeated words, capitals,
exclamation marks or table bars can only lower a document's score.

Defined results: a null or empty text has no words, so it fails the fixed limits;
repeated rows are judged alike, row by row; a null doc_id is carried through; labels
without quality or doc_id are not learnt from, of several labels of one doc_id the
highest quality counts; without labels, or with one kind only, the fixed limits
alone decide; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .text import Words, is_word, mix, roll, slices, starts_of_equal, tidy

#: The classifier is fitted on at most so many labelled documents, those whose doc_id has the smallest hash.
MAX_TRAINING_ROWS = 20_000
#: A document is kept at this probability of good quality.
KEEP_FROM = 0.3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each feature and whether the score may rise (1) or fall (-1) only.
FEATURES = (
    ("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeat_words", -1), ("capitals", -1),
    ("exclamations", -1), ("bars", -1), ("digits", 0), ("distinct_words", 0), ("lines", 0), ("punctuation", 0),
)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _CAPITAL | np.isin(np.arange(256), np.arange(97, 123))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_POINT = np.isin(np.arange(256), list(b".,;:?"))


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(w: Words, k: int) -> np.ndarray:
    """For each text its words inside k-word windows that the text has twice or more."""
    at = w.runs(k)
    doc = w.doc
    key = mix(roll(mix(w.ids.astype(np.uint64)), at, k) ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = ~starts_of_equal(key)
    if same.any():
        i = np.flatnonzero(same)
        differ = doc[at[i]] != doc[at[i - 1]]
        for j in range(k):
            differ |= w.ids[at[i] + j] != w.ids[at[i - 1] + j]
        if differ.any():  # a collision of hashes: compare the windows themselves
            columns = [w.ids[at + j] for j in range(k)] + [doc[at]]
            order = np.lexsort(columns)
            at = at[order]
            same = ~starts_of_equal(*(c[order] for c in columns))
    twice = same.copy()
    twice[:-1] |= same[1:]
    edge = np.zeros(w.n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return _per_doc(np.cumsum(edge[:-1]) > 0, w.first)


def _dup_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines, and lines with a word that equal an earlier line of their text."""
    breaks = w.data == 10
    docs = len(w.offsets) - 1
    n = _per_doc(breaks, w.offsets) + 1
    first = np.zeros(docs + 1, np.int64)
    np.cumsum(n, out=first[1:])
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[~last] = np.flatnonzero(breaks)
    ends[last] = w.offsets[1:]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + ~last[:-1]
    starts[:1] = 0
    words = _per_doc(is_word(w.data), np.concatenate([starts, ends[-1:]])) > 0
    kept = np.zeros(len(ends) + 1, np.int64)
    np.cumsum(ends - starts, out=kept[1:])
    lines = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(w.data[~breaks])))
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(docs), n)[words]
    key = np.unique(doc * (len(ends) + 1) + code[words])
    distinct = np.bincount(key // (len(ends) + 1), minlength=docs)
    return n, np.bincount(doc, minlength=docs) - distinct


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of BASE, and the features, of each text."""
    w = Words(texts)
    count = lambda table: _per_doc(table[w.data], w.offsets)
    n_words = w.counts
    chars = _per_doc(is_word(w.data) & ((w.data & 0xC0) != 0x80), w.offsets)
    symbols, (n_lines, dup_lines) = count(_SYMBOL), _dup_lines(w)
    repeat = _repeated(w, WINDOW) if w.n else np.zeros(len(n_words), np.int64)
    distinct = np.bincount(np.unique(w.doc * (len(w.vocab) + 1) + w.ids) // (len(w.vocab) + 1), minlength=len(n_words)) if w.n else n_words
    per_word = lambda x: x / np.maximum(n_words, 1)
    features = [
        np.log1p(n_words), per_word(chars), per_word(symbols), dup_lines / n_lines, per_word(repeat), count(_CAPITAL) / np.maximum(count(_LETTER), 1),
        per_word(count(np.arange(256) == 33)), per_word(count(np.arange(256) == 124)), count(_DIGIT) / np.maximum(chars, 1), per_word(distinct), per_word(n_lines), per_word(count(_POINT)),
    ]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "features": np.stack(features, axis=1)}


def base_failed(s: dict[str, np.ndarray], min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> np.ndarray:
    return (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fits the trees on the features of at most ``rows`` labelled documents."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by ``rows``

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))["features"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    learnt = chosen.mapInArrow(run, "doc_id long, quality double, x array<double>").groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), F.to_json("x")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    x = np.array(learnt.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(learnt.column("quality").to_pylist(), float), np.array([m for _, m in FEATURES]))


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any more) with the columns of BASE,
    base_failed, score and kept put first; the input's own columns of those names go."""
    forest = train(docs, labels)
    out = {**dict.fromkeys(BASE, "long"), "base_failed": "boolean", "score": "double", "kept": "boolean"}
    source = docs.drop(*out)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = statistics(part.column("text"))
                failed, score = base_failed(s, min_words, max_repeat_percent), forest.probability(s["features"])
                kept = ~failed & (score >= keep_from if len(forest.roots) else True)
                columns = [pa.array(s[k], pa.int64()) for k in BASE] + [pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns + part.columns, [*out, *part.schema.names])

    schema = ", ".join(f"{k} {v}" for k, v in out.items()) + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return judge(docs, labels).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
