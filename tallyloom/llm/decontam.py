"""Benchmark decontamination by a BM25 index of test items and block-max WAND.

The index holds the test items; every passage of every training text is a query. A
posting's impact is its BM25 contribution divided by the score that the item gets from
its own words, so one threshold holds for all items. A passage has twice as many words
as the longest item (``passage_words`` at least) and starts every half passage, so
each item stands whole in some passage.

Most passages are settled by upper bounds alone: the commonest terms are set aside
as long as together they give no item more than half of the threshold; a passage in
which the other terms give no item the rest is skipped. The remaining passages go
through block-max WAND, which returns all items at or above the threshold. An item is
verified by aligning it with the passage: of all shifts between the two the one at which
most of the item's words meet equal words of the passage, ``drift`` places off at most, so changed
words cost themselves only and inserted ones little. Of the question ``question_overlap`` and of the
answer (the text after its last line break, else its last sentence) ``answer_overlap`` must
meet; the answer may stand elsewhere in the passage, then by an alignment of its own, a short one
(fewer than ``short`` words) without a gap. An item of one part only must meet as a question does, a short item word for
word. Words are compared by 64-bit hashes, without the marks at their edges.

Items are indexed in shards of bounded bytes, and each shard takes a pass over all
texts; document frequencies are counted over all items, so shards change no score.

Defined results: null and empty texts have no passage; items that are null or have no word are ignored,
and so are those of fewer than ``short`` words and ``min_item_chars`` characters, which any text may hold; a
word of a script without spaces is what stands between two spaces; of equal items each is reported;
repeated rows are searched alike; an empty item table finds nothing; a null doc_id or
item_id is carried through; columns other than those named are not read, or carried
through where documents are returned. Whole texts are searched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, hash_strings, slices, tidy

THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.7, 0.5
SHORT, DRIFT, MIN_ITEM_CHARS, PASSAGE_WORDS = 5, 2, 12, 128
K1, B, BLOCK, PIECE = 1.2, 0.75, 16, 512
#: Bytes of item texts in a shard of the index, which goes to every task.
SHARD_BYTES = 8 << 20
SPACE = re.compile("[\x20\x09-\x0d]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
#: What is taken off the edges of words: Unicode's punctuation and the symbols of ASCII.
MARKS = "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "P") + "$+<=>^`|~"


def words_of(text: str) -> list[str]:
    """Lower-cased words without marks at their edges; a word of marks only stays as it is."""
    return [w.strip(MARKS) or w for w in SPACE.split(text.translate(_LOWER)) if w]


def bare_words(texts: pa.Array) -> Words:
    """The same words of Arrow texts."""
    w = Words(texts, lower=True)
    if w.n:
        bare = pc.utf8_trim(w.vocab, characters=MARKS)
        coded = pc.if_else(pc.equal(pc.binary_length(bare), 0), w.vocab, bare).dictionary_encode()
        w.ids, w.vocab = coded.indices.to_numpy(zero_copy_only=False)[w.ids], coded.dictionary
    return w


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before and after its last line break, or before its last sentence."""
    head, cut, tail = text.strip().rpartition("\n")
    if not cut or not words_of(head) or not words_of(tail):
        m = list(re.finditer(r"[.!?]\s+(?=\S)", text.strip()))
        at = m[-1].end() if m else 0
        head, tail = text.strip()[:at], text.strip()[at:]
    return words_of(head), words_of(tail)


def word_hashes(words: list[str]) -> np.ndarray:
    return hash_strings(pa.array(words, pa.large_string())) if words else np.zeros(0, np.uint64)


def aligned(words: np.ndarray, order: np.ndarray, item: np.ndarray, drift: int) -> np.ndarray:
    """Which of an item's words meet an equal word of a passage at the shift at which most do, ``drift`` places off at
    most. ``order`` sorts the passage's ``words``. A long item is aligned in pieces, each at its own shift."""
    if len(item) > PIECE:
        return np.concatenate([aligned(words, order, item[k : k + PIECE], drift) for k in range(0, len(item), PIECE)])
    known = words[order]
    low, high = np.searchsorted(known, item), np.searchsorted(known, item, "right")
    n = high - low
    i = np.repeat(np.arange(len(item)), n)
    out = np.zeros(len(item), bool)
    if len(i):
        shift = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)] - i + len(item)
        # a word counts once for each shift near to one of its own
        near = np.unique((i * (1 << 32))[:, None] + shift[:, None] + np.arange(2 * drift + 1)) & ((1 << 32) - 1)
        best = int(np.argmax(np.bincount(near))) - drift
        out[i[np.abs(shift - best) <= drift]] = True
    return out


@dataclass
class Postings:
    """One term's items with their impacts, and the last item and largest impact of each block."""

    items: list[int]
    impacts: list[float]
    last: list[int] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    top: float = 0.0

    def __post_init__(self):
        for i in range(0, len(self.items), BLOCK):
            self.last.append(self.items[min(i + BLOCK, len(self.items)) - 1])
            self.high.append(max(self.impacts[i : i + BLOCK]))
        self.top = max(self.high, default=0.0)


class Index:
    """A shard of items in flat arrays: ids, hashes of their words, postings by term. About 25 bytes a word of the
    items, in the driver and in each worker."""

    def __init__(self, rows: list[tuple[int | None, str]], frequency: dict[str, int], n_items: int, mean_words: float, threshold: float = THRESHOLD, passage_words: int = PASSAGE_WORDS, short: int = SHORT, drift: int = DRIFT):
        self.ids = [i for i, _ in rows]
        self.threshold = threshold
        self.terms: dict[str, int] = {}
        term, item, impact, longest = array("q"), array("q"), array("d"), 0
        self.short, self.drift = short, drift
        flat: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.begin, self.questions = np.zeros(len(rows) + 1, np.int64), np.zeros(len(rows), np.int64)
        for k, (_, text) in enumerate(rows):
            q, a = question_and_answer(text)
            words = words_of(text)
            longest = max(longest, len(words))
            flat.append(word_hashes(q + a))
            self.begin[k + 1], self.questions[k] = self.begin[k] + len(q) + len(a), len(q)
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            scores = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean_words)) for w, c in counts.items()}
            whole = sum(scores.values())
            for w, s in scores.items():
                term.append(self.terms.setdefault(w, len(self.terms)))
                item.append(k)
                impact.append(s / whole)
        self.words = np.concatenate(flat)
        self.passage = max(passage_words, 2 * longest)
        hashes = word_hashes(list(self.terms))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        del self.terms
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        t, i = place[np.array(term, np.int64)] if len(order) else np.zeros(0, np.int64), np.array(item, np.int64)
        by = np.lexsort((i, t))
        self.flat_items, self.flat_impacts = i[by].astype(np.int32), np.array(impact, float)[by]
        n = np.bincount(t, minlength=len(order))
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        # the commonest terms stand aside while they give no item half of the threshold
        aside = np.zeros(len(rows))
        self.essential = np.ones(len(order), bool)
        for t in np.argsort(-n, kind="stable").tolist():
            own = slice(self.first[t], self.first[t + 1])
            if n[t] < 2 or (aside[self.flat_items[own]] + self.flat_impacts[own]).max() > threshold / 2:
                break
            aside[self.flat_items[own]] += self.flat_impacts[own]
            self.essential[t] = False
        self.rest = threshold - aside - 1e-9

    def postings(self, term: int) -> Postings:
        own = slice(self.first[term], self.first[term + 1])
        return Postings(self.flat_items[own].tolist(), self.flat_impacts[own].tolist())

    def overlap(self, item: int, words: np.ndarray, order: np.ndarray) -> tuple[float, float]:
        """The parts of an item's question and answer that meet the passage; a missing question is met by the answer, a
        missing answer by the question."""
        mine, n = self.words[self.begin[item] : self.begin[item + 1]], int(self.questions[item])
        if len(mine) < self.short:
            met = float(aligned(words, order, mine, 0).all())
            return met, met
        met = aligned(words, order, mine, self.drift)
        if n in (0, len(mine)):
            return float(met.mean()), 1.0
        question, answer = float(met[:n].mean()), float(met[n:].mean())
        if answer < 1:
            alone = mine[n:]
            apart = aligned(words, order, alone, 0).all() if len(alone) < self.short else aligned(words, order, alone, self.drift).mean()
            answer = max(answer, float(apart))
        return question, answer

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items that score the threshold or more from distinct ``terms``."""
        need, end, found = self.threshold - 1e-9, len(self.ids), []
        lists = [self.postings(t) for t in terms]
        at = [0] * len(lists)
        doc = [p.items[0] for p in lists]
        order = list(range(len(lists)))

        def forward(c: int, to: int) -> None:
            """Moves cursor c to its first item from ``to`` on, by blocks."""
            items, last, i = lists[c].items, lists[c].last, at[c]
            b = i // BLOCK
            while b < len(last) and last[b] < to:
                b += 1
            i = max(i, b * BLOCK)
            while i < len(items) and items[i] < to:
                i += 1
            at[c] = i
            doc[c] = items[i] if i < len(items) else end

        while True:
            order.sort(key=doc.__getitem__)
            total, pivot = 0.0, -1
            for k, c in enumerate(order):
                if doc[c] >= end:
                    break
                total += lists[c].top
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = doc[order[pivot]]
            while pivot + 1 < len(order) and doc[order[pivot + 1]] == item:
                pivot += 1
            bound, until = 0.0, end
            for c in order[: pivot + 1]:
                b, last = at[c] // BLOCK, lists[c].last
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    bound += lists[c].high[b]
                    until = min(until, last[b] + 1)
            if bound < need:
                # no item before a block ends or the next list begins can reach the threshold
                to = max(item + 1, min(until, doc[order[pivot + 1]] if pivot + 1 < len(order) else end))
                for c in order[: pivot + 1]:
                    forward(c, to)
            elif doc[order[0]] == item:
                score = sum(lists[c].impacts[at[c]] for c in order[: pivot + 1])
                if score >= need:
                    found.append((item, score))
                for c in order[: pivot + 1]:
                    forward(c, item + 1)
            else:
                for c in order[:pivot]:
                    if doc[c] < item:
                        forward(c, item)

    def passages(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and end of each passage, and its text."""
        half = self.passage // 2
        halves = -(-w.counts // half)
        n = np.where(w.counts > 0, np.maximum(halves - 1, 1), 0)
        doc = np.repeat(np.arange(len(n)), n)
        start = w.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * half
        return start, np.minimum(start + self.passage, w.first[doc + 1]), doc

    def promising(self, w: Words, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The passages that upper bounds can't settle."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        hit = np.flatnonzero((term >= 0) & self.essential[term])
        low, high = np.searchsorted(hit, start), np.searchsorted(hit, end)
        n = high - low
        p = np.repeat(np.arange(len(start)), n)
        t = term[hit[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]]
        key = np.unique(p * len(self.hashes) + t)
        p, t = key // len(self.hashes), key % len(self.hashes)
        n = self.first[t + 1] - self.first[t]
        p = np.repeat(p, n)
        at = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[t], n)
        key, inverse = np.unique(p * len(self.ids) + self.flat_items[at], return_inverse=True)
        score = np.bincount(inverse, weights=self.flat_impacts[at], minlength=len(key))
        return np.unique(key[score >= self.rest[key % len(self.ids)]] // len(self.ids))

    def leaks(self, w: Words, question_overlap: float, answer_overlap: float) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """(text, item) -> score, overlap of question and answer, first word of the passage."""
        hashes = hash_strings(w.vocab) if w.n else np.zeros(0, np.uint64)
        term = self.terms_of(hashes)[w.ids] if w.n else np.zeros(0, np.int64)
        start, end, doc = self.passages(w)
        out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for p in self.promising(w, term, start, end).tolist():
            terms = np.unique(term[start[p] : end[p]])
            found = self.search(terms[terms >= 0].tolist())
            if not found:
                continue
            words = hashes[w.ids[start[p] : end[p]]]
            order = np.argsort(words, kind="stable")
            for item, score in found:
                question, answer = self.overlap(item, words, order)
                if question >= question_overlap and answer >= answer_overlap:
                    key, row = (int(doc[p]), item), (score, question, answer, int(start[p] - w.first[doc[p]]))
                    out[key] = max(out.get(key, row), row)
        return out


def shards(items: DataFrame, min_item_chars: int = MIN_ITEM_CHARS, shard_bytes: int = SHARD_BYTES, short: int = SHORT, **options) -> Iterator[Index]:
    """The index of ``items`` (item_id, text), a shard of bounded bytes at a time."""
    split = F.filter(F.split(F.translate("text", UPPER, LOWER), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    split = F.transform(split, lambda w: F.coalesce(F.nullif(F.btrim(w, F.lit(MARKS)), F.lit("")), w))
    rows = items.where("text is not null").select("item_id", "text", split.alias("words")).where((F.size("words") >= short) | ((F.size("words") > 0) & (F.char_length(F.btrim("text")) >= min_item_chars)))
    total = rows.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.octet_length("text"))).first()
    if not total[0]:
        return
    n = -(-total[2] // shard_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    frequency = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    for i in range(n):
        mine = rows.where(part == i)
        # bounded by shard_bytes
        texts = sorted(((r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        known = {r["word"]: r["count"] for r in frequency.join(mine.select(F.explode("words").alias("word")).distinct(), "word").collect()}
        yield Index(texts, known, total[0], total[1], short=short, **options)


def find_leaks(docs: DataFrame, items: DataFrame, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP, **options) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and passage_start for
    each text and each item that it holds."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"
    out = source.sparkSession.createDataFrame([], schema)
    for index in shards(items.select(F.col("item_id").cast("long"), "text"), **options):
        shared = source.sparkSession.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    found = shared.value.leaks(bare_words(part.column("text")), question_overlap, answer_overlap)
                    rows = pa.array([d for d, _ in found], pa.int64())
                    columns = [part.column("doc_id").take(rows), pa.array([shared.value.ids[i] for _, i in found], pa.int64())]
                    values = list(zip(*found.values(), strict=True)) or [[], [], [], []]
                    columns += [pa.array(v, t) for v, t in zip(values, (pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns; nothing is shuffled."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for index in shards(items.select(F.col("item_id").cast("long"), "text"), **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    keep = np.ones(len(part), bool)
                    keep[[d for d, _ in shared.value.leaks(bare_words(part.column("text")), question_overlap, answer_overlap)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
