"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text only those at content-selected positions are retained: of
every ``window`` neighbouring positions the one whose ``m``-word run has the smallest
hash. A passage of ``min_words`` words that two documents share holds one such position
at the same place, with ``prefix`` words of the passage behind it. The suffixes' first
``prefix`` words are dealt by their hash and sorted; a suffix equal to a neighbour from
another document is a match. Only then the words to the left and right of the matches
are fetched - no more than a passage at this position can use - and matches are extended
to both sides: every place of ``min_words`` words across the position is compared.

Nothing hot meets in one task: a map task sends a prefix for two documents only (any
other document is known to match), and equal surroundings for the smallest doc_id only.
The others' source is that doc_id at first; where a bucket or another task names a
smaller one for the same passage (by a 64-bit hash of its words), that one replaces it.

Defined results: spans are runs of words of a document that occur, in passages of
``min_words`` words or more, in a document with a smaller doc_id; source_doc_id is the
smallest doc_id that has the span's first passage. Null texts have no words, texts
shorter than ``min_words`` no spans; rows of one doc_id don't match each other, and
equal rows get their spans once; null doc_ids take no part; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_by, picked, stored
from .substrings import BUCKETS, REMEMBERED, SEND_BYTES, joined_words, match_windows, ranges, send_strings
from .text import Words, roll, slices, starts_of_equal, tidy

MIN_WORDS, M = 50, 4
_LEAST = np.iinfo(np.int64).max


def retained(w: Words, window: int, m: int, grams: np.ndarray) -> np.ndarray:
    """The positions whose run of m words is the smallest of some ``window`` positions."""
    at = w.runs(window + m - 1)
    if not len(at):
        return at
    low, pick = grams, np.arange(w.n)
    for j in range(1, window):
        ahead = grams[j:]
        less = ahead < low[: len(ahead)]
        pick = np.where(less, np.arange(j, w.n), pick[: len(ahead)])
        low = np.where(less, ahead, low[: len(ahead)])
    return np.unique(pick[at])


def _gather(w: Words, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The words of each range as one string with a newline: bytes, sizes and code."""
    text, begins = joined_words(w)
    size = begins[first + n] - begins[first]
    out = text[ranges(begins[first], size)]
    ends = np.cumsum(size)
    out[ends - 1] = 10
    return out, size, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(out)]).dictionary_encode()


def _parts(part: pa.RecordBatch, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[owner] for c in ("doc_id", "key"))


def _rows(doc, key, pos, n, source, passage) -> pa.RecordBatch:
    body = zstandard.ZstdCompressor(1).compress(np.stack([doc, key, pos, pos + n, source, passage]).astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([body], pa.binary())], ["bucket", "strings", "places"])


def _deal_prefixes(window: int, prefix: int, m: int, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, ...]] = {}
        gathered, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                h = w.hashes()
                grams = roll(np.concatenate([h, np.zeros(m, np.uint64)]), np.arange(w.n), m)
                first = retained(w, window, m, grams)
                first = first[np.isin(first, w.runs(prefix), assume_unique=True)]
                if not len(first):
                    continue
                n = np.full(len(first), prefix)
                out, size, coded = _gather(w, first, n)
                code, strings = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                owner = w.doc[first]
                doc, key = _parts(part, owner)
                pos = first - w.first[owner]
                # a prefix is sent for two documents of a task; the others have matches for certain
                order = np.lexsort((doc, code))
                new = starts_of_equal(code[order], doc[order])
                group = np.cumsum(new) - 1
                rank = np.empty(len(first), np.int64)
                head = np.flatnonzero(starts_of_equal(code[order]))
                rank[order] = group - np.repeat(group[head], np.diff(np.append(head, len(order))))
                if len(seen) > REMEMBERED:
                    seen.clear()
                had = [seen.get(s, ()) for s in strings]
                rank += np.fromiter(map(len, had), np.int64, len(had))[code]
                repeated = np.fromiter((len(x) > 0 for x in had), bool, len(had))
                for i in np.flatnonzero(repeated[code]).tolist():
                    if int(doc[i]) in had[code[i]]:
                        rank[i] = 0
                ask = rank < 2
                often = np.bincount(code, minlength=len(strings)) > 1
                for i in np.flatnonzero(ask & (often | repeated)[code]).tolist():
                    s = strings[code[i]]
                    if int(doc[i]) not in seen.get(s, ()):
                        seen[s] = (*seen.get(s, ()), int(doc[i]))
                if not ask.all():
                    yield _rows(doc[~ask], key[~ask], pos[~ask], n[~ask], doc[~ask], pos[~ask])
                bucket = (roll(h, first, prefix) % np.uint64(buckets)).astype(np.int32)
                begin = np.cumsum(size) - size
                sent = out[ranges(begin[ask], size[ask])]
                gathered.append((sent, size[ask], bucket[ask], doc[ask], key[ask].astype(np.int32), pos[ask].astype(np.int32)))
                held += len(sent)
                if held > SEND_BYTES:
                    yield from send_strings(gathered)
                    gathered, held = [], 0
        yield from send_strings(gathered)

    return run


def _unpacked(strings: list[bytes], places: list[bytes]):
    unpack = zstandard.ZstdDecompressor().decompress
    docs, keys, poss = [], [], []
    for body in map(unpack, places):
        n = len(body) // 16
        docs.append(np.frombuffer(body, np.int64, n))
        keys.append(np.frombuffer(body, np.int32, n, 8 * n))
        poss.append(np.frombuffer(body, np.int32, n, 12 * n))
    data = np.frombuffer(b"".join(map(unpack, strings)), np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return np.concatenate(docs), np.concatenate(keys).astype(np.int64), np.concatenate(poss).astype(np.int64), text


def _matching(strings: list[bytes], places: list[bytes]):
    """The suffixes whose sorted neighbour has the same prefix in another document."""
    doc, key, pos, text = _unpacked(strings, places)
    coded = text.dictionary_encode()  # a rank for each distinct prefix, in sorted order
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    order = np.lexsort((doc, code))
    code, doc, key, pos = code[order], doc[order], key[order], pos[order]
    near = np.zeros(len(doc), bool)
    other = (code[1:] == code[:-1]) & (doc[1:] != doc[:-1])
    near[1:] |= other
    near[:-1] |= other
    begin = np.flatnonzero(starts_of_equal(code))
    hit = np.repeat(np.logical_or.reduceat(near, begin), np.diff(np.append(begin, len(code))))
    return doc[hit], key[hit], pos[hit], pos[hit], doc[hit], pos[hit]


def _deal_surroundings(window: int, prefix: int, min_words: int, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        gathered, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                lists = part.column("places")
                owner = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + w.first[owner]
                first = np.maximum(at - window + 1, w.first[owner])
                end = np.minimum(at + min_words, w.first[owner + 1])
                wide = end - first >= min_words
                owner, at, first, end = owner[wide], at[wide], first[wide], end[wide]
                if not len(at):
                    continue
                h = w.hashes()
                bucket = (roll(h, at, prefix) % np.uint64(buckets)).astype(np.int32)
                out, size, coded = _gather(w, first, end - first)
                code, strings = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                doc, key = _parts(part, owner)
                pos = first - w.first[owner]
                earlier = np.fromiter((seen.get(s, _LEAST) for s in strings), np.int64, len(strings))
                least = earlier.copy()
                np.minimum.at(least, code, doc)
                if len(seen) > REMEMBERED:
                    seen.clear()
                for c in np.flatnonzero((np.bincount(code, minlength=len(strings)) > 1) | (least > earlier)).tolist():
                    seen[strings[c]] = int(least[c])
                decided = doc > least[code]
                if decided.any():
                    yield _rows(doc[decided], key[decided], pos[decided], (end - first)[decided], least[code][decided], roll(h, first[decided], min_words).view(np.int64))
                ask = ~decided
                begin = np.cumsum(size) - size
                sent = out[ranges(begin[ask], size[ask])]
                gathered.append((sent, size[ask], bucket[ask], doc[ask], key[ask].astype(np.int32), pos[ask].astype(np.int32)))
                held += len(sent)
                if held > SEND_BYTES:
                    yield from send_strings(gathered)
                    gathered, held = [], 0
        yield from send_strings(gathered)

    return run


def _per_bucket(solve):
    """Works on one bucket at a time; rows without strings pass."""
    names = ["doc_id", "key", "start", "end", "source_doc_id", "passage"]

    def rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int64()) for c in columns], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strings, places = None, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if strings and (found := solve(strings, places)) is not None:
                yield rows(found)

        for batch in batches:
            for bucket, s, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "strings", "places")), strict=True):
                if not s:
                    yield rows(np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.int64).reshape(6, -1))
                    continue
                if bucket != now:
                    yield from finish()
                    now, strings, places = bucket, [], []
                strings.append(s)
                places.append(p)
        yield from finish()

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, m: int = M) -> DataFrame:
    """doc_id, start_word, end_word (from 0, end excluded), n_words and source_doc_id of
    each span that repeats passages of a document with a smaller doc_id."""
    window = min_words // 2 + 1
    prefix = min_words - window
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions
    packed, found = "bucket int, strings binary, places binary", "doc_id long, key long, start long, end long, source_doc_id long, passage long"
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.shiftright(F.xxhash64("text"), 32).alias("key"), "text")
    # rows without strings are known already and are dealt anywhere
    spread = F.when(F.octet_length("strings") > 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("places"), F.lit(buckets)).cast("int"))
    dealt = lambda rows: rows.withColumn("bucket", spread).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    matches = dealt(source.mapInArrow(_deal_prefixes(window, prefix, m, buckets), packed)).mapInArrow(_per_bucket(_matching), found)
    places = stored(matches.groupBy("doc_id", "key").agg(F.collect_set("start").alias("places")), "suffix-matches")
    texts = picked(source, places, "doc_id", "key")
    spans = stored(dealt(texts.mapInArrow(_deal_surroundings(window, prefix, min_words, buckets), packed)).mapInArrow(_per_bucket(lambda s, p: match_windows(s, p, min_words)), found).distinct(), "suffix-spans")
    # passages whose rows don't agree on the smallest doc_id that has them
    agreed = spans.groupBy("passage").agg(F.min("source_doc_id").alias("least"), F.max("source_doc_id").alias("most"), F.count("*").alias("size")).where("least < most").drop("most")
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end", "source_doc_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc_id", "key", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min_by(F.struct("source_doc_id", "passage"), F.struct("start", "source_doc_id")).alias("source"))
    merged = stored(merged.withColumn("passage", F.col("source.passage")), "suffix-runs")
    merged = joined_by(merged, stored(agreed, "suffix-sources"), ["passage"], "size", "left").withColumn("source_doc_id", F.coalesce("least", "source.source_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id")
