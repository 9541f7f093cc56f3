"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest
hash of the ``m``-word runs in it. Consecutive windows with one minimiser share a
super-k-mer, which travels as one packed string to the minimiser's bucket; there the
windows of all super-k-mers are sorted, equal ones are confirmed word by word, and
the smallest doc_id of each is known exactly.

Nothing hot meets in one task: of equal super-k-mers that a map task sees, only those
of the smallest doc_id so far are sent, since every other document's windows in them
are already known to repeat a smaller one's. A bucket gets at most one document for
each task and super-k-mer, however many share it. Buckets are several times the
shuffle partitions and are worked on one at a time. A bucket of more than ``most`` bytes
is not solved where it is: its super-k-mers are cut again, by longer minimisers of
another hash, and go to the buckets of a second round, which are solved whole: only a
passage of ``k`` - SHORTER words with very many different surroundings fills one.

Defined results: a null or empty text has no words; a document is a doc_id, so equal
doc_ids never remove each other's words, though each of their rows loses words to
smaller ids; a null doc_id neither removes nor loses words; windows are judged on the
input; texts with fewer than ``k`` words lose nothing; columns of ``docs`` other than
those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, with_columns_of
from .text import Words, mix, roll, slices, starts_of_equal, tidy

K, M = 13, 3
#: Buckets for each shuffle partition.
BUCKETS = 16
#: A map task sends what it has gathered at so many bytes of super-k-mers.
SEND_BYTES = 12 << 20
#: Super-k-mers that a map task remembers with their smallest doc_id.
REMEMBERED = 100_000
#: Bytes of super-k-mers beyond which a bucket is cut again.
BUCKET_BYTES = 16 << 20
#: Words by which the minimisers of the second round are shorter than a window.
SHORTER = 4


def joined_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and where each begins."""
    size = w.end - w.start
    begins = np.zeros(w.n + 1, np.int64)
    np.cumsum(size + 1, out=begins[1:])
    out = np.full(int(begins[-1]), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    mask = np.zeros(len(w.data) + 1, np.int8)
    mask[w.start] += 1
    mask[w.end] -= 1
    out[inside] = w.data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    return out, begins


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def super_kmers(w: Words, k: int, m: int, again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and minimiser of each super-k-mer, by the first hash or another."""
    at = w.runs(k)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    h = w.hashes()
    grams = roll(np.concatenate([h, np.zeros(m, np.uint64)]), np.arange(w.n), m)
    low = grams = mix(~grams) if again else grams
    for j in range(1, k - m + 1):
        low = np.minimum(low[: len(low) - 1], grams[j:]) if j == 1 else np.minimum(low[: w.n - j], grams[j:])
    low = low[at]
    new = starts_of_equal(low, at - np.arange(len(at)))
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    return at[first], windows + k - 1, low[first]


def send_strings(gathered: list) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: its super-k-mers, joined by newlines, and where they stand."""
    if not gathered:
        return
    text = np.concatenate([g[0] for g in gathered])
    size, bucket, doc, key, pos = (np.concatenate([g[i] for g in gathered]) for i in range(1, 6))
    order = np.argsort(bucket, kind="stable")
    begins = (np.cumsum(size) - size)[order]
    size, bucket, doc, key, pos = size[order], bucket[order], doc[order], key[order], pos[order]
    cuts = np.flatnonzero(starts_of_equal(bucket))
    ends = np.append(cuts[1:], len(bucket))
    pack = zstandard.ZstdCompressor(1).compress
    strings = [pack(text[ranges(begins[a:b], size[a:b])].tobytes()) for a, b in zip(cuts, ends, strict=True)]
    places = [pack(doc[a:b].tobytes() + key[a:b].tobytes() + pos[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(strings, pa.binary()), pa.array(places, pa.binary())], ["bucket", "strings", "places"])


def _known(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: int) -> pa.RecordBatch:
    """Intervals that need no bucket's verdict, in a row without super-k-mers."""
    body = zstandard.ZstdCompressor(1).compress(np.stack([doc, key, start, end]).astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([b""], pa.binary()), pa.array([body], pa.binary())], ["bucket", "strings", "places"])


def _deal(k: int, m: int, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: dict[bytes, int] = {}
        gathered, held, turn = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                first, n, low = super_kmers(w, k, m)
                if not len(first):
                    continue
                text, begins = joined_words(w)
                size = begins[first + n] - begins[first]
                out = text[ranges(begins[first], size)]
                byte_end = np.cumsum(size)
                out[byte_end - 1] = 10
                offsets = np.concatenate([[0], byte_end])
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                owner = w.doc[first]
                doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                key = part.column("key").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                pos = first - w.first[owner]
                strings = coded.dictionary.to_pylist()
                least = np.full(len(strings), np.iinfo(np.int64).max)
                np.minimum.at(least, code, doc)
                earlier = np.fromiter((seen.get(s, np.iinfo(np.int64).max) for s in strings), np.int64, len(strings))
                least = np.minimum(least, earlier)
                if len(seen) > REMEMBERED:
                    seen.clear()
                for c in np.flatnonzero((np.bincount(code, minlength=len(strings)) > 1) | (least > earlier)):
                    seen[strings[c]] = int(least[c])
                decided = doc > least[code]
                if decided.any():
                    turn = (turn + 1) % buckets
                    yield _known(doc[decided], key[decided], pos[decided], (pos + n)[decided], turn)
                ask = ~decided
                begin = byte_end - size
                sent = out[ranges(begin[ask], size[ask])]
                gathered.append((sent, size[ask], (low[ask] % np.uint64(buckets)).astype(np.int32), doc[ask], key[ask].astype(np.int32), pos[ask].astype(np.int32)))
                held += len(sent)
                if held > SEND_BYTES:
                    yield from send_strings(gathered)
                    gathered, held = [], 0
        yield from send_strings(gathered)

    return run


def _unpacked(places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, key and first word of packed super-k-mers."""
    docs, keys, poss = [], [], []
    for body in map(zstandard.ZstdDecompressor().decompress, places):
        n = len(body) // 16
        docs.append(np.frombuffer(body, np.int64, n))
        keys.append(np.frombuffer(body, np.int32, n, 8 * n))
        poss.append(np.frombuffer(body, np.int32, n, 12 * n))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(poss)


def _words_of(strings: list[bytes]) -> Words:
    """The words of packed super-k-mers, each of them as a text."""
    data = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, strings)), np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return Words(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)))


def _cut_again(strings: bytes, places: bytes, k: int, m: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Packed super-k-mers, cut by the minimisers of another hash, as send_strings takes them."""
    w, (doc, key, pos) = _words_of([strings]), _unpacked([places])
    first, n, low = super_kmers(w, k, max(m, k - SHORTER), again=True)
    text, begins = joined_words(w)
    size = begins[first + n] - begins[first]
    out = text[ranges(begins[first], size)]
    out[np.cumsum(size) - 1] = 10
    owner = w.doc[first]
    return out, size, (low % np.uint64(buckets)).astype(np.int32), doc[owner], key[owner], (pos[owner] + first - w.first[owner]).astype(np.int32)


def match_windows(strings: list[bytes], places: list[bytes], k: int) -> tuple[np.ndarray, ...] | None:
    """Of one bucket: doc_id, key, start and end of runs of windows that have a smaller
    doc_id elsewhere, that doc_id for the first window, and a hash of the first window's words."""
    w, (doc, key, pos) = _words_of(strings), _unpacked(places)
    at = w.runs(k)
    owner = w.doc[at]
    window = roll(mix(w.ids.astype(np.uint64)), at, k)
    order = np.argsort(window, kind="stable")
    window = window[order]
    same = ~starts_of_equal(window)
    i = np.flatnonzero(same)
    if not len(i):
        return None
    for j in range(k):
        if (w.ids[at[order[i]] + j] != w.ids[at[order[i - 1]] + j]).any():  # a collision of hashes
            columns = [w.ids[at + x] for x in range(k)]
            order = np.lexsort(columns)
            same = ~starts_of_equal(*(c[order] for c in columns))
            break
    begin = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[owner[order]], begin), np.diff(np.append(begin, len(order))))
    flag = np.zeros(len(at), bool)
    flag[order] = doc[owner[order]] > least
    source = np.empty(len(at), np.int64)
    source[order] = least
    hit = np.flatnonzero(flag)
    if not len(hit):
        return None
    cut = np.flatnonzero(starts_of_equal(hit - np.arange(len(hit)), owner[hit]))
    last = np.append(cut[1:], len(hit)) - 1
    s = owner[hit[cut]]
    shift = at[hit[cut]] - w.first[s]
    start = pos[s] + shift
    return doc[s], key[s].astype(np.int64), start, start + (hit[last] - hit[cut]) + k, source[hit[cut]], roll(w.hashes(), at[hit[cut]], k).view(np.int64)


def _solve(k: int, m: int, buckets: int, most: int | None):
    """Rows of intervals, and the super-k-mers of buckets of more than ``most`` bytes, cut again."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strings, places, held = None, [], [], 0
        gathered, waiting = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            if strings and (found := match_windows(strings, places, k)) is not None:
                yield _known(*found[:4], now)

        for batch in batches:
            for bucket, s, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "strings", "places")), strict=True):
                if not s:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "strings": pa.array([s], pa.binary()), "places": pa.array([p], pa.binary())})
                    continue
                if bucket != now:
                    yield from finish()
                    now, strings, places, held = bucket, [], [], 0
                strings.append(s)
                places.append(p)
                held += zstandard.frame_content_size(s)
                if most is None or held <= most:
                    continue
                for pair in zip(strings, places, strict=True):  # the rows held so far, from then on each as it comes
                    gathered.append(_cut_again(*pair, k, m, buckets))
                    waiting += len(gathered[-1][0])
                    if waiting > SEND_BYTES:
                        yield from send_strings(gathered)
                        gathered, waiting = [], 0
                strings, places = [], []
        yield from finish()
        yield from send_strings(gathered)

    return run


@tidy
def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in map(zstandard.ZstdDecompressor().decompress, batch.column("places").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(body, np.int64).reshape(4, -1)], ["doc_id", "key", "start", "end"])


def repeated_intervals(docs: DataFrame, k: int = K, m: int = M, most: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, key (a hash of the text), start and end (words) of runs of windows that
    also start in a document with a smaller doc_id; intervals may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, packed = BUCKETS * partitions, "bucket int, strings binary, places binary"
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.shiftright(F.xxhash64("text"), 32).alias("key"), "text")
    dealt = lambda rows: rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    first = stored(dealt(source.mapInArrow(_deal(k, m, buckets), packed)).mapInArrow(_solve(k, m, buckets, most), packed), "first-buckets")
    second = dealt(first.where("octet_length(strings) > 0")).mapInArrow(_solve(k, m, buckets, None), packed)
    return first.where("octet_length(strings) = 0").unionByName(second).mapInArrow(_intervals, "doc_id long, key long, start long, end long")


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, with_text: bool = False, most: int = BUCKET_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the kept
    words joined by one space and, if asked for, kept_text."""
    spans = stored(repeated_intervals(docs, k, m, most).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-windows")
    source = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.shiftright(F.xxhash64("text"), 32))
    joined = with_columns_of(source, spans, "doc_id", "key").select("doc_id", "text", "spans")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                text, begins = joined_words(w)
                spans = part.column("spans")
                start, end = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                owner = np.repeat(np.arange(len(part)), np.asarray(spans.value_lengths().fill_null(0)))
                edge = np.zeros(w.n + 1, np.int64)
                np.add.at(edge, start + w.first[owner], 1)
                np.add.at(edge, end + w.first[owner], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[w.first[1:]] - removed[w.first[:-1]]
                keep = text[np.repeat(~gone, np.diff(begins))].tobytes()
                sizes = np.concatenate([[0], np.cumsum(np.diff(begins) * ~gone)])[w.first]
                kept = [keep[a : max(a, b - 1)] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
                columns = [part.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
