"""Line dedup: an exact set-similarity self-join over lines.

A line's set holds its distinct words (A-Z lower-cased), lines of fewer than
``min_tokens`` distinct words are left alone: the query and the pipeline ask for 1, all
lines with a word. A set so small that one more word is too many for ``percent`` has
equal partners only and needs no prefix. Tokens are ordered by rarity: words are
counted over all documents in hashed slots of fixed number, ties go by hash. Two lines
of similarity ``percent`` share a token among the first n - ceil(percent n / 100) + 1
of the longer one and the first n - ceil(2 percent n / (100 + percent)) + 1 of the
shorter one. Prefixes are packed by buckets of their tokens, those of a token that many
lines have (by its count) by buckets of its parts. In a bucket each line is paired with
a bounded number of lines of its token, neighbours in size and the first ones of
about its size, and pairs pass the length filter, the positional filter and a bitmap
filter (each token flips one of 128 bits, so the bits that differ bound the tokens that
differ). Of the earlier lines that are left, each line is compared exactly with the few of
each bucket whose bitmaps are closest; one match settles it, so a large group of similar
lines never becomes all its pairs. A line that is not settled is compared with the rest
of the bucket's list. Tokens of lines that may have other partners are listed whole; if
such a line is still not settled, it meets all lines of these tokens in cells of bounded
size, where products of token matrices compare all pairs exactly. A token whose slot
counts one line has no partner and is not sent.

A line that has an earlier match - equal or similar, at a smaller (doc_id, line number)
of the input - is removed. Equal sets are one node, however often they occur: a node
needs its first place only.

Defined results: a null text has no lines and stays null, an empty one has one; rows
of one doc_id and text are treated alike, line by line, and never remove each other's
equal places; a null doc_id neither removes nor loses lines; a text whose lines all go
becomes empty; other columns are carried through where documents are returned. Sets
are compared by 50-bit hashes of words, nodes by 64-bit hashes of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rarity import block_rows, classes_of, slot, tally
from .setjoin import TOKEN_BITS, Sets, in_cells, shared_counts
from .shared import joined_by, picked, stored, with_columns_of
from .text import mix, raw, slices, starts_of_equal, tidy

PERCENT, MIN_TOKENS = 80, 5
#: Slots of the word counts, by the number of documents.
LEAST_SLOTS, MOST_SLOTS, DOCUMENTS_A_SLOT = 1 << 20, 1 << 24, 1 / 64
#: Candidates of a line that are compared at first, and that a bucket lists.
CLOSEST, LISTED = 4, 16
#: Buckets for each shuffle partition; entries that a map task gathers before it sends; pairs formed at once.
BUCKETS, SEND_ENTRIES, PAIRS = 8, 200_000, 1 << 18
#: Sets that a map task remembers as sent.
REMEMBERED = 100_000
_LAST = np.iinfo(np.int64).max
#: ``token`` has SPLIT set where the token's lines are dealt over several buckets.
ENTRY = np.dtype([("token", "<u8"), ("n", "<u4"), ("at", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("node", "<i8"), ("bits0", "<u8"), ("bits1", "<u8")])
SPLIT = np.uint64(1) << np.uint64(63)
#: Lines of a token (as a power of two) beyond which it is split, and its parts at most.
PART_BITS, MOST_PARTS_BITS = 13, 20
#: Of a token's lines in order of size, each is paired with so many that follow, and with so many first ones of each size.
WINDOW, FIRST = 512, 4
#: Lines a side of a cell.
SQUARE = 1024


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines that are not empty at a text's end, the text of each and its number there."""
    data, offsets = raw(texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc]
    ends = np.append(starts, len(data))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)), doc, number


def line_sets(part: pa.RecordBatch) -> Iterator[tuple[Sets, np.ndarray, np.ndarray]]:
    """Sets of a slice's lines, the text and the number of each line."""
    lines, doc, number = lines_of(part.column("text"))
    step = 1 << (64 - TOKEN_BITS)
    for a in range(0, len(lines), step):
        yield Sets(lines.slice(a, step), 1), doc[a : a + step], number[a : a + step]


def _survey(min_tokens: int, slots: int):
    names = ["doc_id", "key", "line", "node", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                doc_id, key = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
                for s, doc, number in line_sets(part):
                    tally(counts, slot(s.token, slots))
                    some = s.n >= min_tokens
                    d = doc[some]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id[d]), pa.array(key[d]), pa.array(number[some], pa.int32()), pa.array(s.nodes()[some]), pa.nulls(len(d), pa.int32()), pa.nulls(len(d), pa.binary())], names)
        blocks, bodies = block_rows(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), t) for t in kinds] + [blocks, bodies], names)

    return run


def index_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _bitmaps(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    bit = mix(s.token) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    return s.per_doc(np.bitwise_xor, np.where(bit < 64, one, np.uint64(0))), s.per_doc(np.bitwise_xor, np.where(bit >= 64, one, np.uint64(0)))


def _packed(entry: np.ndarray) -> bytes:
    """Entries, a column after the other, compressed."""
    return zstandard.ZstdCompressor(1).compress(b"".join([np.ascontiguousarray(entry[c]).tobytes() for c in ENTRY.names]))


def _unpacked(body: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(body)
    entry, at = np.empty(len(data) // ENTRY.itemsize, ENTRY), 0
    for c in ENTRY.names:
        entry[c] = np.frombuffer(data, ENTRY[c], len(entry), at)
        at += ENTRY[c].itemsize * len(entry)
    return entry


def _part_of(rarity: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token of this class is split, and the part that a node goes to."""
    bits = np.clip((rarity.astype(np.int64) + 3) // 4 - PART_BITS, 0, MOST_PARTS_BITS).astype(np.uint64)
    return bits > 0, mix(node.view(np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))


def _entries(percent: int, min_tokens: int, classes, buckets: int):
    def send(held: list[np.ndarray], bucket: list[np.ndarray]) -> pa.RecordBatch:
        entry, to = np.concatenate(held), np.concatenate(bucket)
        order = np.argsort(to, kind="stable")
        entry, to = entry[order], to[order]
        cuts = np.flatnonzero(starts_of_equal(to))
        bodies = [_packed(entry[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "entries"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, n = [], [], 0
        sent: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for s, doc, number in line_sets(part):
                    nodes, ids_of = s.nodes(), ids[doc]
                    fresh = np.zeros(len(nodes), bool)
                    for i in np.flatnonzero((s.n >= min_tokens) & (100 * s.n >= percent * (s.n + 1))).tolist():
                        place = (int(ids_of[i]), int(number[i]))
                        if place < sent.get(int(nodes[i]), (_LAST,)):
                            fresh[i] = True
                            sent[int(nodes[i])] = place
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    rarity = classes.value[slot(s.token, len(classes.value))]
                    at, place = s.prefix_places(rarity, 0, percent)
                    take = fresh[s.doc[at]] & (rarity[at] > 0)
                    at, place = at[take], place[take]
                    if not len(at):
                        continue
                    d, (b0, b1) = s.doc[at], _bitmaps(s)
                    entry = np.empty(len(at), ENTRY)
                    split, part_of = _part_of(rarity[at], nodes[d])
                    entry["token"], entry["n"], entry["at"], entry["node"], entry["bits0"], entry["bits1"] = s.token[at] | SPLIT * split.astype(np.uint64), s.n[d], place, nodes[d], b0[d], b1[d]
                    entry["doc"], entry["line"] = ids_of[d], number[d]
                    held.append(entry)
                    bucket.append((mix(s.token[at] ^ part_of << np.uint64(TOKEN_BITS)) % np.uint64(buckets)).astype(np.int32))
                    n += len(at)
                    if n > SEND_ENTRIES:
                        yield send(held, bucket)
                        held, bucket, n = [], [], 0
        if held:
            yield send(held, bucket)

    return run


def _ordered(entry: np.ndarray) -> np.ndarray:
    """By token, size and node, one entry of each, the one of the node's first place."""
    order = np.lexsort((entry["line"], entry["doc"], entry["node"], entry["n"], entry["token"]))
    entry = entry[order]
    return entry[starts_of_equal(entry["token"], entry["n"], entry["node"])]


class _Bucket:
    """One bucket's entries in order, and the pairs that its tokens give."""

    def __init__(self, entry: np.ndarray, percent: int):
        self.entry, self.percent = entry, percent
        self.n, self.at, self.doc, self.line = (entry[c].astype(np.int64) for c in ("n", "at", "doc", "line"))
        self.group = np.cumsum(starts_of_equal(entry["token"])) - 1
        code = self.group << 32 | self.n
        high = np.searchsorted(code, self.group << 32 | 100 * self.n // percent, "right")
        here = np.arange(len(entry))
        self.end = np.minimum(high, here + 1 + WINDOW)
        # entries with partners of their token outside the window, or in other buckets
        edge = np.zeros(len(entry) + 1, np.int64)
        far = np.flatnonzero(high > self.end)
        np.add.at(edge, self.end[far], 1)
        np.add.at(edge, high[far], -1)
        self.more = np.cumsum(edge[:-1]) > 0
        self.more[far] = True
        self.more |= (entry["token"] & SPLIT) > 0

    def _passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of entries, the i's no larger: nodes (later, earlier) of those that pass
        the filters, and how many bits they differ in."""
        n, at, doc, line, entry, percent = self.n, self.at, self.doc, self.line, self.entry, self.percent
        need = (percent * (n[i] + n[j]) + 99 + percent) // (100 + percent)
        ok = (100 * n[i] >= percent * n[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        apart = sum(np.bitwise_count(entry[k][i] ^ entry[k][j]).astype(np.int64) for k in ("bits0", "bits1"))
        ok = (n[i] + n[j] - apart >= 2 * need) & ((doc[i] != doc[j]) | (line[i] != line[j]))
        i, j, apart = i[ok], j[ok], apart[ok]
        swap = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return entry["node"][i], entry["node"][j], apart

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each entry with those in its window, then, of tokens that the window is too narrow
        for, with the first places of about its size: their number grows with the entries."""
        x = np.flatnonzero(self.at < index_length(self.n, self.percent))
        many = np.maximum(self.end[x] - x - 1, 0)
        x, many = x[many > 0], many[many > 0]
        done = np.cumsum(many)
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
            c = many[a:b]
            i = np.repeat(x[a:b], c)
            yield self._passing(i, np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1)
            a = b
        x = np.flatnonzero(self.more)
        if not len(x):
            return
        size = np.floor(np.log(np.maximum(self.n[x], 1)) / np.log(100 / self.percent) + 1e-9).astype(np.int64)
        kind = self.group[x] << 20 | size
        order = np.lexsort((self.line[x], self.doc[x], kind))
        begin = np.flatnonzero(starts_of_equal(kind[order]))
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        first = order[place < FIRST]
        firsts, at = kind[first], x[first]
        for a in range(0, len(x), PAIRS // (8 * FIRST)):
            part, asked = x[a : a + PAIRS // (8 * FIRST)], kind[a : a + PAIRS // (8 * FIRST)]
            for step in (-1, 0, 1):
                low, high = np.searchsorted(firsts, asked + step), np.searchsorted(firsts, asked + step, "right")
                i = np.repeat(part, high - low)
                j = at[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
                swap = self.n[i] > self.n[j]
                yield self._passing(np.where(swap, j, i), np.where(swap, i, j))


def _closest(later: np.ndarray, earlier: np.ndarray, apart: np.ndarray, more: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """Each later node's closest earlier nodes in order, and whether it has others."""
    order = np.lexsort((earlier, later))
    order = order[starts_of_equal(later[order], earlier[order])]
    order = order[np.lexsort((apart[order], later[order]))]
    later, earlier, apart, more = later[order], earlier[order], apart[order], more[order]
    first = np.flatnonzero(starts_of_equal(later))
    n = np.diff(np.append(first, len(later)))
    more = np.repeat(np.logical_or.reduceat(more, first) | (n > listed), n) if len(first) else more
    keep = np.arange(len(later)) - np.repeat(first, n) < listed
    return later[keep], earlier[keep], apart[keep], more[keep]


def _candidates(percent: int, listed: int):
    """For each later node of a bucket its earlier candidates, the closest first. Where a
    list is cut, the nodes of all its tokens there follow, in rows with a token."""
    names = ["a", "bs", "more", "token"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            entry = _ordered(np.concatenate(held))
            bucket = _Bucket(entry, percent)
            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
            for a, b, apart in bucket.pairs():
                best = _closest(*(np.concatenate(x) for x in zip(best, (a, b, apart, np.zeros(len(a), bool)), strict=True)), listed)
            a, b, _, more = best
            first = np.flatnonzero(starts_of_equal(a))
            open_ = np.unique(entry["node"][bucket.more])
            without = np.setdiff1d(open_, a[first], assume_unique=True)
            nodes = np.concatenate([a[first], without])
            ends = np.concatenate([first, np.full(len(without) + 1, len(a))])
            more = np.concatenate([more[first] | np.isin(a[first], open_), np.ones(len(without), bool)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(b))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), lists, pa.array(more), pa.nulls(len(nodes), pa.int64())], names)
            if more.any():
                tokens = np.unique(entry["token"][np.isin(entry["node"], nodes[more])])
                whole = entry[np.isin(entry["token"], tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(whole["node"]), pa.nulls(len(whole), pa.list_(pa.int64())), pa.array(np.zeros(len(whole), bool)), pa.array((whole["token"] & ~SPLIT).astype(np.int64))], names)

        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if bucket != now:
                    yield from finish()
                    now, held = bucket, []
                held.append(_unpacked(body))
        yield from finish()

    return run


def _cell(percent: int):
    """The asking nodes of a cell that have an earlier match in it."""

    def run(table: pa.Table) -> pa.Table:
        node, asks, doc, line = (table.column(c).to_numpy() for c in ("node", "asks", "doc", "line"))
        lists = [np.asarray(x.values) for x in table.column("tokens")]
        n = np.array([len(x) for x in lists])
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        common = shared_counts([lists[i] for i in a], [lists[i] for i in b])
        linked = 100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)
        linked &= (doc[b][None, :] < doc[a][:, None]) | ((doc[b][None, :] == doc[a][:, None]) & (line[b][None, :] < line[a][:, None]))
        return pa.table({"node": node[a[linked.any(axis=1)]]})

    return run


@tidy
def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            lists = part.column("lines")
            wanted = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths())) << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for s, doc, number in line_sets(part):
                rows = np.flatnonzero(np.isin(doc << 32 | number, wanted))
                sets = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), pa.array(s.token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.nodes()[rows]), sets.take(pa.array(rows))], ["node", "tokens"])


def later_matches(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS, closest: int = CLOSEST, listed: int = LISTED) -> DataFrame:
    """doc_id, key (a hash of the text) and line numbers (counted from 0) of the lines that have an earlier match."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    slots = 1 << max(LEAST_SLOTS.bit_length() - 1, min(MOST_SLOTS.bit_length() - 1, int(docs.count() / DOCUMENTS_A_SLOT).bit_length() - 1))
    survey = stored(source.mapInArrow(_survey(min_tokens, slots), "doc_id long, key long, line int, node long, block int, counts binary"), "lines")
    classes = spark.sparkContext.broadcast(classes_of(survey, slots))
    lines = survey.where("block is null").select("doc_id", "key", "line", "node")
    nodes = stored(lines.groupBy("node").agg(F.min(F.struct("doc_id", "line", "key")).alias("first"), F.count("*").alias("n")), "nodes")
    entries = source.select("doc_id", "text").mapInArrow(_entries(percent, min_tokens, classes, BUCKETS * partitions), "bucket int, entries binary")
    # part of a split token, or all of another one, in a bucket
    entries = entries.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The token sets of nodes, from their first places."""
        at = stored(wanted.join(nodes, "node").groupBy("first.doc_id", "first.key").agg(F.collect_set("first.line").alias("lines")), "wanted")
        texts = picked(source, at, "doc_id", "key").dropDuplicates(["doc_id", "key"])  # as they are dealt already
        return stored(texts.select("text", "lines").mapInArrow(_wanted_sets, "node long, tokens array<long>"), "line-sets")

    def matched(pairs: DataFrame) -> DataFrame:
        """The later nodes of those pairs whose sets are similar."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
        return stored(both.where(f"100 * common >= {percent} * (size(x) + size(y) - common)").select(F.col("a").alias("node")).distinct(), "matched")

    rows = stored(entries.mapInArrow(_candidates(percent, listed), "a long, bs array<long>, more boolean, token long"), "candidates")
    lists = rows.where("token is null")
    settled = matched(stored(lists.select("a", F.explode(F.slice("bs", 1, closest)).alias("b")).distinct(), "pairs"))
    rest = stored(lists.where(F.size("bs") > closest).join(settled.withColumnRenamed("node", "a"), "a", "left_anti").select("a", F.explode(F.slice("bs", closest + 1, listed)).alias("b")).distinct(), "pairs")
    if not rest.isEmpty():
        settled = stored(settled.unionByName(matched(rest)).distinct(), "matched")
    cut = stored(lists.where("more").select(F.col("a").alias("node")).distinct().join(settled, "node", "left_anti"), "cut")
    if not cut.isEmpty():
        whole = stored(rows.where("token is not null").select("token", F.col("a").alias("node")).distinct().join(cut.withColumn("asked", F.lit(True)).hint("merge"), "node", "left"), "cut-tokens")
        asked = whole.groupBy("token").agg(F.count("asked").alias("n"), F.count("*").alias("size")).where("n > 0")
        whole = stored(joined_by(whole, stored(asked, "asked-tokens"), ["token"], "size").select("token", "node", F.coalesce("asked", F.lit(False)).alias("asked"), "size", "n"), "cut-tokens")
        sets = sets_of(whole.select("node").distinct()).join(nodes.select("node", F.col("first.doc_id").alias("doc"), F.col("first.line").alias("line")), "node")
        found = in_cells(whole, SQUARE).join(sets, "node").groupBy("token", "row", "column").applyInArrow(_cell(percent), "node long")
        settled = stored(settled.unionByName(found).distinct(), "matched")
    known = nodes.join(settled.withColumn("late", F.lit(True)), "node", "left").where("n > 1 or late").select("node", "first", "n", F.coalesce("late", F.lit(False)).alias("late"))
    hits = joined_by(lines, stored(known, "firsts"), ["node"], "n", sparse=True).where("late or struct(doc_id, line) > struct(first.doc_id, first.line)")
    return stored(hits.groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines")), "removed-lines")


def remove_lines(docs: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS, closest: int = CLOSEST, listed: int = LISTED) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_sha256 (of the kept lines joined by
    newlines) put first and text reduced to the kept lines; n_chars, where there is
    one, is the new length. The input's own columns of the three names go."""
    gone = later_matches(docs, percent, min_tokens, closest, listed)
    base = docs.drop("n_lines", "n_removed", "kept_sha256")
    keyed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    joined = with_columns_of(keyed, gone, "doc_id", "key").select("row.*", F.col("lines").alias("gone_lines"))
    names = base.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                lines = [0 if t is None else t.count("\n") + 1 for t in texts]
                removed = [0] * len(texts)
                for i, numbers in enumerate(part.column("gone_lines").to_pylist()):
                    if numbers and texts[i] is not None:
                        drop = set(numbers)
                        texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in drop])
                        removed[i] = len(drop)
                sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                new = {"text": pa.array(texts, pa.string())}
                if "n_chars" in names and pa.types.is_int64(part.column("n_chars").type):
                    new["n_chars"] = pc.if_else(pc.greater(pa.array(removed), 0), pc.utf8_length(new["text"]).cast(pa.int64()), part.column("n_chars"))
                columns = [pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)] + [new.get(c, part.column(c)) for c in names]
                yield pa.RecordBatch.from_arrays(columns, ["n_lines", "n_removed", "kept_sha256", *names])

    schema = "n_lines long, n_removed long, kept_sha256 string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return joined.mapInArrow(run, schema)
