"""Phrase collocations by level-wise counting over slots of minimal perfect hashes.

Texts become streams of slots: first of frequent words (by language), then, level by
level, of frequent phrases of two to ``longest`` words. A phrase of k words is the pair
of slots of its first and its last k - 1 words, so a candidate's parts are frequent by
construction (Apriori), its key is exact, and language needs no further mention.

A level takes two passes over the streams of the level before. The first gathers the
pairs that occur, with counts capped at ``least`` (a byte or two a pair), and keeps those
that reach it. Their keys are dealt to shards, each with a minimal perfect hash that stores
its keys by slot. The second looks the pairs up, writes the next streams and counts slots
with bincount; a task's counts go out in compressed blocks, which are summed in a tree.
Prefixes and suffixes of a phrase, and so the counts of every cut, are read by slot.

Shards of more than ROUND_KEYS keys together go out in several rounds, each of which fills
in the slots of its keys; nothing is left out. Words are found by 64-bit hashes of
language and word (phrases by exact pairs of slots).

Texts that are null count as empty, a null language is ``und``, rows with one doc_id are
texts of their own, other columns are ignored. No row comes out for a language without candidates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mph import PerfectHash, shard_of
from .shared import stored
from .text import hash_spans, hash_strings, lowered, mix, raw, slices, starts_of_equal, tidy

#: Keys of a shard; keys that go to all tasks at once (12 bytes each).
SHARD_KEYS, ROUND_KEYS = 1 << 18, 1 << 22
#: Slots of a block of counts; blocks that are summed by one call.
BLOCK, FAN_IN = 1 << 16, 32
#: Words or pairs that a task holds before it sends them on.
HELD = 1 << 20

BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(10 if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([b not in BREAKS + b" \t" for b in range(256)])
_BREAK = np.array([b in BREAKS for b in range(256)])


def _count_words(most: int):
    """lang, word, n of a task's words; what it holds goes out beyond ``most`` words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                names, n = list(words), list(words.values())
                for i in range(0, len(names), 1 << 16):
                    part = pa.array(names[i : i + (1 << 16)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i : i + (1 << 16)], pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                if text.is_valid:
                    counts.setdefault(lang, Counter()).update(text.as_py().translate(_LOWER).split())
            if sum(map(len, counts.values())) > most:
                yield from send()
        yield from send()

    return run


def _word_key(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mix(words + langs * np.uint64(0x9E3779B97F4A7C15))


@tidy
def _keyed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _word_key(hash_strings(batch.column("word")), hash_strings(batch.column("lang")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])


def _text_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words of the texts, where they are words, and the ends of the texts' streams. A
    stream has an item before each piece that is no word, at least one."""
    data, offsets = raw(batch.column("text"))
    data, langs = lowered(data), hash_strings(batch.column("lang"))
    inside = _WORD[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    head[offsets[:-1][full]] = inside[offsets[:-1][full]]
    tail[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start = np.flatnonzero(head)
    size = np.flatnonzero(tail) + 1 - start
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    new = starts_of_equal(doc, np.cumsum(_BREAK[data])[start] if len(data) else start)
    empty = np.flatnonzero(np.diff(first) == 0)  # a text without words has one item
    at = np.arange(len(start)) + np.cumsum(new) + np.searchsorted(empty, doc)
    items = np.bincount(doc, minlength=batch.num_rows) + np.bincount(doc[new], minlength=batch.num_rows) + (np.diff(first) == 0)
    ends = np.cumsum(items)
    keys, known = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64), np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    keys[at], known[at] = _word_key(hash_spans(data, start, size), langs[doc]), True
    return keys, known, ends


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a column of streams, and the streams' ends."""
    data, offsets = raw_binary(column)
    return np.frombuffer(data, np.int32), offsets[1:] // 4


def raw_binary(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (column.buffers()[2][int(offsets[0]) : int(offsets[-1])] if len(column) and column.buffers()[2] is not None else b""), offsets - offsets[0]


def _pair_keys(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two neighbours, where both are known."""
    known = np.zeros(len(before), bool)
    known[:-1] = (before[:-1] >= 0) & (before[1:] >= 0)
    keys = np.zeros(len(before), np.uint64)
    keys[:-1] = (before[:-1].astype(np.uint64) << np.uint64(32)) | before[1:].astype(np.uint64)
    return keys, known


def _pairs(least: int, most: int):
    """key and its count in a task, capped: what the sum of all tasks' says about ``least`` is exact."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(starts_of_equal(keys))
            return keys[at], np.add.reduceat(counts, at) if len(at) else counts

        def send(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(np.minimum(counts[i : i + (1 << 16)], least).astype(np.int32))], ["key", "n"])

        size = 0
        for batch in batches:
            keys, known = _pair_keys(_stream(batch.column("slots"))[0])
            held.append(np.unique(keys[known], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * most:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > most:
                    yield from send(*held.pop())
                    size = 0
        if held:
            yield from send(*merged())

    return run


def _dealt(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shard_of(keys, shards).astype(np.int32))], ["key", "shard"])

    return run


def _hashed(table: pa.Table) -> pa.Table:
    """The perfect hash of a shard's keys."""
    built = PerfectHash(table.column("key").to_numpy().view(np.uint64))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(built)], pa.int64()), "body": pa.array([built.dumps()], pa.binary())})


class Index:
    """The perfect hashes of a level's keys: slots follow each other by shard."""

    def __init__(self, candidates: DataFrame):
        n = candidates.count()
        if n >= 1 << 31:
            raise ValueError("slots are 31 bits wide: raise the least count")
        self.shards = max(1, -(-n // SHARD_KEYS))
        dealt = candidates.select("key").mapInArrow(_dealt(self.shards), "key long, shard int")
        self.table = stored(dealt.groupBy("shard").applyInArrow(_hashed, "shard int, n long, body binary"), "phrase-index")
        sizes = {r.shard: r.n for r in self.table.select("shard", "n").collect()}  # a row for each 2^18 keys
        self.first, self.total, self.rounds = {}, 0, [[]]
        for shard in sorted(sizes):
            if sum(sizes[s] for s in self.rounds[-1]) + sizes[shard] > ROUND_KEYS and self.rounds[-1]:
                self.rounds.append([])
            self.rounds[-1].append(shard)
            self.first[shard] = self.total
            self.total += sizes[shard]

    def sent(self, shards: list[int]):
        """Some shards (ROUND_KEYS keys at most, or one shard), sent to all tasks."""
        rows = self.table.where(F.col("shard").isin(shards)).select("shard", "body").collect()
        return self.table.sparkSession.sparkContext.broadcast({r.shard: (self.first[r.shard], bytes(r.body)) for r in rows})

    def lookup(self, hashes):
        """A function that gives the slots of keys, -1 for keys of other shards or of none."""
        shards, loaded = self.shards, {}

        def slots(keys: np.ndarray) -> np.ndarray:
            if not loaded:
                loaded.update({s: (first, PerfectHash.loads(body)) for s, (first, body) in hashes.value.items()})
            out, of = np.full(len(keys), -1, np.int64), shard_of(keys, shards)
            for shard, (first, table) in loaded.items():
                mine = np.flatnonzero(of == shard) if shards > 1 else slice(None)
                found = table.slots(keys[mine])
                out[mine] = np.where(found >= 0, found + first, -1)
            return out

        return slots


def _resolve(slots, level: int, total: int, counted: bool, keep: list[str], size: int):
    """Streams with the slots of a round's keys filled in, and in the last round the
    counts of a task's slots in blocks of ``size``. ``keep``: what later rounds need."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total if counted else 0, np.int64)
        names = [*keep, "slots", "part", "block", "counts"]
        none = lambda n, kind: pa.nulls(n, kind)
        for whole in batches:
            for batch in slices(whole, "text" if level == 1 else "before"):
                if level == 1:
                    keys, known, ends = _text_keys(batch)
                else:
                    before, ends = _stream(batch.column("before"))
                    keys, known = _pair_keys(before)
                out = np.full(len(keys), -1, np.int32)
                if "slots" in batch.schema.names:
                    out[:] = _stream(batch.column("slots"))[0]
                distinct, place = np.unique(keys[known], return_inverse=True)
                found = slots(distinct)[place]
                at = np.flatnonzero(known)[found >= 0]
                out[at] = found[found >= 0]
                if counted:
                    counts += np.bincount(out[out >= 0], minlength=total)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int64)
                stream = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], stream, none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary())], names)
        part = TaskContext.get().partitionId()
        for block in range(0, len(counts), size):
            mine = counts[block : block + size]
            if mine.any():
                body = zstandard.ZstdCompressor(1).compress(mine.tobytes())
                kinds = {"text": pa.string(), "lang": pa.string(), "before": pa.binary()}
                yield pa.RecordBatch.from_arrays([*[none(1, kinds[c]) for c in keep], none(1, pa.binary()), pa.array([part], pa.int32()), pa.array([block // size], pa.int32()), pa.array([body], pa.binary())], names)

    return run


def _summed(fan_in: int):
    """The sum of some tasks' counts of a block."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64) for x in table.column("counts"))
        body = zstandard.ZstdCompressor(1).compress(total.tobytes())
        return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // fan_in], pa.int32()), "counts": pa.array([body], pa.binary())})

    return run


def _by_slot(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at + block * size), pa.array(counts[at])], ["slot", "a"])

    return run


def _tree_sum(blocks: DataFrame) -> DataFrame:
    """slot and a: the tasks' blocks, FAN_IN at a time."""
    rows = blocks.select("block", "part", "counts")
    last = blocks.agg(F.max("part")).first()[0] or 0
    while True:
        rows = rows.groupBy("block", F.expr(f"part div {FAN_IN}").alias("up")).applyInArrow(_summed(FAN_IN), "block int, part int, counts binary")
        last //= FAN_IN
        if not last:
            return rows.mapInArrow(_by_slot(BLOCK), "slot long, a long")


def _streams(rows: DataFrame, index: Index, level: int, last: bool) -> DataFrame:
    """The streams of a level (slots) with the counts of its slots (block, part, counts)."""
    need = ["lang", "text"] if level == 1 else ["before"]
    for i, shards in enumerate(index.rounds):
        final = i == len(index.rounds) - 1
        keep = [] if final else need
        kinds = {"lang": "lang string", "text": "text string", "before": "before binary"}
        run = _resolve(index.lookup(index.sent(shards)), level, index.total, final, keep, BLOCK)
        out = rows.mapInArrow(run, ", ".join([*[kinds[c] for c in keep], "slots binary, part int, block int, counts binary"]))
        rows = stored(out.where("block is not null") if final and last else out, f"phrases-{level}")
    return rows


def _slotted(candidates: DataFrame, index: Index) -> DataFrame:
    """The candidates with their slots."""
    out = None
    for shards in index.rounds:
        slots = index.lookup(index.sent(shards))

        def run(batches: Iterator[pa.RecordBatch], slots=slots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots(batch.column("key").to_numpy().view(np.uint64)))], [*batch.schema.names, "slot"])

        some = candidates.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema) + ", slot long").where("slot >= 0")
        out = some if out is None else out.unionByName(some)
    return out


def phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). Phrases of 2 to ``longest`` words that occur ``least`` times or more: lang, words,
    a, pre and suf (counts of its prefixes and suffixes by length, itself last), inside (whether a phrase
    of one word more that holds it occurs as often). Totals: lang and n, the number of its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = stored(texts.mapInArrow(_count_words(HELD), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = stored(words.where(F.col("n") >= least).select("lang", "word").mapInArrow(_keyed_words, "lang string, word string, key long"), "words")
    index, levels = Index(known), []
    streams = _streams(texts, index, 1, last=False)
    counts = _tree_sum(streams.where("block is not null"))
    one = F.array("a")
    level = stored(_slotted(known, index).join(counts, "slot").select("slot", "lang", F.array("word").alias("words"), "a", one.alias("pre"), one.alias("suf"), *[F.lit(None).cast("long").alias(c) for c in ("head", "tail", "head_a", "tail_a")]), "level-1")
    for k in range(2, longest + 1):
        pairs = streams.where("block is null").select("slots").mapInArrow(_pairs(least, HELD), "key long, n int")
        keys = stored(pairs.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), f"keys-{k}")
        index = Index(keys)
        if not index.total:
            break
        streams = _streams(streams.where("block is null").select(F.col("slots").alias("before")), index, k, last=k == longest)
        counts = _tree_sum(streams.where("block is not null"))
        pair = _slotted(keys, index).join(counts, "slot").select("slot", "a", F.shiftrightunsigned("key", 32).alias("head"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tail"))
        heads = level.select(F.col("slot").alias("head"), "lang", F.col("words").alias("first"), "pre", F.col("a").alias("head_a"))
        tails = level.select(F.col("slot").alias("tail"), F.element_at("words", -1).alias("word"), "suf", F.col("a").alias("tail_a"))
        words_of = F.concat("first", F.array("word")).alias("words")
        joined = pair.join(heads, "head").join(tails, "tail")
        level = stored(joined.select("slot", "lang", words_of, "a", F.concat("pre", one).alias("pre"), F.concat("suf", one).alias("suf"), "head", "tail", "head_a", "tail_a"), f"level-{k}")
        levels.append(level)
    out = level.where("size(words) > 1").withColumn("inside", F.lit(False)).drop("slot", "head", "tail", "head_a", "tail_a")
    for shorter, longer in zip(levels, levels[1:]):
        covered = longer.where("a = head_a").select(F.col("head").alias("slot")).unionByName(longer.where("a = tail_a").select(F.col("tail").alias("slot")))
        marked = shorter.join(covered.distinct().withColumn("inside", F.lit(True)), "slot", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
        out = out.unionByName(marked.select(*out.columns))
    return out, totals


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases with l, r and score of their lowest-scoring cut, in exact decimals."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    value = f"cast(({wide('1000 * a')} * {wide('n')}) div ({wide('pre[k - 1]')} * {wide('suf[size(words) - k - 1]')}) as long)"
    cuts = f"array_min(transform(sequence(1, size(words) - 1), k -> named_struct('score', {value}, 'k', k, 'l', pre[k - 1], 'r', suf[size(words) - k - 1])))"
    return found.join(totals, "lang").withColumn("cut", F.expr(cuts)).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, longest: int = 5, least: int = 100, first: int = 2000) -> DataFrame:
    """Each language's ``first`` phrases by score (then a, then bytes): lang, rank, phrase, a, l, r, n, score.
    A phrase that lies inside a longer candidate of the same count is left out."""
    found, totals = phrases(docs, longest, least)
    rows = scored(found.where("not inside"), totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
