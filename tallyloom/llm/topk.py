"""Exact top-k inner products over integer vectors by MaxScore.

A component x counts as floor(256 * x), x as double; a component's place is a term, and a
vector is a document with a posting for each term. Vectors are packed into shards of
SHARD rows with the terms' columns (dense postings) and their least and largest values. A
query term's contributions in a shard lie between two bounds; the terms are ordered by
the distance of the two. The last terms, whose distances together can't lift a document
from the query's least score over its k-th best so far, are non-essential. The postings of the
essential terms are traversed for a batch of queries at once; the others are probed some at a
time for the documents that can still reach the k-th best. The batch shares its split, so that it
holds for each query of it; scores and bounds are exact integers in floats that hold them.

Stated queries meet all rows in blocks: packed shards times packed blocks of queries, a
row of each, and a task keeps k rows a query of its own. The tasks' rows are merged by query.

Vectors that are null or hold a null or non-finite component take no part; components beyond 2^26
in amount count as 2^26. A shorter vector has no postings for the terms it lacks, which
add 0. A row's own vector is the only one left out, so rows that repeat a vec_id find each
other, and each repeated query row has its own answers, ranked apart. A null vec_id is a candidate, last
among ties; it is no query. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lloyd import integers, whole_vectors
from .shared import stored
from .text import tidy

#: Rows of a shard and of a block of queries; queries that are searched together; terms that are probed at once.
SHARD, QUERIES, BATCH, CHUNK = 4096, 1024, 128, 8
_PACKED = "width int, n int, ids binary, rows binary, body binary"


def _packer(rows: int):
    """Packs a task's vectors, ``rows`` to a row: ids (null: the largest), row numbers, int32 components by term."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = table.column("vec_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
            lists = table.column("x").combine_chunks()
            sizes = np.asarray(lists.value_lengths())
            width, values = int(sizes.max(initial=0)), np.asarray(lists.flatten())
            x = np.zeros((len(ids), width), np.int32)
            x[np.arange(width) < sizes[:, None]] = values
            columns = [[width], [len(ids)], [ids.tobytes()], [np.asarray(table.column("row")).tobytes()], [np.ascontiguousarray(x.T).tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["width", "n", "ids", "rows", "body"])

        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(b.num_rows for b in held) == rows:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    return run


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "rows"))
    return ids, rows, np.frombuffer(row[prefix + "body"], np.int32).reshape(row[prefix + "width"], row[prefix + "n"])


class Shard:
    """A shard's postings by term, with the least and largest value of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low, self.high = columns.min(1).astype(np.float64), columns.max(1).astype(np.float64)
        self.most = np.maximum(-self.low, self.high)
        self.columns, self.kind = columns, None

    def in_kind(self, kind: type) -> np.ndarray:
        if self.kind is not kind:
            self.columns, self.kind = self.columns.astype(kind), kind
        return self.columns


def search(shard: Shard, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the shard, score) of all that reach a query's ``floor`` (its k-th best
    score so far, -inf without one) or, without a floor, its k best here and their ties."""
    width = min(queries.shape[1], len(shard.low))
    q, low, high = queries[:, :width].astype(np.float64), shard.low[:width], shard.high[:width]
    reach = (np.abs(q) * shard.most[:width]).sum(1).max(initial=0)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    floor = floor - (reach * 1e-9 if kind is np.int64 else 0)  # where bounds are rounded
    columns, weights = shard.in_kind(kind), q.astype(kind)
    upper, lower = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
    order = np.argsort(-(upper - lower).sum(0), kind="stable")
    from_here = lambda x: np.cumsum(np.pad(x[:, order], ((0, 0), (0, 1)))[:, ::-1], 1)[:, ::-1]
    rest, lift = from_here(upper), from_here(upper - lower)
    idle = (lower.sum(1)[:, None] + lift < floor[:, None]).all(0)  # the terms from here on can't lift any document enough
    essential = int(np.argmax(idle)) if idle.any() else width
    scores = weights[:, order[:essential]] @ columns[order[:essential]]
    alive = None
    while essential < width:
        alive = scores >= (floor - rest[:, essential])[:, None]
        if alive.mean() < 0.1:
            break
        more = order[essential : essential + chunk]
        scores += weights[:, more] @ columns[more]
        essential, alive = essential + len(more), None
    is_own = own[:, None] == shard.rows[None, :] if np.isin(own, shard.rows).any() else None
    none = floor == -np.inf
    if none.any():  # then all terms are essential
        full = scores.astype(np.float64)
        if is_own is not None:
            full[is_own] = -np.inf
        at = full.shape[1] - min(k, full.shape[1])
        floor = np.where(none, np.partition(full, at, axis=1)[:, at] - (reach * 1e-9 if kind is np.int64 else 0), floor)
    if alive is None:
        alive = scores >= floor[:, None]
    if is_own is not None:
        alive &= ~is_own
    at, place = np.nonzero(alive)
    got = scores[at, place]
    while essential < width:
        more = order[essential : essential + chunk]
        got = got + np.einsum("ij,ji->i", weights[at][:, more], columns[more][:, place])
        essential += len(more)
        still = got >= floor[at] - rest[at, essential]
        at, place, got = at[still], place[still], got[still]
    still = got >= floor[at]
    return at[still], place[still], got[still].astype(np.int64)


class Best:
    """The k best of each query of a block, as far as searched."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.vectors = np.ascontiguousarray(columns.T)
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, shard: Shard, batch: int, chunk: int) -> None:
        found = [(self.query, self.id, self.score)]
        for a in range(0, len(self.ids), batch):
            some = slice(a, a + batch)
            at, place, score = search(shard, self.vectors[some], self.rows[some], self.floor[some], self.k, chunk)
            found.append((at + a, shard.ids[place], score))
        query, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.query, full, "right") - 1
        self.floor[full] = self.score[last]


def _searched(k: int, batch: int, chunk: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        name, shard = b"", None
        for row in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            if row["s_rows"] != name:
                name, shard = row["s_rows"], Shard(*_unpacked(row, "s_"))
            key = row["q_rows"]
            if key not in best:
                best[key] = Best(*_unpacked(row, "q_"), k)
            best[key].meet(shard, batch, chunk)
        for b in best.values():
            columns = [b.rows[b.query], b.ids[b.query], b.id, b.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "score"])

    return run


def nearest(frame: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that ``is_query``."""
    rows = whole_vectors(frame.select("vec_id", "embedding", is_query.alias("asks")), "embedding").select("vec_id", "asks", integers("embedding").alias("x"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = stored(rows.select("vec_id", "row", "x").mapInArrow(_packer(SHARD), _PACKED), "shards")
    queries = stored(rows.where("asks and vec_id is not null").select("vec_id", "row", "x").mapInArrow(_packer(QUERIES), _PACKED), "queries")
    named = lambda t, p: t.select(*[F.col(c).alias(p + c) for c in t.columns])
    pairs = named(shards, "s_").crossJoin(named(queries, "q_"))  # a row for each pair of packed blocks, not of vectors
    found = pairs.mapInArrow(_searched(k, BATCH, CHUNK), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(np.iinfo(np.int64).max)).alias("vec_id"), "score")
