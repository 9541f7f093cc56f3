"""Byte-level BPE encoding and decoding.

The text is split by the tokenizer's pattern and every match is encoded alone. A
match that is a token is that token. Any other match is merged bottom-up: a segment
tree over its byte positions holds, in each node, the smallest (rank, position) of
the pairs below it, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves - the pair itself, the one before and the one that vanishes -
and their paths to the root. Matches of similar length share one numpy array of
trees and take their merges in step; a long match gets the same tree as flat lists.

Defined results: a null text is an empty one; an empty text has no ids, so its
hashes are those of the empty string; repeated rows are encoded alike, row by row;
columns other than those named are not read. Whole texts are encoded, at any length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import slices, tidy

#: A vocabulary larger than this is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of matches and ids that a worker keeps; beyond it only those of the slice at hand stay.
CACHE_BYTES = 32 << 20
#: Bytes of text encoded at once, cells of a table of trees, ids hashed at once.
SLICE_BYTES, CELLS, HASHED = 1 << 20, 1 << 18, 1 << 16
_LONG = 64
_NONE = np.int64(1) << np.int64(62)


def read_vocabulary(path: str) -> bytes:
    """A rank file of tiktoken's format: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        body = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(body) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary may have {MAX_VOCABULARY_BYTES} bytes")
    return body


class Codec:
    """Ranks, the pairs that merge, and a cache of encoded matches."""

    def __init__(self, vocabulary: bytes, pattern: str, cache: int = CACHE_BYTES):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens = np.full(size, b"", object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = np.array([str(i) for i in range(size)], object)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        found: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = rank
        keys = np.fromiter(found.keys(), np.int64, len(found)) if found else np.array([-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], (np.fromiter(found.values(), np.int64, len(found)) if found else np.zeros(1, np.int64))[order]
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.held, self.limit = 0, cache

    def merged(self, left: np.ndarray, right: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The rank of left + right, or a huge number where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(where & (self.pair_keys[at] == key), self.pair_ranks[at], _NONE)

    def pair(self, left: int, right: int) -> int | None:
        """The rank of left + right, if there is one."""
        key = (left << 32) | right
        at = int(np.searchsorted(self.pair_keys, key))
        return int(self.pair_ranks[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; pieces have 2 to _LONG bytes."""
        rows = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        width = int(length.max())
        leaves = 1 << (width - 1).bit_length()
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((rows, width + 1), -1, np.int64)
        ids[np.arange(width + 1) < length[:, None]] = flat
        col = np.arange(width + 1)
        after = np.broadcast_to(np.minimum(col + 1, width), ids.shape).copy()
        after[col[None, :] >= length[:, None] - 1] = width  # no live neighbour: the spare column
        before = np.broadcast_to(np.maximum(col - 1, -1), ids.shape).copy()
        tree = np.full((rows, 2 * leaves), _NONE, np.int64)
        rank = self.merged(ids[:, :-2].ravel(), ids[:, 1:-1].ravel(), (ids[:, 1:-1] >= 0).ravel()).reshape(rows, width - 1)
        tree[:, leaves : leaves + width - 1] = np.where(rank < _NONE, rank * leaves + np.arange(width - 1), _NONE)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            at, new = root % leaves, root // leaves
            gone = after[live, at]
            then = after[live, gone]
            ids[live, at] = new
            ids[live, gone] = -1
            after[live, at] = then
            before[live, then] = at
            prev = before[live, at]
            none = np.full(len(live), _NONE)
            right = self.merged(new, ids[live, then], then < width)
            self._set(tree, live, leaves, gone, none)
            self._set(tree, live, leaves, at, np.where(right < _NONE, right * leaves + at, none))
            has = prev >= 0
            if has.any():
                rows_, p = live[has], prev[has]
                left = self.merged(ids[rows_, p], new[has], np.ones(len(p), bool))
                self._set(tree, rows_, leaves, p, np.where(left < _NONE, left * leaves + p, _NONE))
            live = live[tree[live, 1] < _NONE]
        keep = ids >= 0
        flat = ids[keep].tolist()
        ends = np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaves: int, at: np.ndarray, value: np.ndarray) -> None:
        """A point update of one leaf in each of the trees."""
        node = leaves + np.minimum(at, leaves - 1)
        value = np.where(at < leaves, value, tree[rows, node])
        tree[rows, node] = value
        while leaves > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves >>= 1

    def merge_long(self, piece: bytes) -> list[int]:
        """The same tree for one piece of any length."""
        n, none = len(piece), int(_NONE)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        leaves = 1 << (n - 1).bit_length()
        rank = self.merged(np.array(ids[:-1]), np.array(ids[1:]), np.ones(n - 1, bool))
        level = np.full(leaves, none, np.int64)
        level[: n - 1] = np.where(rank < _NONE, rank * leaves + np.arange(n - 1), _NONE)
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).min(axis=1)
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    return
                tree[node] = best

        while tree[1] < none:
            new, at = divmod(tree[1], leaves)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone], after[at] = new, -1, then
            put(gone, none)
            if then < n:
                before[then] = at
                rank = self.pair(new, ids[then])
                put(at, none if rank is None else rank * leaves + at)
            else:
                put(at, none)
            p = before[at]
            if p >= 0:
                rank = self.pair(ids[p], new)
                put(p, none if rank is None else rank * leaves + p)
        return [i for i in ids if i >= 0]

    def learn(self, matches: set[str]) -> None:
        """Encodes matches and keeps their ids, four bytes each."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        done: list[tuple[str, list[int]]] = []
        for match in matches:
            piece = match.encode()
            rank = self.ranks.get(piece)
            if rank is not None:
                done.append((match, [rank]))
            elif len(piece) > _LONG:
                done.append((match, self.merge_long(piece)))
            else:
                by_width.setdefault((len(piece) - 1).bit_length(), []).append((match, piece))
        for width, group in by_width.items():
            step = max(1, CELLS >> width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                done += zip([m for m, _ in part], self.merge_many([p for _, p in part]), strict=True)
        for match, ids in done:
            self.cache[match] = body = np.array(ids, np.int32).tobytes()
            self.held += _kept(match, body)

    def forget_unused(self, found: list[list[str]]) -> None:
        """Beyond the limit, only the cached matches of ``found`` stay."""
        if self.held > self.limit:
            used = self.cache.keys() & {m for matches in found for m in matches}
            self.cache = {m: self.cache[m] for m in used}
            self.held = sum(_kept(m, body) for m, body in self.cache.items())

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        found = [self.find(t) for t in texts]
        self.forget_unused(found)
        fresh: set[str] = set()
        for matches in found:
            fresh.update(matches)
        fresh -= self.cache.keys()
        if fresh:
            self.learn(fresh)
        get = self.cache.__getitem__
        for i, matches in enumerate(found):
            found[i] = []  # a long text's matches go as soon as they are encoded
            yield np.frombuffer(bytearray().join(map(get, matches)), np.int32)

    def encode_ids(self, text: str) -> list[int]:
        return next(self.encode([text])).tolist()

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by commas and of the bytes they decode to."""
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(ids), HASHED):
            part = ids[i : i + HASHED]
            of_ids.update(("," * (i > 0) + ",".join(self.decimals[part].tolist())).encode())
            of_bytes.update(self.decode(part))
        return of_ids.hexdigest(), of_bytes.hexdigest()

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[np.asarray(ids, np.int64)].tolist())


def _kept(match: str, body: bytes) -> int:
    """About what a match takes in the cache: key, ids, its place in the dictionary."""
    return sys.getsizeof(match) + sys.getsizeof(body) + 104


@functools.lru_cache(maxsize=1)
def codec_of(vocabulary: bytes, pattern: str) -> Codec:
    """A worker's codec, kept for its later tasks."""
    return Codec(vocabulary, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each row of ``docs``: its id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 (of the bytes that the ids decode to) and, if
    asked for, token_ids. ``vocabulary`` is the path of a rank file on the driver.
    Nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                coded = list(codec.encode([t or "" for t in part.column("text").to_pylist()]))
                counts = np.array([len(ids) for ids in coded], np.int64)
                digests = [codec.digests(ids) for ids in coded]
                columns = [part.column("doc_id"), pa.array(counts), *(pa.array([d[i] for d in digests], pa.string()) for i in range(2))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return source.mapInArrow(run, schema)
