"""Token sets of texts, and their prefixes under global orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, _stream, mix, roll

TOKEN_BITS = 50
#: Columns of a token matrix at once.
COLUMNS = 2048
#: Global orders after the first.
MORE_ORDERS = 2
_ORDERS = _stream(11, MORE_ORDERS) | np.uint64(1)


class Sets:
    """The sorted token sets of a slice: ``token`` and its text, ``first`` as in Words."""

    def __init__(self, texts: pa.Array, k: int):
        w = Words(texts, lower=True)
        h, doc, n = w.hashes(), w.doc, w.counts
        at = w.runs(k)
        tokens, owners = [roll(h, at, k)], [doc[at]]
        for c in range(1, k):
            short = np.flatnonzero(n == c)
            tokens.append(roll(h, w.first[short], c))
            owners.append(short)
        key = (np.concatenate(owners).astype(np.uint64) << np.uint64(TOKEN_BITS)) | (np.concatenate(tokens) >> np.uint64(64 - TOKEN_BITS))
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        self.doc = (key >> np.uint64(TOKEN_BITS)).astype(np.int64)
        self.token = key & np.uint64((1 << TOKEN_BITS) - 1)
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))
        self.n = np.diff(self.first)

    def per_doc(self, ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), values.dtype)
        full = self.n > 0
        if full.any():
            out[full] = ufunc.reduceat(values, self.first[:-1][full])
        return out

    def nodes(self) -> np.ndarray:
        """A signed 64-bit hash of each set."""
        return mix(self.per_doc(np.add, mix(self.token)) + mix(self.n.astype(np.uint64))).view(np.int64)

    def prefix_places(self, rarity: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions of each set's prefix under one order, set by set, and the place
        of each in that order; ``rarity`` has a class for each token."""
        rank = self.token if not order else (self.token * _ORDERS[order - 1]) >> np.uint64(64 - TOKEN_BITS)
        # one key of 64 bits: text, class and most of the hash; equal keys are told apart by the rest
        rare = rarity.astype(np.uint64)
        key = (self.doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (rare << np.uint64(TOKEN_BITS - 8)) | (rank >> np.uint64(8))
        by = np.argsort(key)
        key = key[by]
        if (key[1:] == key[:-1]).any():
            by = np.lexsort((rank, rare, self.doc))
        place = np.arange(len(by)) - np.repeat(self.first[:-1], self.n)
        kept = place < np.repeat(prefix_length(self.n, percent), self.n)
        return by[kept], place[kept]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def shared_counts(lists: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """How many values each of the lists shares with each of the others (or of the lists)."""
    both = lists if others is None else [*lists, *others]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    value, code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *both]), return_inverse=True, return_counts=True)
    place = np.full(len(value), -1)
    place[n > 1] = np.arange((n > 1).sum())
    code = place[code]
    rows = len(lists)
    out = np.zeros((rows, rows if others is None else len(others)), np.float32)
    for a in range(0, int((n > 1).sum()), COLUMNS):
        mine = (code >= a) & (code < a + COLUMNS)
        m = np.zeros((len(both), min(COLUMNS, int((n > 1).sum()) - a)), np.float32)
        m[owner[mine], code[mine] - a] = 1
        out += m[:rows] @ (m if others is None else m[rows:]).T
    return out


def in_squares(rows: DataFrame, side: int) -> DataFrame:
    """Rows (token, node, size: nodes of the token, any more) dealt so that each two nodes
    of a token meet in one square block (token, row, column) of about ``side`` nodes a
    side; ``own`` is a node's own block number."""
    dealt = rows.withColumn("blocks", F.expr(f"cast(ceil(size / {side}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"row": F.least("own", "other"), "column": F.greatest("own", "other")}).drop("size", "blocks", "other")


def in_cells(rows: DataFrame, side: int) -> DataFrame:
    """Rows (token, node, asked, size: nodes of the token, n: those asked for) dealt so that each
    asked node meets each node of its token in one cell (token, row, column) of about ``side`` nodes
    a side; ``asks`` tells on which side a row stands."""
    blocks = lambda c: F.ceil(F.col(c) / side).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = rows.withColumns({"rows": blocks("n"), "columns": blocks("size")}).drop("n", "size")
    asking = dealt.where("asked").select("token", "node", F.lit(True).alias("asks"), own("rows").alias("row"), every("columns").alias("column"))
    return asking.unionByName(dealt.select("token", "node", F.lit(False).alias("asks"), own("columns").alias("column"), every("rows").alias("row")))
