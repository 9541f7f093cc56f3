"""N-gram Jaccard self-join by prefixes under several global orders.

A document's set holds the distinct hashes of its ``k``-word shingles. Two sets of
similarity ``percent`` share, under any global order of tokens, one of the first
n - ceil(percent * n / 100) + 1 of each. The first order puts rare tokens first: counts
over all documents are gathered in hashed slots of fixed number, so that a passage
that many documents share stands at the end of all of them; ties go by hash. The
shared prefix tokens of a pair are counted: whatever else the sets have in common lies
behind one of the prefixes, so the count has a lower bound. Pairs that reach it there
must also reach it under two more orders (other hashes within the same rarity classes)
before their sets are compared exactly.

Large groups of copies never become all their pairs. Equal sets are one node. Nodes
that share half of their minimum hashes with a few heads of those hashes' buckets are
compared with these alone; the links found so give preliminary components. In the
exact join a token whose nodes all are in one component is dropped, and only pairs
across components are formed, so no link between components is lost and the components
are exact. A token that more than ``HOT`` nodes still have is joined in square blocks of
bounded size, dealt over tasks: there products of token matrices apply the further
orders and then count what is left exactly, and as many links leave a block as connect
all nodes that its links do. The same filters hold in every form of the join.

Defined results: a text without words (null, empty) has an empty set and is linked
with nothing, its component is its own doc_id; one with fewer than ``k`` words has one
shingle; rows of one doc_id are linked by their own texts; a null doc_id is never the
smallest of a component unless there is no other, then the component is null; columns
other than doc_id and text are not read. Sets are compared by 50-bit hashes of
shingles, nodes by 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .rarity import block_rows, classes_of, slot, tally
from .setjoin import MORE_ORDERS, Sets, in_squares, prefix_length, shared_counts
from .shared import joined_by, picked, stored, with_columns_of
from .text import _stream, mix, slices, tidy

#: Slots of the token counts, by the number of documents.
LEAST_SLOTS, MOST_SLOTS, DOCUMENTS_A_SLOT = 1 << 20, 1 << 24, 1 / 64
#: Minimum hashes for the preliminary components, and heads of each of their buckets.
MINIMA, HEADS = 8, 4
#: Nodes of a token that are joined as rows; beyond, in blocks of so many.
HOT, SQUARE = 64, 1024
#: Salts of a token, as a power of two, at most.
MOST_SALTS = 20
#: Sets that a map task remembers as sent.
REMEMBERED = 200_000
NO_ID = (1 << 63) - 1
_MINIMA = _stream(7, MINIMA) | np.uint64(1)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _profile(k: int, slots: int):
    names = ["doc_id", "at", "n", "node", "minima", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"), k)
                tally(counts, slot(s.token, slots))
                minima = np.stack([s.per_doc(np.minimum, s.token * m >> np.uint64(1)) for m in _MINIMA], axis=1)
                some = s.n > 0
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("at"), pa.array(s.n, pa.int64()), pa.array(s.nodes(), pa.int64(), mask=~some), _lists(minima.ravel(), np.arange(len(some) + 1) * MINIMA),
                    pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()),
                ], names)
        blocks, bodies = block_rows(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), t) for t in kinds] + [blocks, bodies], names)

    return run


def _postings(k: int, percent: int, rarity):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"), k)
                nodes = s.nodes()
                fresh = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if s.n[i] and node not in sent:
                        fresh[i] = True
                        sent.add(node)
                if len(sent) > REMEMBERED:
                    sent.clear()
                rare = rarity.value[slot(s.token, len(rarity.value))]
                at = s.prefix_places(rare, 0, percent)[0]
                at = at[fresh[s.doc[at]]]
                node = nodes[s.doc[at]]
                # a frequent token is dealt over as many salts as its class says, so no part of it has more rows than an ordinary token
                salt = (mix(node.view(np.uint64)) & ((np.uint64(1) << np.minimum(rare[at], MOST_SALTS).astype(np.uint64)) - np.uint64(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(s.token[at].view(np.int64)), pa.array(node), pa.array(s.n[s.doc[at]].astype(np.int32)), pa.array(salt), pa.array(rare[at] > 0)], ["token", "node", "n", "salt", "often"])

    return run


def _sets(k: int, percent: int, rarity):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"), k)
                p = [s.prefix_places(rarity.value[slot(s.token, len(rarity.value))], o, percent)[0] for o in range(1, MORE_ORDERS + 1)]
                first = np.concatenate([[0], np.cumsum(prefix_length(s.n, percent))])
                yield pa.RecordBatch.from_arrays([part.column("wanted"), pa.array(s.nodes()), _lists(s.token, s.first), *[_lists(s.token[x], first) for x in p]], ["wanted", "node", "tokens", *[f"p{o}" for o in range(1, MORE_ORDERS + 1)]])

    return run


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of links between labelled nodes (i, j) some that connect all labels that the links do:
    fewer than there are labels. In each round every group of labels picks one of its links."""
    root = np.unique(label, return_inverse=True)[1]
    kept: list[int] = []
    left = np.arange(len(i))
    while True:
        left = left[root[i[left]] != root[j[left]]]
        if not len(left):
            return np.array(kept, np.int64)
        parent = np.arange(int(root.max()) + 1)
        for x in left[np.unique(root[i[left]], return_index=True)[1]].tolist():
            a, b = int(root[i[x]]), int(root[j[x]])
            while parent[a] != a:
                a = int(parent[a])
            while parent[b] != b:
                b = int(parent[b])
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append(x)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


def _square(percent: int):
    """Links within one block of a hot token that connect what all its links do: products
    of token matrices count what prefixes share under each order, then what whole sets share."""

    def run(table: pa.Table) -> pa.Table:
        own, node, label = (table.column(c).to_numpy() for c in ("own", "node", "label"))
        across = table.column("row")[0].as_py() != table.column("column")[0].as_py()
        lists = [np.asarray(x.values) for x in table.column("tokens")]
        n = np.array([len(x) for x in lists])
        near = np.triu((label[:, None] != label[None, :]) & ((own[:, None] != own[None, :]) | (not across)), 1)
        need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent)) - np.maximum(n[:, None], n[None, :]) + prefix_length(np.maximum(n[:, None], n[None, :]), percent)
        for o in range(1, MORE_ORDERS + 1):  # the prefixes under the further orders must share enough too
            near &= shared_counts([np.asarray(x.values) for x in table.column(f"p{o}")]) >= need
        i, j = np.nonzero(near)
        some = np.unique(np.concatenate([i, j]))
        if not len(some):
            return pa.table({"a": node[:0], "b": node[:0]})
        common = shared_counts([lists[x] for x in some])[np.searchsorted(some, i), np.searchsorted(some, j)]
        ok = 100 * common >= percent * (n[i] + n[j] - common)
        first = spanning(label, i[ok], j[ok])
        return pa.table({"a": node[i[ok][first]], "b": node[j[ok][first]]})

    return run


class JaccardJoin:
    """``profile``: doc_id, n, node of each row; ``nodes``: node, n, id (its smallest
    doc_id), ``at`` (the id of a row with its text, a hash of the text where that has none),
    copies (rows), minima."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("at"), "text")
        self.k, self.percent = k, percent
        slots = 1 << max(LEAST_SLOTS.bit_length() - 1, min(MOST_SLOTS.bit_length() - 1, int(docs.count() / DOCUMENTS_A_SLOT).bit_length() - 1))
        both = stored(self.docs.mapInArrow(_profile(k, slots), "doc_id long, at long, n long, node long, minima array<long>, block int, counts binary"), "sets")
        self.profile = both.where("block is null").select("doc_id", "at", "n", "node", "minima")
        self.rarity = docs.sparkSession.sparkContext.broadcast(classes_of(both, slots, both.agg(F.sum("n")).first()[0] or 0))
        known = self.profile.where("node is not null").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
        self.nodes = stored(known.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("id", "at"))["at"].alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("minima").alias("minima")), "nodes")

    def _similar_sizes(self, a: str, b: str):
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def _enough(self, shared: str, na: str, nb: str):
        """Whether so many shared prefix tokens leave room for a link."""
        t = self.percent
        rest = lambda n: f"floor(({t} * {n} + 99) / 100) - 1"  # noqa: E731  tokens behind the prefix
        return F.expr(f"{shared} >= ceil({t} * ({na} + {nb}) / {100 + t}) - greatest({rest(na)}, {rest(nb)})")

    def _token_sets(self, nodes: DataFrame) -> DataFrame:
        """The sets of nodes, from a text of each, and their prefixes under the further orders."""
        wanted = stored(nodes.select("node").join(self.nodes.select("node", "at").hint("merge"), "node").withColumnRenamed("node", "wanted"), "wanted")
        texts = picked(self.docs.select("at", "text"), wanted, "at").withColumn("key", F.xxhash64("text")).dropDuplicates(["at", "wanted", "key"]).select("wanted", "text")
        schema = "wanted long, node long, tokens array<long>" + "".join(f", p{o} array<long>" for o in range(1, MORE_ORDERS + 1))
        return stored(texts.mapInArrow(_sets(self.k, self.percent, self.rarity), schema).where("wanted = node").drop("wanted"), "token-sets")

    def _verified(self, pairs: DataFrame, orders: int) -> DataFrame:
        """Those of the pairs (a, b) that are links; ``orders`` more filters come first."""
        sets = self._token_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda frame, name: frame.select([F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in frame.columns])
        near = pairs.select("a", "b")
        if orders:
            prefixes = sets.select("node", F.size("tokens").alias("n"), *[f"p{o}" for o in range(1, orders + 1)])
            near = near.join(side(prefixes, "a"), "a").join(side(prefixes, "b"), "b")
            for o in range(1, orders + 1):
                near = near.where(self._enough(f"size(array_intersect(a_p{o}, b_p{o}))", "a_n", "b_n"))
        tokens = sets.select("node", "tokens")
        both = near.select("a", "b").distinct().join(side(tokens, "a"), "a").join(side(tokens, "b"), "b")
        both = both.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
        return both.where(f"100 * common >= {self.percent} * (size(a_tokens) + size(b_tokens) - common)").select("a", "b").distinct()

    def _preliminary(self) -> DataFrame:
        """Links of nodes with the smallest node of their buckets."""
        key = ["band", "low"]
        bands = self.nodes.select("node", "n", F.posexplode("minima").alias(*key))
        sizes = stored(bands.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "band-sizes")
        bands = stored(joined_by(bands, sizes, key, "size"), "bands")
        # the middle of a group of near copies is in its largest buckets: it is each one's first head, the others are drawn by hash
        central = bands.groupBy("node").agg(F.sum("size").alias("weight"))
        ranked = bands.join(central.hint("merge"), "node")
        draw = lambda h: F.struct(-F.col("weight"), F.xxhash64("node"), "node", "n") if h == 0 else F.struct(F.lit(0), F.xxhash64("node", F.lit(h)), "node", "n")
        heads = stored(ranked.groupBy(*key).agg(F.first("size").alias("size"), *[F.min(draw(h)).alias(f"h{h}") for h in range(HEADS)]), "heads")
        joined = joined_by(bands.drop("size"), heads, key, "size").select("node", "n", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), f"h{h}.node", f"h{h}.n") for h in range(HEADS)])).alias("head"))
        pairs = joined.where("head.node <> node").where(self._similar_sizes("n", "head.n")).groupBy(F.col("node").alias("a"), F.col("head.node").alias("b"), F.col("head.h").alias("h")).agg(F.count("*").alias("same")).where(f"same >= {MINIMA // 2}")
        best = pairs.groupBy("a", "h").agg(F.max_by("b", F.struct("same", "b")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return stored(self._verified(stored(best, "pairs"), MORE_ORDERS), "links")

    def _labelled(self, postings: DataFrame, links: DataFrame) -> DataFrame:
        """Postings with the label of their node's component, of tokens with several labels
        only, and how many nodes each of these tokens has."""
        labels = stored(components(links).select("node", F.col("root").alias("label")), "labels")
        rows = stored(postings.select("token", "node", "n").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "postings")
        several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").drop("low", "high")
        return stored(rows.join(several, "token"), "postings")

    def _across(self, early: DataFrame) -> DataFrame:
        """Links between different components of the ``early`` links."""
        rows = self.docs.mapInArrow(_postings(self.k, self.percent, self.rarity), "token long, node long, n int, salt int, often boolean")
        ends = Window.partitionBy("token", "salt")
        rows = rows.withColumns({"low": F.min("node").over(ends), "high": F.max("node").over(ends)}).where("often or low < high").select("token", "node", "n", "salt").distinct()
        shared = self._labelled(rows, early)
        hot = self._hot_nodes(shared)
        cold = shared.where(f"size <= {HOT}").drop("size")
        other = cold.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
        pairs = cold.join(other, "token").where("label < other").where(self._similar_sizes("n", "m")).groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("same"), F.first("n").alias("n"), F.first("m").alias("m"))
        for side in "ab":
            pairs = pairs.join(hot.hint("merge").select(F.col("node").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
        pairs = pairs.where(self._enough("same + least(coalesce(hot_a, 0), coalesce(hot_b, 0))", "n", "m")).select("a", "b")
        links = early.unionByName(self._verified(stored(pairs, "pairs"), MORE_ORDERS))
        return links if hot.isEmpty() else links.unionByName(self._hot_links(shared, hot))

    def _hot_nodes(self, shared: DataFrame) -> DataFrame:
        return stored(shared.where(f"size > {HOT}").groupBy("node").agg(F.count("*").alias("hot")), "hot-nodes")

    def _hot_links(self, shared: DataFrame, hot: DataFrame) -> DataFrame:
        """Links that connect all nodes that links within hot tokens do."""
        sets = self._token_sets(hot)
        rows = in_squares(shared.where(f"size > {HOT}"), SQUARE)
        return stored(rows.join(sets, "node").groupBy("token", "row", "column").applyInArrow(_square(self.percent), "a long, b long").distinct(), "links")

    def solve(self) -> DataFrame:
        """A row for each document: doc_id, n_shingles, component_id."""
        early = self._preliminary()
        roots = stored(components(self._across(early)), "roots")
        member = self.nodes.select("node", "id", "copies").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = stored(member.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size")), "components")
        member = stored(joined_by(stored(member.select("node", "copies", "root"), "roots"), sizes, ["root"], "size").select("node", "copies", "component_id"), "members")
        rows = self.profile.select("doc_id", "n", "node")
        linked = joined_by(rows.where("node is not null"), member, ["node"], "copies").withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
        alone = rows.where("node is null").withColumn("component_id", F.col("doc_id"))
        return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def components_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    return JaccardJoin(docs, k, percent).solve()


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; of equal
    rows of one doc_id all stay, as do rows without doc_id. Columns are those of ``docs``."""
    gone = stored(components_of(docs, k, percent).where("component_id < doc_id").select("doc_id", F.lit(True).alias("copy")).distinct(), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return with_columns_of(rows, gone, "doc_id").where("copy is null").select("row.*")
