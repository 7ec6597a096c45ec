"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles.  Equal sets form one class.  Each
class has ``trees`` x ``DEPTH`` minimum hashes: ``trees`` sort orders, in each of
which classes are sorted by a prefix-comparable key.  Neighbours in an order are
candidates as far as they share a prefix of at least ``SHALLOW`` hashes.  Depth
adapts to the region: inside the shallowest prefix that at most ``REACH`` + 1
classes share, all pairs are candidates; where even the full key is shared by
more, each class meets its next two neighbours.  Two classes of similarity 0.8
share four hashes in at least one of 16 orders with probability 0.9998.

More than ``REACH`` + 1 classes with the same ``SHALLOW`` hashes are a crowd, and
there the neighbours alone would miss pairs.  All classes that stand in a crowd of
any order are joined exactly (:func:`crowd_pairs`): shingles are put into one
order, rare ones first, and two sets that reach the wanted similarity have their
first common shingle near the front of both.  Nothing is left out of this join but
pairs that links found before already put into one component.

Orders are cut by range, so a region of any size spreads over tasks; the rows at
the cuts are sorted again among themselves until no cut is left.  Candidates are
confirmed on full shingle sets: first the best partner of each class, then those
others that would join different components.  Components come from
:mod:`railtap.llm.components`.

Edge cases: a null text and a text without words have no shingles and link with
nothing.  A text with fewer words than a shingle is one shingle.  Every row is a
document of its own, whatever its id: rows that share an id and differ in text
may be in different groups.  A group's id is the smallest of its rows' ids; a
group without any has a null ``component_id`` and its rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtap.llm.common import need, stored
from railtap.llm.components import components
from railtap.llm.quality import word_hashes

TREES = 16
DEPTH = 8
SHALLOW = 4
REACH = 8
ORDER_BUCKETS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, ASCII letters lower-cased."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    key = h[:n].copy()
    for i in range(1, size):
        key = key * _STEP + h[i:n + i]
    key = (key ^ (key >> np.uint64(29))) * _MIX
    return np.unique(key ^ (key >> np.uint64(32)))


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two signed halves of a 128-bit hash of the set."""
    raw = xxhash.xxh3_128_digest(found.tobytes())
    return tuple(int(x) for x in np.frombuffer(raw, "<i8"))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return (r.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)), r.integers(0, 1 << 63, count, np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Minimum hashes as big-endian 32-bit words, so that bytes compare as the numbers do."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i:i + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))


def signatures(docs: DataFrame, size: int, trees: int = TREES) -> DataFrame:
    """doc_id, rid, n_shingles, the set's fingerprint (f1, f2) and the signature (null for an empty set)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(trees * DEPTH)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw in batch.column("raw").to_pylist():
                found = shingles(raw, size)
                row = (len(found), *_fingerprint(found), signature(found, a, b) if len(found) else None)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"), *[pa.array(c, pa.int64()) for c in out[:3]],
                 pa.array(out[3], pa.binary())], ["doc_id", "rid", "n_shingles", "f1", "f2", "signature"])

    rows = _raw(docs).withColumn("rid", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, n_shingles long, f1 long, f2 long, signature binary")


def classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: its node (the smallest row number), smallest id, size and signature."""
    return (signed.filter("n_shingles > 0").groupBy("f1", "f2")
            .agg(F.min("rid").alias("node"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))


class _Neighbours:
    """Candidate pairs of sorted rows that arrive in batches; rows are kept only as far as pairs still reach.

    A node in a crowd is paired with itself, to tell it from others.
    """

    def __init__(self):
        self.tree, self.key = np.empty(0, np.int32), np.empty((0, DEPTH), np.uint32)
        self.node, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.done = 0

    def add(self, tree, key, node, n) -> None:
        self.tree, self.key = np.concatenate([self.tree, tree]), np.concatenate([self.key, key])
        self.node, self.n = np.concatenate([self.node, node]), np.concatenate([self.n, n])

    def pairs(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        rows, hold = len(self.node), REACH + 1
        to = rows if last else max(self.done, rows - 2 * hold)
        if rows < 2 or to == self.done:
            return self.node[:0], self.node[:0]
        same = (self.key[1:] == self.key[:-1]) & (self.tree[1:] == self.tree[:-1])[:, None]
        shared = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int8)
        depth = np.full(rows, DEPTH + 1, np.int8)
        for d in range(DEPTH, SHALLOW - 1, -1):
            edge = np.concatenate([[0], np.flatnonzero(shared < d) + 1, [rows]])
            length = np.repeat(np.diff(edge), np.diff(edge))
            depth[length <= hold] = d
        at = np.arange(self.done, to)
        crowd = np.unique(self.node[at[length[at] > hold]])  # ``length`` is still that of the shallowest regions
        left, right, reach = [crowd], [crowd], shared
        for step in range(1, min(REACH, rows - 1) + 1):
            if step > 1:
                reach = np.minimum(reach[:-1], shared[step - 1:])
            ok = reach >= (SHALLOW if step <= 2 else np.maximum(depth[:len(reach)], SHALLOW))
            ok[:self.done] = False
            ok[to:] = False
            i = np.flatnonzero(ok)
            n, m = self.n[i], self.n[i + step]
            i = i[5 * np.minimum(n, m) >= 4 * np.maximum(n, m)]
            left.append(self.node[i])
            right.append(self.node[i + step])
        keep = max(0, to - hold)
        self.tree, self.key, self.node, self.n = self.tree[keep:], self.key[keep:], self.node[keep:], self.n[keep:]
        self.done = to - keep
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)


_FOREST = "tree int, key binary, node long, n long, a long, b long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), and the first and last rows of the partition again (a and b null)."""
    near, edge, head, tail = _Neighbours(), 2 * (REACH + 1), [], []

    def made(pairs) -> pa.RecordBatch:
        a, b = pairs
        none = [pa.nulls(len(a), t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b)], ["tree", "key", "node", "n", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node, n = (batch.column(c).to_numpy() for c in ("tree", "node", "n"))
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
        near.add(tree, key.astype(np.uint32), node, n)
        if sum(x.num_rows for x in head) < edge:
            head.append(batch.slice(0, edge))
        tail = [*tail, batch.slice(max(0, batch.num_rows - edge))][-edge:]
        yield made(near.pairs(False))
    yield made(near.pairs(True))
    if head:
        ends = pa.Table.from_batches([*head, *tail]).to_pylist()
        ends = list({(r["tree"], r["key"], r["node"]): r for r in ends}.values())
        yield pa.RecordBatch.from_pylist([r | {"a": None, "b": None} for r in ends], pa.schema(
            [("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))


def candidates(found: DataFrame, trees: int = TREES) -> DataFrame:
    """Distinct candidate pairs of nodes a < b, with the number of times that the orders gave them; (a, a) if a is in a crowd."""
    width = 4 * DEPTH
    key = F.expr(f"substring(signature, tree * {width} + 1, {width})")
    rows = found.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).select("tree", key.alias("key"), "node", "n")
    parts, pairs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    while True:
        sorted_rows = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
        out = stored(sorted_rows.mapInArrow(_neighbours, _FOREST), "forest")
        pairs.append(out.filter("a <= b").select("a", "b"))
        if parts == 1:
            break
        rows, parts = out.filter("node IS NOT NULL").select("tree", "key", "node", "n"), -(-parts // 512)
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionAll(more)
    return every.groupBy("a", "b").agg(F.count("*").alias("hits"))


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, items: the full shingle sets of these nodes (node, f1, f2, id), worked out again from the texts.

    Ids only pick the texts to look at; a set meets its node by its fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(raw, size) for raw in batch.column("raw").to_pylist()]
            halves = [_fingerprint(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()),
                 pa.array([f.tobytes() for f in found], pa.binary())], ["f1", "f2", "items"])

    # the ids grow with the table, so they are shuffled at every size and never broadcast
    ids = nodes.select("id").distinct().hint("merge")
    some = _raw(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    rows = some.select("raw").mapInArrow(run, "f1 long, f2 long, items binary")
    return rows.join(nodes, ["f1", "f2"]).select("node", "items").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _component_of(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        root = grouped.select(F.col("u").alias(side), F.col("v").alias(f"root_{side}"))
        pairs = pairs.join(root, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs


def _crowd_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket: only the order of shingles depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for items in batch.column("items").to_pylist():
                np.add.at(counts, (np.frombuffer(items, np.uint64) % np.uint64(ORDER_BUCKETS)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    every = np.zeros(ORDER_BUCKETS, np.int64)
    # at most ``ORDER_BUCKETS`` rows
    rows = sets.select("items").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    every[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return every


def front(items: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The front shingles of a set, and the largest size of a set that may have each as its first common one with it.

    At place k of n, at most n - k shingles are common from there on, and similarity
    asks for percent / (100 + percent) of both sizes together.
    """
    n, many = len(items), counts[(items % np.uint64(ORDER_BUCKETS)).astype(np.int64)]
    items = items[np.lexsort((items, many))]
    most = ((100 + percent) * (n - np.arange(n)) - percent * n) // percent
    ok = 100 * most >= percent * n
    ok &= np.sort(many) > 1  # else no other set has it
    return items[ok], most[ok]


def crowd_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs a < b of the sets (node, root, items) of different roots that can be as similar as ``percent``.

    The join meets the smaller set's front with the larger one's, and by the bounds
    of :func:`front` no shingle that a whole crowd shares makes pairs, unless sharing
    it can be enough.  In the list of a shingle the root with most rows never meets
    itself, so a large group costs what other rows there are times its size.
    """
    counts = _crowd_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            if not items:
                continue
            fronts = [front(x, counts, percent) for x in items]
            k = [len(f[0]) for f in fronts]
            each = [np.repeat(x, k) for x in (batch.column("node").to_numpy(), batch.column("root").to_numpy(), [len(x) for x in items])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate([f[0] for f in fronts]).view(np.int64), *each, np.concatenate([f[1] for f in fronts]))],
                ["token", "node", "root", "n", "most"])

    rows = stored(sets.mapInArrow(run, "token long, node long, root long, n long, most long"), "fronts")
    # lists of one root make no pairs, nor do those without a smaller side
    lists = rows.groupBy("token", "root").agg(F.count("*").alias("rows"), F.max(F.col("most") >= F.col("n")).alias("small")).groupBy("token").agg(
        F.max_by("root", F.struct("rows", "root")).alias("top"), F.count("*").alias("roots"), F.max("small").alias("small"))
    lists = lists.filter("roots > 1 AND small").select("token", "top")
    rows = stored(rows.join(lists, "token").withColumn("top", F.col("root") == F.col("top")), "mixed-fronts")
    x, y = rows.filter("most >= n").alias("x"), rows.alias("y")
    fit = F.expr("x.token = y.token AND x.root <> y.root AND x.n <= y.n AND y.n <= x.most AND x.n <= y.most")
    pairs = x.filter("NOT top").join(y, fit).unionAll(x.filter("top").join(y.filter("NOT top"), fit))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def find(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = need(docs, "doc_id", "text")
    signed = stored(signatures(docs, size, trees), "signatures")
    found = stored(classes(signed), "set-classes")
    pairs = stored(candidates(found, trees), "candidates")
    crowd, pairs = pairs.filter("a = b").select(F.col("a").alias("node")), pairs.filter("a < b")
    # every class's best partner first: most links of a group come from these, and the rest need no look
    ends = pairs.select(F.col("a").alias("node"), "b", "a", "hits").unionAll(pairs.select(F.col("b").alias("node"), "b", "a", "hits"))
    best = stored(ends.groupBy("node").agg(F.max(F.struct("hits", -F.col("a"), -F.col("b"), "a", "b")).alias("best"))
                  .select("best.a", "best.b").distinct(), "best-pairs")
    nodes = stored(ends.select("node").unionAll(crowd).distinct().join(found.select("node", "f1", "f2", "id"), "node"), "set-nodes")
    sets = stored(_sets(docs, nodes, size), "shingle-sets")
    first = stored(_confirm(best, sets, percent), "first-links")
    grouped = components(first)
    rest = _component_of(pairs.join(best, ["a", "b"], "left_anti"), grouped).filter("root_a <> root_b").select("a", "b")
    more = stored(_confirm(rest, sets, percent), "more-links")
    grouped = components(grouped.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(more))
    # what the neighbours in a crowd may have missed
    dense = sets.join(crowd, "node").join(grouped.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("root"), "items")
    last = stored(_confirm(crowd_pairs(stored(dense, "crowd-sets"), percent), sets, percent), "crowd-links")
    grouped = components(grouped.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(last))
    rooted = stored(found.select("f1", "f2", "node", "id").join(grouped, F.col("node") == F.col("u"), "left")
                    .select("f1", "f2", "id", F.coalesce("v", "node").alias("root")), "set-roots")
    named = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "component-ids")
    labels = stored(rooted.join(named, "root").select("f1", "f2", "component_id"), "set-labels")
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(labels, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs``, one of each near-duplicate group; rows equal in id and text count once."""
    kept = find(docs, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    one = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return one.dropDuplicates(["doc_id", "text_md5"]).select("row.*")
