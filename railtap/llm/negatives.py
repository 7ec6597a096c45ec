"""Hard negatives by a secondary-sort shuffle of scored pairs.

Every anchor is scored against every row, block by block: rows are dealt to
shards, and the anchors stream past each shard's matrix.  What a shard hands on
is what it alone can tell is needed: per anchor its best ``positives`` rows of
the anchor's label in the first round, and in the second, with the anchor's
positives known, its first ``negatives`` rows inside each positive's score
window.  The best of the whole are among the best of the shards, so nothing is
lost, and no shard hands on more than a fixed number of rows per anchor.

Each pair travels as one packed key (anchor, descending score, kind, id), is
dealt by anchor and sorted by key within its partition, and an iterator reads
the keys in order: a positive opens a window of scores below its own, a negative
is emitted for each open window that it falls into, and a window closes once it
has its fill.  No anchor's pairs are ever held together.

A score is the exact integer inner product; one beyond 64 bits is set to the
nearest 64-bit number.

Edge cases: rows with a null label, a null vector, or a null or non-finite
component take no part.  Vectors of different lengths are never paired; an empty
vector scores 0 with other empty ones.  Repeated rows are rows of their own, an
anchor leaves out only its own row.  Null ids come last among equals.  A
positive with a score below 0 has an empty window, one of 0 takes scores of 0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.llm.common import need, stored

SHARD_ROWS = 65_536

_CHUNK = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: anchor row, complement of the score, kind, whether the id is null, id, row: big-endian, so bytes sort as the numbers do
_KEY = struct.Struct(">QQBBQQ")


def pack(anchor: int, score: int, kind: int, vec_id: int | None, rid: int) -> bytes:
    """The sort key of a pair: higher scores, positives (kind 0) and smaller ids first."""
    return _KEY.pack(anchor, _MOST - score, kind, vec_id is None, (vec_id or 0) - _LEAST, rid)


def unpack(key: bytes) -> tuple[int, int, int, int | None]:
    """anchor row, score, kind, id."""
    anchor, score, kind, unknown, vec_id, _ = _KEY.unpack(key)
    return anchor, _MOST - score, kind, None if unknown else vec_id + _LEAST


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score between ``low`` and ``high`` hundredths of a positive's."""
    return -(-low * score // 100), high * score // 100


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x: the rows that take part, each component floor(``scale`` * x)."""
    v = F.col("embedding")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: _floor(c.cast("double") * F.lit(float(scale))))
    return need(vectors, "vec_id", "label", "embedding").filter(F.col("label").isNotNull() & v.isNotNull() & sound).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x"))


def _floor(c: Column) -> Column:
    # floor() gives a long, which a large component would overflow; from 2^52 on a double is whole
    return F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two whole-number matrices."""
    most = (np.abs(q).max(initial=0) or 1.0) * (np.abs(x).max(initial=0) or 1.0)
    if most * max(1, q.shape[1]) < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q).astype(object) @ whole(x).astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest allowed scores; equal ones by position."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        some = scores[at]
        at = at[some >= np.partition(some, len(at) - k)[len(at) - k]]
    return at[np.argsort(~scores[at], kind="stable")][:k]  # ~s falls as s rises and never overflows


class Shard:
    """The rows of one shard with vectors of one length, in the order of their ids."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, known: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((rid, ids, ~known))
        self.rid, self.ids, self.known, self.label, self.x = (c[order] for c in (rid, ids, known, label, x))

    def needed(self, rid: np.ndarray, label: np.ndarray, q: np.ndarray, wanted: list[list[int]] | None,
               positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
        """Anchor's position and key of the pairs that this shard must hand on."""
        scores = _products(q, self.x)
        for i, (own, kind, row) in enumerate(zip(rid, label, scores)):
            same = (self.label == kind) & (self.rid != own)
            if wanted is None:
                at = _first(row, same, positives)
            else:
                other = self.label != kind
                spans = {window(p, low, high) for p in wanted[i]}
                found = [_first(row, other & (row >= lo) & (row <= hi), negatives) for lo, hi in spans if lo <= hi]
                at = np.unique(np.concatenate(found)) if found else []
            for j in at:
                yield i, pack(int(own), int(row[j]), wanted is not None, int(self.ids[j]) if self.known[j] else None, int(self.rid[j]))


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, column.flatten().to_numpy(zero_copy_only=False)


def _pairs(rows: DataFrame, asked: DataFrame, shards: int, *limits: int) -> DataFrame:
    """anchor_id, key: what the shards hand on; ``asked`` may carry its positives' scores (``wanted``)."""
    second = "wanted" in asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a shard come before the anchors to it, both in the order of their vectors' lengths
        held: dict[int, list] = {}
        made: dict[int, Shard] = {}
        shard = None
        for batch in batches:
            numbers, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "anchor"))
            sizes, flat = _vectors(batch.column("x"))
            edge = (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1]) | (sizes[1:] != sizes[:-1])
            cuts = [0, *(np.flatnonzero(edge) + 1), len(numbers)]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in zip(cuts, cuts[1:]):
                d = int(sizes[lo])
                x = flat[starts[lo]:starts[hi]].reshape(hi - lo, d).astype(np.float64)
                part = batch.slice(lo, hi - lo)
                rid, label = (part.column(c).to_numpy() for c in ("rid", "label"))
                ids = part.column("vec_id")
                if numbers[lo] != shard:
                    shard, held, made = numbers[lo], {}, {}
                if not kinds[lo]:
                    held.setdefault(d, []).append((rid, ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), label, x))
                    continue
                if d not in held:
                    continue
                if d not in made:
                    made[d] = Shard(*(np.concatenate(c) for c in zip(*held[d])))
                wanted = part.column("wanted").to_pylist() if second else None
                for at in range(0, hi - lo, _CHUNK):
                    to = slice(at, at + _CHUNK)
                    out = list(made[d].needed(rid[to], label[to], x[to], wanted and wanted[to], *limits))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([at + i for i, _ in out], pa.int64())), pa.array([k for _, k in out], pa.binary())],
                        ["anchor_id", "key"])

    none = F.lit(None).cast("array<long>")
    every = rows.withColumn("wanted", none).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards))).withColumn("anchor", F.lit(False))
    past = (asked if second else asked.withColumn("wanted", none)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("anchor", F.lit(True))
    dealt = every.unionByName(past).withColumn("d", F.size("x"))
    return (dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "anchor", "d", "rid")
            .mapInArrow(run, "anchor_id long, key binary"))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _streamed(keys: DataFrame, of, schema: str) -> DataFrame:
    """``of`` each anchor's keys in order: the secondary sort deals by anchor and sorts by the whole key."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, current = None, None
        for batch in batches:
            out = []
            for anchor_id, key in zip(batch.column("anchor_id").to_pylist(), batch.column("key").to_pylist()):
                anchor, score, kind, vec_id = unpack(key)
                if anchor != current:
                    step, current = of(anchor), anchor
                out += [(anchor_id, *row) for row in step(score, kind, vec_id, key)]
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, row)) for row in out], fields)

    anchor = F.substring("key", 1, 8)
    return keys.repartition(anchor).sortWithinPartitions("key").mapInArrow(run, schema)


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for rows of ``vectors`` (vec_id, label, x) under ``anchors``.

    A negative of a positive with score p has another label than the anchor and
    a score of ``low`` to ``high`` hundredths of p; the first ``negatives`` are returned.
    """
    spark = vectors.sparkSession
    rows = stored(need(vectors, "vec_id", "label", "x").withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 4096)))
    asked, limits = rows.filter(anchors), (positives, negatives, low, high)

    def best(anchor):
        left = positives

        def step(score, kind, vec_id, key):
            nonlocal left
            left -= 1
            return [(anchor, score, key)] if left >= 0 else []
        return step

    first = stored(_streamed(_pairs(rows, asked, shards, *limits), best, "anchor_id long, rid long, score long, key binary"),
                   "negatives-positives")
    wanted = first.groupBy("rid").agg(F.collect_list("score").alias("wanted"))  # at most ``positives`` scores each
    below = _pairs(rows, asked.join(wanted, "rid"), shards, *limits)

    def windows(anchor):
        open_: list[list] = []

        def step(score, kind, vec_id, key):
            if kind == 0:
                open_.append([vec_id, score, *window(score, low, high), 0])
                return []
            out = []
            for w in open_:
                if w[2] <= score <= w[3]:
                    w[4] += 1
                    out.append((w[0], w[4], vec_id, w[1], score))
            open_[:] = [w for w in open_ if w[4] < negatives]
            return out
        return step

    return _streamed(first.select("anchor_id", "key").unionByName(below), windows,
                     "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
