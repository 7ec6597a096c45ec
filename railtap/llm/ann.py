"""Nearest neighbours by multi-index hashing of learned rotated codes.

Vectors are extended by one component that makes all norms equal, so that the
largest inner product is the smallest angle.  On a bounded sample the principal
axes are found and rotated so that signs lose least (:func:`fit`); the signs are
the code.  Codes are cut into bytes and each byte position is an index of its
own.  Two codes within a Hamming radius r must agree, at some position, within
r / positions bits: probing those buckets finds every code within the radius.
What is found is ranked again by the inner products of the vectors themselves.

The radius comes from the sample: nearest neighbours in the whole table are
nearer than those in a sample, so a radius that holds the sample's holds more.
A query that finds fewer than ``k`` within it widens it until it has them.

Rows are dealt evenly to shards, whatever their values; each shard holds its
index in memory, and queries stream past it in blocks.  Copies of one vector
fill a bucket of every shard alike.

Edge cases: vectors that are null, empty, zero, or hold a null, NaN or infinite
component take no part; neither do those of another dimension than most of the
sample.  Repeated rows are rows of their own; a query leaves out only its own
row.  Null ids are never queries and come last among equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railtap.llm.common import bounded_sample, need, stored

SAMPLE = 8_000
MAX_BITS = 256
SHARD_ROWS = 131_072


@dataclass
class Codes:
    """Projection to code bits, the norm that vectors are extended to, and the search radius."""
    axes: np.ndarray
    norm: float
    radius: int

    @property
    def bytes(self) -> int:
        return self.axes.shape[1] // 8

    def of(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0.0))
        return np.packbits(np.column_stack([x, rest]) @ self.axes > 0, axis=1)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.packbits(np.column_stack([q, np.zeros(len(q))]) @ self.axes > 0, axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, norm: float, k: int, steps: int = 40, seed: int = 3) -> Codes:
    """Learn the rotation on ``sample`` and take the radius that holds 98 % of its own k nearest."""
    r = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    full = np.column_stack([sample, np.sqrt(np.maximum(norm ** 2 - (sample * sample).sum(axis=1), 0.0))])
    bits = min(MAX_BITS, d // 8 * 8)
    if bits:
        axes = np.linalg.eigh(full.T @ full)[1][:, ::-1][:, :bits]
        flat = full @ axes
        turn = np.linalg.qr(r.normal(size=(bits, bits)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        axes = axes @ turn
    else:  # fewer axes than a byte has bits
        axes = r.normal(size=(d, 8))
    codes = Codes(axes, norm, axes.shape[1])
    if len(sample) > 1:
        at = r.choice(len(sample), min(256, len(sample)), replace=False)
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
        found = _distances(codes.of_queries(sample[at])[:, None], codes.of(sample)[near])
        codes.radius = int(np.quantile(found, 0.98, method="higher"))
    return codes


class Index:
    """Byte buckets of the codes of one shard."""

    def __init__(self, codes: Codes, rid: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray):
        self.codes, self.rid, self.ids, self.known, self.x = codes, rid, ids, known, x
        self.code = codes.of(x)
        self.order = np.argsort(self.code, axis=0, kind="stable")
        counts = np.stack([np.bincount(c, minlength=256) for c in self.code.T])
        self.first = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        bytes_ = np.arange(256, dtype=np.uint8)
        self.near = [np.flatnonzero(np.bitwise_count(bytes_) <= a).astype(np.uint8) for a in range(9)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius, by the pigeonhole principle."""
        each, extra = divmod(radius, len(code))
        mark = np.zeros(len(self.code), bool)
        for s, byte in enumerate(code):
            reach = min(8, each if s <= extra else each - 1)
            if reach < 0:
                continue
            buckets = self.near[reach] ^ byte
            lo = self.first[s, buckets]
            n = self.first[s, buckets.astype(np.int64) + 1] - lo
            ends = np.cumsum(n)
            mark[self.order[np.repeat(lo - ends + n, n) + np.arange(ends[-1]), s]] = True
        at = np.flatnonzero(mark)
        return at[_distances(self.code[at], code) <= radius]

    def search(self, rid: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k nearest found, the row ``rid`` left out."""
        radius, bits = self.codes.radius, 8 * self.codes.bytes
        while True:
            at = self.within(code, radius)
            at = at[self.rid[at] != rid]
            if len(at) >= k or radius >= bits:
                break
            radius = min(bits, radius + 4)
        scores = self.x[at] @ q
        if len(at) > k:
            keep = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[keep], scores[keep]
        best = np.lexsort((self.ids[at], ~self.known[at], -scores))[:k]
        return at[best], scores[best]


def usable(df: DataFrame, vector: str) -> DataFrame:
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(x.isNotNull() & (F.size(x) > 0) & sound & F.exists(x, lambda v: v != 0))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def search(vectors: DataFrame, queries: str, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for rows of ``vectors`` (vec_id, embedding) under the condition ``queries``."""
    spark = vectors.sparkSession
    rows = usable(need(vectors, "vec_id", "embedding"), "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "ann-rows")
    schema = "query_id long, rid long, vec_id long, score double"
    # at most ``sample`` vectors
    some = [r[0] for r in bounded_sample(rows, "rid", sample, rows.count()).select("embedding").collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes, times = np.unique([len(v) for v in some], return_counts=True)
    d = int(sizes[times.argmax()])
    rows = rows.filter(F.size("embedding") == d)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(square))).first()
    codes = fit(np.array([v for v in some if len(v) == d]), float(norm), k)
    shards = max(-(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a shard come before the queries to it
        held: list = []
        index = shard = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            numbers, kinds = (np.asarray(table[c]) for c in ("shard", "query"))
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
                part = table.slice(lo, hi - lo).to_batches()[0]
                if numbers[lo] != shard:
                    held, index, shard = [], None, numbers[lo]
                rid, x = np.asarray(part.column("rid")), _matrix(part.column("embedding"), hi - lo)
                ids = part.column("vec_id")
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy()
                if not kinds[lo]:
                    held.append((rid, ids, known, x))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = Index(codes, *(np.concatenate(c) for c in zip(*held)))
                out: list[list] = [[], [], [], []]
                for own, query_id, q, code in zip(rid, ids, x, codes.of_queries(x)):
                    at, scores = index.search(own, q, code, k)
                    out[0].append(np.full(len(at), query_id))
                    out[1].append(np.full(len(at), own))
                    out[2].append(pa.array(index.ids[at], pa.int64(), mask=~index.known[at]))
                    out[3].append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()),
                     pa.concat_arrays(out[2]), pa.array(np.concatenate(out[3]), pa.float64())], ["query_id", "rid", "vec_id", "score"])

    every = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards))).withColumn("query", F.lit(False))
    asked = rows.filter(queries).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    dealt = every.unionByName(asked.withColumn("query", F.lit(True))).select("shard", "query", "rid", F.col("vec_id").cast("long"), "embedding")
    found = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "query", "rid").mapInArrow(run, schema)
    best = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
