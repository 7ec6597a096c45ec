"""Ordered operators: block edges, hot captures, partition independence."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railtap.operators import order as O
from railtap.operators import windows as W


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "cap string, seq bigint, key string, x double").repartition(parts)


def sample(n=300, seed=1):
    r = random.Random(seed)
    # capture "hot" holds most rows; sequence numbers have gaps
    seq, out = 0, []
    for _ in range(n):
        seq += r.choice([1, 1, 1, 7])
        out.append((r.choice(["hot", "hot", "hot", "b"]), seq, r.choice([None, "p", "p", "q"]), float(r.randint(0, 9))))
    return out


def by_capture(rows):
    caps = {}
    for r in sorted(rows, key=lambda r: r[1]):
        caps.setdefault(r[0], []).append(r)
    return caps


@pytest.mark.parametrize("block", [1, 5, 64, 10_000])
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_ordinals_any_block_and_partitioning(spark, block, parts):
    rows = sample()
    got = O.with_ordinal(frame(spark, rows, parts), O.track("cap", "seq", block), "i").collect()
    want = {r[1]: i for g in by_capture(rows).values() for i, r in enumerate(g)}
    assert {r["seq"]: r["i"] for r in got} == want


@pytest.mark.parametrize("block", [1, 5, 64, 10_000])
def test_islands(spark, block):
    rows = sample()
    got = {r["seq"]: (r["group_id"], r["group_first"], r["ordinal"]) for r in
           O.islands(frame(spark, rows), O.track("cap", "seq", block), F.col("key")).collect()}
    want = {}
    for g in by_capture(rows).values():
        gid, first, prev = 0, 0, "start"
        for i, r in enumerate(g):
            if prev == "start" or r[2] is None or prev is None or r[2] != prev:
                gid, first = gid + 1, i
            want[r[1]] = (gid, first, i)
            prev = r[2]
    assert got == want


@pytest.mark.parametrize("block", [1, 5, 64, 10_000])
def test_islands_of_one_row(spark, block):
    rows = sample()
    got = O.islands(frame(spark, rows), O.track("cap", "seq", block), F.col("key"), alone="alone").collect()
    sizes = Counter((r["cap"], r["group_id"]) for r in got)
    assert all(r["alone"] == (sizes[r["cap"], r["group_id"]] == 1) for r in got)
    assert {r["alone"] for r in got} == {True, False}


@pytest.mark.parametrize("block", [3, 50])
def test_running_sum_and_neighbours(spark, block):
    rows = sample()
    t = O.track("cap", "seq", block)
    df = O.with_running_sum(frame(spark, rows), t, {"s": F.col("x")})
    df = O.with_neighbour(df, t, F.col("key"), "before")
    df = O.with_neighbour(df, t, F.col("seq"), "after", ahead=True)
    got = {r["seq"]: (r["s"], r["s_total"], r["before"], r["after"]) for r in df.collect()}
    for g in by_capture(rows).values():
        total, run = sum(r[3] for r in g), 0.0
        for i, r in enumerate(g):
            run += r[3]
            assert got[r[1]] == (run, total, g[i - 1][2] if i else None, g[i + 1][1] if i + 1 < len(g) else None)


@pytest.mark.parametrize("fraction", [0.0, 1.0])
def test_occurrence_of_a_hot_key(spark, fraction):
    rows = [("a", i, "same" if i % 3 else f"k{i % 40}", 0.0) for i in range(900)]
    df, t = frame(spark, rows), O.track("cap", "seq", 40)
    assert bool(O.hot_keys(df, ["key"], fraction)) == (fraction > 0)
    got = O.occurrence(df, t, ["key"], "nth", fraction).collect()
    seen, want = {}, {}
    for _, i, k, _ in rows:
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r["seq"]: r["nth"] for r in got} == want


@pytest.mark.parametrize("k", [1, 5, 6, 31])
def test_moving_average(spark, k):
    rows = sample(120)
    df = O.with_ordinal(frame(spark, rows), O.track("cap", "seq", 16), "i")
    got = {r["seq"]: r["m"] for r in O.moving_average(df, "cap", "i", "x", k, "m", block_rows=32).collect()}
    for g in by_capture(rows).values():
        y = [r[3] for r in g]
        left = k // 2 if k > 1 else 0
        pad = [y[0]] * left + y + [y[-1]] * (k - 1 - left)
        for i, r in enumerate(g):
            assert got[r[1]] == pytest.approx(sum(pad[i:i + k]) / k)


def test_segments_and_stride(spark):
    rows = [("a", i, None, float(v)) for i, v in enumerate([0, 1, 1, 0, 1, 0, 0, 1, 1, 1])]
    df, t = frame(spark, rows), O.track("cap", "seq", 2)
    got = sorted((r["seg_start"], r["seg_end"]) for r in O.segments(df, t, F.col("x") > 0, "seq").collect())
    assert got == [(1, 2), (4, 4), (7, 9)]
    assert sorted(r["seq"] for r in O.strided(df, t, F.col("x") > 0, 2).collect()) == [1, 4, 8]


def brute(n, size, step, tail):
    full = [s for s in range(0, n, step) if s + size <= n]
    part = [s for s in range(0, n, step) if s + size > n]
    if tail == "drop":
        return full
    return full + (part if tail == "keep" else part[:1])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), size=st.integers(1, 20), data=st.data(), tail=st.sampled_from(["drop", "keep", "keep_last"]),
       panes=st.sampled_from([1, 3, 64]))
def test_windows_match_brute_force(spark, n, size, data, tail, panes):
    step = data.draw(st.integers(1, size))
    df = spark.range(n).select(F.lit("a").alias("cap"), F.col("id").alias("i"))
    got = W.sliding(df, "cap", "i", size, step, {"s": ("sum", F.col("i")), "r": ("rows", F.col("i")), "l": ("last", F.col("i"))},
                    tail=tail, block_panes=panes).collect()
    want = {s // step: list(range(s, min(s + size, n))) for s in brute(n, size, step, tail)}
    assert {r["window_id"]: r["r"] for r in got} == want
    assert all(r["s"] == sum(want[r["window_id"]]) and r["l"] == want[r["window_id"]][-1] and r["n"] == len(want[r["window_id"]]) for r in got)


def test_window_limits(spark):
    df = spark.range(100).select(F.lit("a").alias("cap"), F.col("id").alias("i"))
    got = W.sliding(df, "cap", "i", 10, 5, {"s": ("sum", F.col("i"))}, max_windows=3).collect()
    assert sorted(r["start"] for r in got) == [0, 5, 10]
    with pytest.raises(ValueError):
        W.sliding(df, "cap", "i", 5, 6, {})


def test_blocks_of_text_and_numbers(spark):
    words = spark.createDataFrame([(f"w{i:03d}",) for i in range(200)], "w string")
    got = {r["w"]: r["b"] for r in O.text_blocks(words, "w", "b", 7).collect()}
    assert [got[w] for w in sorted(got)] == sorted(got.values()) and len(set(got.values())) > 3
    nums = spark.range(1000).select((F.col("id") * F.col("id")).alias("v"))
    got = {r["v"]: r["b"] for r in O.numeric_blocks(nums, "v", "b", 8).collect()}
    assert [got[v] for v in sorted(got)] == sorted(got.values()) and len(set(got.values())) == 8


def test_pad_and_compact(spark):
    df = spark.createDataFrame([(1, 0, 2, 5.0), (1, 1, 2, 6.0), (1, 2, 9, 7.0), (2, 0, 9, 1.0)],
                               "w int, line int, pos int, v double")
    got = {r["w"]: r["c"] for r in W.pad_by_index(df, "w", "line", "pos", 4, {"v": "c"}).collect()}
    assert got == {1: [-1.0, -1.0, 6.0, -1.0], 2: [-1.0] * 4}
    seq = spark.createDataFrame([([[-1.0, -2.0], [1.0, -1.0], [0.0, 3.0]],), ([],)], "s array<array<double>>")
    c = seq.select(W.compact(F.col("s"), 5).alias("c")).withColumn("n", W.compact_length(F.col("c"))).collect()
    assert c[0]["c"] == [[1.0, 0.0], [0.0, 3.0]] and c[0]["n"] == 2 and c[1]["n"] == 1
