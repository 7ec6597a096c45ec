"""Merging and matching against plain loops."""

import json
import os
import random
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from railtap.operators import match as M
from railtap.operators import features as X
from railtap.operators import merge as G
from railtap.operators.order import track
from railtap import session
from railtap.plans import serve as SV

COLS = "cap string, seq bigint, protocol string, timestamp string, sq string, modbus_fc string, modbus_regs_val string, modbus_regs_translated_addr string, xgt_fen_data string"


def packets(spark, n=200, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p = r.choice(["modbus", "modbus", "xgt_fen", "arp"])
        rows.append((r.choice("aab"), i, p, f"t{i // 9}", r.choice(["1", "1", "2", None]), r.choice(["6", "3", None]),
                     r.choice(["[1,2]", "5", None]), r.choice(['["40001"]', None]), r.choice(["00", "01", None])))
    return rows, spark.createDataFrame(rows, COLS).repartition(5)


def as_text(v):
    return [] if v is None else [str(x) for x in json.loads(v)] if v.startswith("[") else [v]


def merged_by_loop(rows, offline):
    caps = defaultdict(list)
    for r in rows:
        caps[r[0]].append(r)
    out = {}
    for cap, rs in caps.items():
        groups, prev = [], None
        for r in rs:
            key = (r[2], r[3], r[4]) if r[2] != "arp" else None
            if key is None or prev is None or key != prev:
                groups.append([])
            groups[-1].append(r)
            prev = key
        for i, g in enumerate(groups, start=1):
            rec = dict(zip(["protocol", "modbus_fc", "modbus_regs_val", "modbus_regs_translated_addr", "xgt_fen_data"],
                           (g[0][2], *g[0][5:9])))
            if len(g) > 1:
                for j, f in enumerate(["modbus_fc", "modbus_regs_val", "modbus_regs_translated_addr", "xgt_fen_data"], start=5):
                    if not f.startswith(g[0][2]):
                        continue
                    vals = [x[j] for x in g]
                    if offline and "regs" in f:
                        rec[f] = [y for v in vals for y in as_text(v)]
                    elif offline:
                        rec[f] = vals[0] if all(v == vals[0] for v in vals) else vals
                    else:
                        some = [v for v in vals if v is not None]
                        rec[f] = None if not some else some[0] if all(v == some[0] for v in some) else some
            out[(cap, i)] = (len(g), rec)
    return out


@pytest.mark.parametrize("offline", [False, True])
@pytest.mark.parametrize("block", [4, 1000])
def test_merge(spark, offline, block):
    rows, df = packets(spark)
    g = G.groups(df, track("cap", "seq", block), G.offline_key(df))
    got = (G.merge_offline if offline else G.merge_online)(g, "cap", "seq").collect()
    want = merged_by_loop(rows, offline)
    assert len(got) == len(want) and sum(r["raw_count"] for r in got) == len(rows)
    for r in got:
        n, rec = want[(r["cap"], r["merge_event_id"])]
        assert n == r["raw_count"]
        for f, v in rec.items():
            have = r[f]
            if isinstance(v, list):
                have = json.loads(have)
            assert have == v, (f, r)


def test_long_groups_are_whole_in_chunks_and_in_long_form(spark):
    rows = [("a", i, "modbus", "t", "1", str(i), None, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, COLS)
    g = G.groups(df, track("cap", "seq", 3), G.offline_key(df))
    r = G.merge_online(g, "cap", "seq", chunk_rows=4).orderBy("chunk").collect()
    assert [json.loads(x["modbus_fc"]) for x in r] == [["0", "1", "2", "3"], ["4", "5", "6", "7"], ["8", "9"]]
    assert {(x["raw_count"], x["seq"]) for x in r} == {(10, 0)}
    assert G.merge_totals(G.merge_online(g, "cap", "seq", chunk_rows=4)).first() == (10, 1)
    rest = G.list_overflow(g, "cap", list_rows=4).where("field = 'modbus_fc'").orderBy("idx").collect()
    assert [x["value"] for x in rest] == [str(i) for i in range(4, 10)]


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_sketch_gives_the_features_of_the_merged_lists(spark, chunk_rows):
    r = random.Random(8)
    pick = lambda *v: r.choice(v)
    rows = []
    for i in range(300):
        same = i % 60 < 30
        rows.append((i, pick("modbus", "modbus", "xgt_fen", "arp") if i % 50 == 0 else rows[-1][1], f"t{i // 25}",
                     "[1,2,3]" if same else pick("[1,2]", "[4]", "7;8", None), pick("[1.5,2]", "[-3,x]", "5", None), pick("[40001]", "[40002,40003]", None) if not same else None,
                     pick("[9]", None) if i % 100 < 20 else None, pick("05 00", "0A0B", None, "zz"), '["D1","D2"]' if same else pick('["D1"]', '["D2","D3"]', None),
                     pick("[1,2]", "[3]", None)))
    ddl = "seq bigint, protocol string, timestamp string, " + ", ".join(f"{f} string" for f in (
        "modbus_regs_addr", "modbus_regs_val", "modbus_translated_addr", "modbus_word_value", "xgt_fen_data", "xgt_fen_translated_addr", "xgt_fen_word_value"))
    p = spark.createDataFrame(rows, ddl).withColumn("capture", F.lit("c")).withColumn("sq", F.lit("1")).repartition(4)
    t = track("capture", "seq", 40)
    names = ["modbus_regs_count", "modbus_regs_addr_min", "modbus_regs_addr_max", "modbus_regs_val_min", "modbus_regs_val_max", "modbus_regs_val_mean",
             "modbus_regs_val_std", "xgt_data_len_chars", "xgt_data_num_spaces"]

    def features(m):
        m = X.with_parsed(m)
        raw = X.raw_values(m)
        slots = F.coalesce(X.slot_map(m, "modbus"), X.slot_map(m, "xgt_fen"))
        cols = [F.round(raw[n], 9).alias(n) for n in names] + [F.to_json(F.array_sort(F.map_entries(slots))).alias("slots")]
        return [tuple(x) for x in m.orderBy("merge_event_id").select("merge_event_id", "raw_count", *cols).collect()]

    whole = G.merge_online(G.groups(p, t, G.online_key(p)), "capture", "seq")   # lists in full
    want = [tuple(None if v == "[]" else v for v in x) for x in features(whole)]
    got = [tuple(None if v == "[]" else v for v in x) for x in features(SV.merged_packets(p, t, "seq", chunk_rows=chunk_rows))]
    assert got == want and max(x[1] for x in want) > 20


def serving_packets(spark, n=240, seed=5):
    """Two captures of packets, most of them a group of their own, some a run of equal keys."""
    r = random.Random(seed)
    rows, key = [], None
    for i in range(n):
        if r.random() < 0.7 or key is None:
            key = (r.choice("ab"), r.choice(["modbus", "xgt_fen", "arp", "dns"]), f"2024-01-01T00:00:{i % 60:02d}", str(i))
        rows.append((key[0], i, *key[1:], r.choice(["request", "response"]), f"10.0.0.{i % 5}", "m", f"10.0.1.{i % 3}", "n", str(i % 9),
                     r.choice(["6", "3", None]), r.choice(["05 00", "0A0B", None])))
    return spark.createDataFrame(rows, "capture string, seq bigint, protocol string, timestamp string, sq string, dir string, sip string,"
                                 " smac string, dip string, dmac string, len string, modbus_fc string, xgt_fen_data string").repartition(3)


@pytest.mark.parametrize("block", [7, 1000])
def test_packets_without_a_group_merge_as_in_one(spark, block):
    p = serving_packets(spark)
    t = track("capture", "seq", block)
    whole = G.merge_online(G.groups(p, t, G.online_key(p)), "capture", "seq").drop("chunk")
    got = SV.merged_packets(p, t, "seq")
    assert got.drop("sketch", "i").dtypes == whole.dtypes
    rows = lambda df: sorted(map(str, df.select(whole.columns).collect()))
    assert rows(got) == rows(whole) and {r["raw_count"] > 1 for r in got.collect()} == {True, False}
    assert {(r["raw_count"] > 1) for r in got.where("sketch IS NOT NULL").collect()} == {True}


def test_serving_merges_a_capture_once_and_keeps_only_what_is_read(spark, monkeypatch):
    p = serving_packets(spark)
    t, fitted, features = track("capture", "seq", 50), X.fit(p), ["protocol", "len_norm", "modbus_fc_norm", "xgt_data_mean_byte"]
    paths, fresh = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda spark, name: paths.append((name, fresh(spark, name))) or paths[-1][1])
    serve = lambda **more: SV.serve(p, t, "seq", fitted, features, lambda d: d.withColumn("xh", F.transform("x", lambda r: F.transform(
        r, lambda v: v / 2))), size=8, step=4, **more).select("capture", "seq_id", "start", "end", "alert", "summary.anomaly_score")
    one = sorted(map(str, serve().collect()))
    assert len(one) > 20 and [n for n, _ in paths] == ["grouped", "features", "cells", "scored"]
    assert [n for n, at in paths if os.path.exists(at)] == ["cells", "scored"]
    paths.clear()
    cells = SV.merged_cells(p, t, "seq", fitted, features)
    assert sorted(map(str, serve(cells=cells).collect())) == one and [n for n, _ in paths].count("grouped") == 1


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    kept = session.checkpoint(spark, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20   # the files go in the background
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 7


def test_no_lists_cross_the_window_over_chunks(spark):
    _, df = packets(spark)
    g = G.groups(df, track("cap", "seq", 50), G.offline_key(df))
    plan = G.merge_online(g, "cap", "seq")._jdf.queryExecution().optimizedPlan().toString()
    window = [line for line in plan.splitlines() if "Window [" in line]
    assert window and not any("_l_" in line for line in window)


def test_online_key(spark):
    df = spark.createDataFrame([("modbus", "t1", "", "9", 10), ("xgt-fen", "", "4", None, 10), ("xgt_fen", None, None, None, 11),
                                ("arp", "t1", "1", None, 1)], "protocol string, timestamp string, sq string, tid string, ms bigint")
    got = [r["k"] and tuple(r["k"]) for r in df.select(G.online_key(df, ts_ms="ms").alias("k")).collect()]
    assert got == [("modbus", "t1", "9"), ("xgt_fen", "3", "bucket"), ("xgt_fen", "3", "bucket"), None]


@pytest.mark.parametrize("block,fraction", [(7, 1.0), (10_000, 1.0), (7, 0.01)])
def test_fifo_match_uses_each_packet_once(spark, block, fraction):
    r = random.Random(5)
    keys = [("hot", "1", "1", "1") if r.random() < 0.5 else (str(r.randint(0, 5)), "1", "1", "1") for _ in range(400)]
    raw = [(i, *k) for i, k in enumerate(keys[:220])]
    lines = [(i, i // 8, *k) for i, k in enumerate(keys[180:])]
    rdf = spark.createDataFrame(raw, "seq bigint, ts string, sq string, ak string, fl string").repartition(4)
    ldf = spark.createDataFrame(lines, "line bigint, win bigint, ts string, sq string, ak string, fl string").repartition(3)
    got = M.match_fifo(ldf, rdf, M.MATCH_KEYS, track((), "line", block), track((), "seq", block),
                       fraction=fraction).collect()
    queues = defaultdict(deque)
    for i, *k in raw:
        queues[tuple(k)].append(i)
    want = {ln: queues[tuple(k)].popleft() for ln, _, *k in lines if queues[tuple(k)]}
    assert {g["line"]: g["seq"] for g in got} == want
    assert len({g["seq"] for g in got}) == len(got)


def test_line_fields(spark):
    lines = ['x @timestamp="2024-01-01T00:00:00.1Z" sq=1 ak: "2", fl=0x10>', "@timestamp=2024 sq=1 ak=2",
             '{"@timestamp": "t", "sq": 1, "ak": 2, "fl": 3}', '{"timestamp": "t", "sq": 1, "ak": 2}', ""]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    got = [r["f"] and tuple(r["f"]) for r in df.select(M.line_fields(F.col("v")).alias("f")).collect()]
    assert got == [("2024-01-01T00:00:00.1Z", "1", "2", "0x10"), None, ("t", "1", "2", "3"), None, None]


def test_positions_and_reasons(spark):
    win = spark.createDataFrame([("w", 0, "a"), ("w", 1, "b"), ("w", 2, "a"), ("v", 0, "a")], "w string, pos int, k string")
    pat = spark.createDataFrame([(1, "w", 0, "a", "scan"), (1, "w", 1, "a", "scan"), (2, "w", 0, "b", "x"), (2, "w", 1, "b", "x"),
                                 (3, "z", 0, "a", "x"), (4, "w", 0, "a", " NOISE "), (5, None, 0, "a", "x"), (6, "w", 0, None, "x")],
                                "p int, w string, line int, k string, label string")
    pos = M.pattern_positions(pat.where("label != ' NOISE '"), win, ["k"], "w", "p", "line", "pos")
    assert {r["p"]: r["index"] for r in M.position_array(pos, "p", "line", "pos").collect()} == {1: [0, 2]}
    why = {r["reason"]: r["n"] for r in M.skip_reasons(pat, win, ["k"], "w", "p", "line", "pos", "label").collect()}
    assert why == {"written": 1, "unmatched": 2, "unknown_window": 1, "noise": 1, "no_window_id": 1}
