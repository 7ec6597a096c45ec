"""Capture files, parameter files, sinks, and streams against batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from railtap.operators import merge as G
from railtap.operators.order import track
from railtap.plans import training as TR
from railtap.session import fresh_path, shared_dir
from railtap.sources import jsonl as J
from railtap.sources import params as P
from railtap.sources import sinks as K
from railtap.streaming import merge as SM
from railtap.streaming import source as SS
from railtap.streaming import windows as SW


def write(path, lines, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_capture_with_bom_blank_and_bad_lines(spark, tmp_path):
    lines = [json.dumps({"protocol": "modbus", "modbus.fc": 6, "modbus.regs.addr": [1, 2], "@timestamp": "1970-01-01T00:00:01"}),
             "", "not json", "[1]", json.dumps({"modbus": {"fc": "0x10"}, "sq": 5}),
             json.dumps({"origin": {"protocol": "arp"}, "_meta": {"redis_id": "9-1", "packet_timestamp_ms": 77}})]
    path = write(tmp_path / "cap.jsonl", lines, bom=True)
    rows = {r["line_no"]: r for r in J.read_packets(spark, path).collect()}
    assert sorted(rows) == [1, 5, 6]
    assert (rows[1]["modbus_fc"], rows[1]["modbus_regs_addr"], rows[1]["meta"]["ts_ms"]) == ("6", "[1,2]", 1000)
    assert (rows[5]["protocol"], rows[5]["modbus_fc"], rows[5]["meta"]["ts_ms"]) == ("unknown", "0x10", 5)
    assert rows[5]["meta"]["id"] == f"file:{rows[5]['file']}:5" and rows[5]["file"].endswith("/cap.jsonl")
    assert (rows[6]["meta"]["id"], rows[6]["meta"]["packet_ts_ms"], rows[6]["protocol"]) == ("9-1", 77, "arp")
    bad = J.read_packets(spark, path, keep_bad=True).where("raw is not null").orderBy("line_no").collect()
    assert [r["raw"] for r in bad] == ["not json", "[1]"]


def test_line_numbers_across_splits(spark, tmp_path):
    path = write(tmp_path / "long.txt", [f"line {i}" for i in range(1, 20001)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = J.read_lines(spark, path)
        assert df.count() == 20000
        assert df.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_check_capture(spark, tmp_path):
    with pytest.raises(ValueError):
        J.check_capture(spark, write(tmp_path / "empty.jsonl", ["", " "]))
    with pytest.raises(ValueError):
        J.check_capture(spark, write(tmp_path / "junk.jsonl", ["a", "b"]))
    with pytest.raises(ValueError):
        J.check_capture(spark, write(tmp_path / "broken.jsonl", ["{broken", "{}"]))
    J.check_capture(spark, write(tmp_path / "ok.jsonl", ["", "{}"]))


def test_dictionaries_and_policy(spark, tmp_path):
    path = write(tmp_path / "vocab.json", [json.dumps({"b": 2, "a": 1}, indent=1)], bom=True)
    assert {(r["token"], r["id"]) for r in P.load_dictionary(spark, path).collect()} == {("a", 1), ("b", 2)}
    assert P.load_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    path = write(tmp_path / "norm.json", [json.dumps({"sp_min": 0, "sp_max": 9.5})])
    assert [tuple(r) for r in P.load_ranges(spark, path).collect()] == [("sp", 0.0, 9.5)]
    text = write(tmp_path / "w.txt", ["#   use feature_name    weight", "O a 2.0", "X b 1.0", "c", "d 0.5", "o e heavy", ""])
    got = {r["name"]: (r["use"], r["weight"]) for r in P.read_policy(spark, text).collect()}
    assert got == {"a": (True, 2.0), "b": (False, 1.0), "c": (True, 1.0), "d": (True, 0.5), "e": (True, 1.0)}
    cat = P.catalog(spark, ["x", "match", "x"])
    assert [r["name"] for r in cat.orderBy("pos").collect()] == ["protocol", "delta_t", "x", "match"]
    assert P.catalog_lines(cat).first()["value"].split() == ["O", "protocol", "1.0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, None, float("inf")], {"a": 1.0, "b": None})],
                               "i int, x double, l array<double>, m map<string,double>")
    out = str(tmp_path / "out")
    assert K.count_records(spark, out) == 0
    K.append_jsonl(df, out)
    K.append_jsonl(df, out)
    assert K.count_records(spark, out) == 2
    line = spark.read.text(out).first()["value"]
    assert json.loads(line) == {"i": 1, "l": [1.0], "m": {"a": 1.0}}


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def deliver(spark, rows, ddl, cuts):
    path = fresh_path(spark, "test-stream")
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], ddl).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("cuts", [[0, 120], [0, 1, 50, 52, 120]])
@pytest.mark.parametrize("size,step", [(10, 4), (6, 6)])
def test_stream_windows_equal_batch(spark, cuts, size, step):
    ddl = "capture string, ts_ms bigint, id_seq bigint, x double"
    rows = [("ab"[i % 5 == 0], i, i, float(i % 7)) for i in range(120)]
    job = SW.WindowStream(spark, fresh_path(spark, "test-windows"), size, step, {"x": ("rows", F.col("x"))}, ("x",))
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + b % 2):   # every other batch is replayed
            job(spark.createDataFrame(rows[lo:hi], ddl).repartition(3), b)
    got = {(r["capture"], r["window_id"]): r["x"] for r in job.windows().collect()}
    want = {}
    for cap in "ab":
        x = [r[3] for r in rows if r[0] == cap]
        want |= {(cap, w): x[w * step:w * step + size] for w in range((len(x) - size) // step + 1)}
    assert got == want
    left = job.tables.read("tail", len(cuts) - 2).groupBy("capture").count().collect()
    assert all(r["count"] < size + step for r in left)


@pytest.mark.parametrize("cuts", [[0, 60], [0, 7, 8, 31, 60]])
def test_stream_merge_equals_batch(spark, cuts):
    ddl = "capture string, ts_ms bigint, id_seq bigint, protocol string, timestamp string, sq string, modbus_fc string"
    rows = [("ab"[i % 2], i, i, "arp" if i % 11 == 0 else "modbus", f"t{i // 8}", "1", str(i % 3)) for i in range(60)]
    job = SM.MergeStream(spark, fresh_path(spark, "test-merge"), block_width=5)
    q = SS.start(SS.read_folder(spark, deliver(spark, rows, ddl, cuts), ddl, files_per_trigger=1)
                 .writeStream.foreachBatch(job), fresh_path(spark, "test-ck"))
    q.awaitTermination()
    job.finish(q.lastProgress["batchId"])
    df = spark.createDataFrame(rows, ddl)
    batch = G.merge_online(G.groups(df, track("capture", "id_seq", 7), G.online_key(df)), "capture", "id_seq")
    cols = ["capture", "merge_event_id", "raw_count", "id_seq", "modbus_fc"]
    key = lambda d: sorted(tuple(r[c] for c in cols) for r in d.collect())
    assert key(job.merged()) == key(batch)


def test_replayed_batch_changes_nothing(spark):
    ddl = "capture string, ts_ms bigint, id_seq bigint, protocol string, timestamp string, sq string, modbus_fc string"
    df = spark.createDataFrame([("a", i, i, "modbus", f"t{i // 3}", "1", "6") for i in range(10)], ddl)
    job = SM.MergeStream(spark, fresh_path(spark, "test-merge"))
    for part, b in ((df.where("id_seq < 5"), 0), (df.where("id_seq >= 5"), 1), (df.where("id_seq >= 5"), 1)):
        job(part, b)
    job.finish(1)
    assert sorted(r["raw_count"] for r in job.merged().collect()) == [1, 3, 3, 3]


def test_open_group_is_appended_and_old_versions_go(spark):
    ddl = "capture string, ts_ms bigint, id_seq bigint, protocol string, timestamp string, sq string, modbus_fc string"
    root = fresh_path(spark, "test-merge")
    job = SM.MergeStream(spark, root)
    for b in range(6):
        rows = [("a", i, i, "modbus", "t", "1", str(i)) for i in range(10 * b, 10 * b + 10)]
        rows += [("b", i, i, "modbus", f"t{i}", "1", "6") for i in range(10 * b, 10 * b + 2)]
        assert job(spark.createDataFrame(rows, ddl), b) == (1 if b == 0 else 2)   # of capture b only
    parts = [spark.read.parquet(f"{root}/open/batch_id={b}").groupBy("capture").count().collect() for b in range(6)]
    assert [{r["capture"]: r["count"] for r in p} for p in parts] == [{"a": 10, "b": 1}] * 6
    assert sorted(os.listdir(f"{root}/counters")) == ["batch_id=4", "batch_id=5"]
    assert job.standing() == (72, 2)
    assert job.finish(5) == 2 and job.standing() == (72, 0)
    a = job.merged().where("capture = 'a'").first()
    assert a["raw_count"] == 60 and json.loads(a["modbus_fc"]) == [str(i) for i in range(60)]
    assert job.merged().where("capture = 'b'").count() == 12


def test_ticks_close_quiet_captures_only(spark):
    ddl = "capture string, ts_ms bigint, id_seq bigint, protocol string, timestamp string, sq string, _at_ms bigint, _tick_ms bigint"
    row = lambda cap, i, at: (cap, i, i, "modbus", "t", "1", at, None)
    tick = lambda cap, at: (cap, None, None, None, None, None, None, at)
    job = SM.MergeStream(spark, fresh_path(spark, "test-merge"), idle_ms=100)
    batches = [[row("a", 0, 1000), row("b", 1, 1000), row("a", 2, 1000)], [row("b", 3, 1090), tick("a", 1090)],
               [tick("a", 1100), tick("b", 1100)], [tick("b", 1190)], [row("a", 9, 1300)]]
    closed = [[job(spark.createDataFrame(rows, ddl), b) for _ in range(2)] for b, rows in enumerate(batches)]
    assert closed == [[0, 0], [0, 0], [1, 1], [1, 1], [0, 0]]
    job.finish(4)
    got = sorted((r["capture"], r["merge_event_id"], r["raw_count"]) for r in job.merged().collect())
    assert got == [("a", 1, 2), ("a", 2, 1), ("b", 1, 2)]


def test_model_folder(spark):
    cat = P.catalog(spark, ["x"])
    from pyspark.ml.feature import PCA
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.feature import PCAModel
    model = PCA(k=1, inputCol="v", outputCol="z").fit(spark.createDataFrame([(Vectors.dense(float(i), 2.0 * i),) for i in range(5)], ["v"]))
    thr = spark.createDataFrame([(0.5,)], "threshold_p99 double")
    path = fresh_path(spark, "test-model")
    TR.Bundle(model, cat, thr, {"T": "8"}).save(path)
    b = TR.Bundle.load(spark, path, PCAModel)
    assert b.config == {"T": "8"} and b.threshold.first()[0] == 0.5 and b.catalog.count() == 4
    assert b.model.pc.toArray().shape == (2, 1)


def test_reconstructor_recovers_low_rank_windows(spark):
    rows = [(i, [[float(i % 7), 2.0 * (i % 7)], [float(i % 5), 1.0]]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>")
    _, errors, cal = TR.train_reconstructor(df, "id", "x", 2, 2, k=2)
    assert errors.agg(F.max("mse")).first()[0] < 1e-9 and errors.count() == 200
    assert errors.where("part = 'test'").count() > 0 and cal.count() == 1


def test_external_model_runs_on_batches(spark):
    from railtap.operators.score import reconstruct_with
    df = spark.range(10).withColumn("x", F.col("id") * 1.0)
    got = reconstruct_with(df, lambda pdf: pdf.assign(xh=pdf.x + 1), "id bigint, x double, xh double").collect()
    assert all(r["xh"] == r["x"] + 1 for r in got) and len(got) == 10
