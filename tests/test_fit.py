"""Fitted tables on literal packets, small and block-wise."""

import pytest
from pyspark.sql import functions as F

from railtap.operators import features as X
from railtap.operators import fit as FT

DDL = ("seq bigint, protocol string, sip string, smac string, dip string, dmac string, len string, dir string, "
       "modbus_translated_addr string, modbus_regs_val string, xgt_fen_vars string, xgt_fen_data string")


def packets(spark):
    rows = [(0, "modbus", "b", "m", "a", "m", "10", "request", "[5,10]", "[1.5,2]", None, None),
            (1, "modbus", "a", "m", "", "m", "0x14", "x", "10;9", "4;8", None, None),
            (2, "xgt_fen", "c", "m", "a", "m", None, "response", None, None, "%Z,%A", "00 FF"),
            (3, "xgt_fen", "c", None, "a", "m", "30", None, None, None, "%A", None)]
    return spark.createDataFrame(rows, DDL).repartition(3)


def test_fit_and_featurise(spark):
    p = packets(spark)
    f = X.fit(p)
    assert {r["token"]: r["id"] for r in f.host_vocab.collect()} == {"a|m": 1, "b|m": 2, "c|m": 3}
    assert {r["name"]: r["id"] for r in f.var_vocab.collect()} == {"%Z": 1, "%A": 2}
    slots = {r["addr"]: (r["slot"], r["vmin"], r["vmax"]) for r in f.slot_params.collect()}
    assert slots == {"5": (0, 1.5, 1.5), "9": (1, 8.0, 8.0), "10": (2, 2.0, 4.0)}
    lim = {r["feature"]: (r["vmin"], r["vmax"]) for r in f.norm_params.collect()}
    # a missing length counts as 0, so the range starts there
    assert lim["len_norm"] == (0.0, 30.0) and lim["xgt_data_n_bytes"] == (0.0, 2.0)
    rows = {r["seq"]: r for r in X.featurise(p, f, ["seq"]).collect()}
    assert [rows[i]["src_host_id"] for i in range(4)] == [2.0, 1.0, 3.0, 0.0]
    assert rows[1]["dst_host_id"] == 0.0 and rows[0]["protocol"] == 4.0 and rows[0]["dir_code"] == 1.0
    sparse = {i: {x["name"]: x["value"] for x in r["slots"]} for i, r in rows.items()}
    assert sparse[0] == {"modbus_slot_10_norm": 0.0, "modbus_slot_5_norm": 0.0} and sparse[2] == {}
    assert sparse[1] == {"modbus_slot_10_norm": pytest.approx(1.0), "modbus_slot_9_norm": 0.0}
    wide = X.featurise(p, f, ["seq"]).where("seq = 0").select(
        *[e.alias(n) for n, e in X.slot_columns(F.col("slots"), ["modbus_slot_10_norm", "modbus_slot_9_norm"]).items()]).first()
    assert tuple(wide) == (0.0, -1.0)
    assert rows[3]["xgt_var_id"] == 2.0 and rows[2]["xgt_var_id"] == 0.0    # looked up by the whole text
    assert rows[0]["xgt_var_id"] == -1.0 and rows[2]["xgt_data_mean_byte"] == 127.5
    fit_rows = {r["seq"]: r for r in X.featurise_fit(p, f, ["seq"]).collect()}
    assert fit_rows[2]["xgt_var_id"] == 1.0 and fit_rows[3]["src_host_id"] == -1.0 and fit_rows[2]["dir_code"] == 0.0
    assert fit_rows[2]["len_norm"] == -1.0


def test_values_outside_the_fitted_range(spark):
    f = X.fit(packets(spark))
    late = spark.createDataFrame([(9, "modbus", "z", "m", "a", "m", "99", None, "[10]", "[7]", None, None)], DDL)
    r = X.featurise(late, f, ["seq"]).first()
    assert (r["len_norm"], [tuple(x) for x in r["slots"]], r["src_host_id"]) == (-2.0, [("modbus_slot_10_norm", -2.0)], 0.0)


def test_empty_input_has_empty_ranges(spark):
    f = FT.ranges(packets(spark).where("false"), {"a": F.col("seq")}).first()
    assert (f["vmin"], f["vmax"]) == (-1.0, -1.0)


def test_wide_address_spaces_stay_sparse(spark):
    rows = [(i, "modbus", None, None, None, None, None, None, f"[{i},{i + 1},70000]", f"[{i},1,2]", None, None) for i in range(3000)]
    p = spark.createDataFrame(rows, DDL).repartition(4)
    f = X.fit(p)
    assert f.slot_params.count() == 3002
    out = X.featurise(p, f, ["seq"])
    assert len(out.columns) < 70
    assert out.select(F.size("slots").alias("n")).distinct().collect() == [(3,)]


@pytest.mark.parametrize("hot", [[], None])
def test_salted_tokens_give_the_same_ids(spark, monkeypatch, hot):
    p = spark.range(400).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "h|m").otherwise(F.concat(F.lit("t"), F.col("id") % 9)).alias("t"))
    vocab = p.select(F.col("t").alias("token")).distinct().withColumn("id", F.hash("token").cast("bigint"))
    none = spark.createDataFrame([], "token string, name string, id bigint")
    if hot is None:   # every token salted
        hot = [r[0] for r in vocab.select(F.xxhash64(F.lit("host"), "token")).collect()]
    monkeypatch.setattr(X, "hot_keys", lambda *a: hot)
    got = X.encode(p, FT.Fitted(vocab, none, none, None, None), {"x": ("host", F.col("t"), 0.0), "y": ("arp", F.col("t"), -1.0)})
    assert got.count() == 400 and got.where(F.col("x") != F.hash("t")).count() == 0 and got.where("y != -1").count() == 0
