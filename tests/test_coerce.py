"""Literal cases of the coercions and scalar formulas."""

import math

import pytest
from oracle import session
from pyspark.sql import functions as F

from railtap.functions import coerce as C
from railtap.functions import risk as R
from railtap.functions import scalars as S


def one(spark, expr, *values, ddl="v string"):
    """Values of an expression over a one-column frame."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(expr.alias("o")).collect()]


session()   # column expressions need a running session
V = F.col("v")


def test_safe_int(spark):
    given = ["12", " 7 ", "-5", "+3", "0", "00", "010", "6.0", "0x1F", "0X1f", "-0x10", "0o17", "0b101", "[9,4]",
             '["0x0A"]', "[]", "", None, "true", "0xZZ", "1_0"]
    want = [12, 7, -5, 3, 0, 0, 0, 0, 31, 31, -16, 15, 5, 9, 10, 0, 0, 0, 0, 0, 0]
    assert one(spark, C.safe_int(V), *given) == want


def test_safe_int_offline(spark):
    given = ["010", "0x1F", "[null, 8]", "6.0", None, "x"]
    assert one(spark, C.safe_int_offline(V, -1), *given) == [10, 31, 8, -1, -1, -1]


def test_to_int_and_hex(spark):
    assert one(spark, C.to_int(V), "6.0", "6.5", "0x10", "1e2", "", "a", None) == [6, None, 16, 100, None, None, None]
    assert one(spark, C.hex_or_decimal_int(V), "0x0A", "3.9", "-3.9", "nan", "inf", "", "z") == [10, 3, -3, None, None, None, None]


def test_float_grammar(spark):
    got = one(spark, C.safe_float(V), "1.5", " 2 ", "1d", "0x10", "", None, "[3.5, 1]", "1e3", ".5", "5.")
    assert got == [1.5, 2.0, -1.0, -1.0, -1.0, -1.0, 3.5, 1000.0, 0.5, 5.0]
    assert math.isnan(one(spark, C.safe_float(V), "nan")[0])
    assert one(spark, C.safe_float(V, 0.0, finite=True), "nan", "inf") == [0.0, 0.0]


def test_coerce_scalar(spark):
    got = one(spark, C.coerce_scalar(V), "5", "-5", "+5", "0x0f", "1.5", "2e1", "abc", "", "here")
    want = [(5, None, None), (-5, None, None), (None, None, "+5"), (15, None, None), (None, 1.5, None),
            (None, 20.0, None), (None, None, "abc"), (None, None, ""), (None, None, "here")]
    assert [tuple(g) for g in got] == want


def test_match_code(spark):
    assert one(spark, C.match_code(V), "O", "ok", "1", "X", "false", "0", "maybe", None) == [1, 1, 1, 0, 0, 0, -1, -1]


def test_iso(spark):
    got = one(spark, C.iso_epoch_ms(V), "1970-01-01T00:00:01.5", "1970-01-01T00:00:01Z", "1970-01-01T09:00:01+09:00",
              "1970-01-02", "no", "", None)
    assert got == [1500, 1000, 1000, 86400000, 0, 0, 0]


def test_lists(spark):
    assert one(spark, C.str_list(V), '["a"," b ",""]', "a;b c", "", None) == [["a", "b"], ["a", "b", "c"], [], []]
    assert one(spark, C.float_list(V), "[1,2.5,\"x\"]", "1;2,3", "[[1,2],[3]]", None) == [[1.0, 2.5], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], []]
    assert one(spark, C.int_list(V), "[1,2.9]", "0x10 3;010", None) == [[1, 2], [16, 3], []]
    assert one(spark, C.name_list(V), "%A, nan,%B", '["x",null,"none"]', "null") == [["%A", "%B"], ["x"], []]
    assert one(spark, C.address_numbers(V), '["D0100","M7x9","q"]', "D5", None) == [[100.0, 7.0], [5.0], []]
    assert one(spark, C.hex_word_list(V), '["0x0A","7.9","z"]', "12", None) == [[10.0, 7.0], [12.0], []]


def test_minmax(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0), (5.0, None, 1.0), (2.0, 0.0, 1.0), (1.0, 1.0, 1.0), (0.5, 0.0, 1.0)],
                               "x double, lo double, hi double")
    got = [tuple(r) for r in df.select(S.minmax_sentinel(F.col("x"), F.col("lo"), F.col("hi")),
                                       S.minmax_plain(F.col("x"), F.col("lo"), F.col("hi"))).collect()]
    assert got[0] == (0.0, -1.0) and got[1] == (0.0, -1.0) and got[2] == (-2.0, 2.0) and got[3] == (0.0, 0.0)
    assert got[4] == (pytest.approx(0.5), 0.5)


def test_payload(spark):
    df = spark.createDataFrame([("00 FF",), ("0",), ("",), (None,), ("zz",)], "v string").withColumn("b", S.payload_bytes(V))
    st = S.payload_stats(V, F.col("b"))
    got = [tuple(r) for r in df.select(*[st[k] for k in ("missing", "is_hex", "n_bytes", "zero_ratio", "first_byte", "last_byte", "mean_byte", "bucket")]).collect()]
    assert got[0] == (0.0, 1.0, 2.0, 0.5, 0.0, 255.0, 127.5, 1.0)
    assert got[1][1] == 0.0 and got[2][:3] == (0.0, 1.0, 0.0) and got[3][:2] == (1.0, 0.0) and got[4][1] == 0.0


def test_pair_map(spark):
    df = spark.createDataFrame([(["a", "b", "a"], [1.0, 2.0, 3.0, 4.0])], "k array<string>, v array<double>")
    z = S.zip_shortest(F.col("k"), F.col("v"))
    first, last = df.select(S.pair_map(z), S.pair_map(z, last=True)).first()
    assert first == {"a": 1.0, "b": 2.0} and last == {"a": 3.0, "b": 2.0}


def test_moments(spark):
    df = spark.createDataFrame([([1, 2, 4],), ([],)], "v array<int>")
    m = S.moment_stats(V, -1.0)
    a, b = df.select(m["mean"], m["std"], m["min"]).collect()
    assert a[0] == pytest.approx(7 / 3) and a[1] == pytest.approx(1.247219128924647) and tuple(b) == (-1.0, -1.0, -1.0)


def test_stable_hash_and_names(spark):
    assert one(spark, S.stable_hash(V, 1000), "a") == [int("0cc175b9", 16) % 1000]
    assert S.slot_column_name("%DB 10.4", "xgt") == "xgt_slot_DB10_4_norm"
    assert one(spark, S.slot_column_expr(V, "xgt"), "%DB 10.4") == ["xgt_slot_DB10_4_norm"]


def test_asset_value(spark):
    assert one(spark, R.asset_value(V), "PLC-1", "hmi", "Historian", "ENG", "file server", "core switch", "x", "", None) == \
        [1.0, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.6, 0.6]


def test_risk_bounds(spark):
    import itertools
    rows = list(itertools.product([0.0, 0.32, 5.0], [0.0, 1e9], [None, 0.0, 1.0], [None, 0.0, 3.0]))
    df = spark.createDataFrame(rows, "s double, t double, p double, e double")
    parts = R.risk(F.lit(True), F.col("s"), F.lit(0.32), F.col("t"), F.col("p"), F.col("e"), F.lit(10), F.lit(1.0))
    assert all(0.0 <= r[0] <= 100.0 for r in df.select(parts["score"]).collect())
    calm = R.risk(F.lit(False), F.col("s"), F.lit(0.32), F.col("t"), F.col("p"), F.col("e"), F.lit(10), F.lit(1.0))
    assert {r[0] for r in df.select(calm["score"]).collect()} == {0.0}


def test_risk_value(spark):
    """One value worked out by hand from the formula."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    sev, tem, sem = (sig(6 * (2 - 1)) - 0.5) * 2, math.log10(1 + 9) / 6, 0.5
    like = 1 - (1 - sev) * (1 - 0.6 * tem) * (1 - 0.35 * sem)
    conf = 0.65 * sig(3.0) + 0.35 * (0.5 * 0.5 + 0.5 * (1 - 1.0 / math.log(4)))
    want = math.floor((1 - math.exp(-6 * 0.9 * like * conf)) ** 0.85 * 1e4 + 0.5) / 100
    parts = R.risk(F.lit(True), F.lit(2.0), F.lit(1.0), F.lit(9.0), F.lit(0.5), F.lit(1.0), F.lit(4), F.lit(0.9))
    assert spark.range(1).select(parts["score"]).first()[0] == pytest.approx(want)
