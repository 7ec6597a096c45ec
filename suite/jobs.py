"""Job queries: scans, sinks, catalogs, fit-and-transform, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.operators import evaluate as EV
from railtap.operators import features as X
from railtap.operators import order as O
from railtap.operators.score import anomaly_prediction, error_train, squared_errors
from railtap.operators.windows import compact
from railtap.plans import offline as OFF
from railtap.plans import serve as SV
from railtap.plans import training as TR
from railtap.schema import ARP_FEATURES, DNS_FEATURES, MODBUS_FEATURES, S7COMM_FEATURES
from railtap.session import fresh_path
from railtap.sources import jsonl as J
from railtap.sources import params as P
from railtap.sources import sinks as K
from suite.base import event_track, packets, pkt_sql, query, r6, round_doubles, sql_r6, table
from suite.fitting import (_ARPS, _FEATURE_FROM, _FIRST_VAR, _FIT_FEATURES, _HOSTS, _PARSED, _SERVE_SQL, _VARS, _fitted)
from suite.scoring import _CELLS, D, T, reconstructed, vectors

# Capture lines as files hold them: bare packets, nested protocol objects, envelopes, blank and broken lines.
_LINE = r"""CASE seq % 5
 WHEN 0 THEN concat('{"@timestamp":"', timestamp, '","protocol":"', protocol, '","sip":"', sip, '","modbus.fc":', modbus_fc, ',"modbus.regs.addr":', modbus_regs_addr, ',"sq":"', cast(seq as string), '"}')
 WHEN 1 THEN concat('{"timestamp":"', timestamp, '","sip":"', sip, '","modbus":{"fc":"', modbus_fc, '"},"sq":"', cast(seq as string), '"}')
 WHEN 2 THEN concat('{"origin":{"@timestamp":"', timestamp, '","sip":"', sip, '","sq":"', cast(seq as string), '"},"_meta":{"redis_id":"', cast(seq as string), '-7","redis_timestamp_ms":', cast(1000 + seq as string), ',"protocol":"', protocol, '"}}')
 WHEN 3 THEN CASE WHEN seq % 2 = 0 THEN '   ' ELSE concat('{"sip": ', sip, '') END
 ELSE concat('["', sip, '"]') END"""


@query("jsonl_scan", f"""WITH {pkt_sql('seq', 'timestamp', 'protocol', 'sip', 'modbus_fc', 'modbus_regs_addr', 'ts_us', 'k')}
SELECT CAST(seq AS VARCHAR) AS sq, CASE seq % 5 WHEN 1 THEN 'unknown' ELSE protocol END AS protocol, sip, CASE WHEN seq % 5 < 2 THEN modbus_fc END AS modbus_fc,
 CASE WHEN seq % 5 = 0 THEN modbus_regs_addr END AS modbus_regs_addr, CASE WHEN seq % 5 = 2 THEN 1000 + seq ELSE ts_us // 1000 END AS ts_ms, ts_us // 1000 AS packet_ts_ms,
 seq % 5 = 2 AS given_id FROM pkt WHERE seq % 5 < 3""")
def jsonl_scan(spark, sf):
    """Capture files written as text and read back as packets with envelopes."""
    p = packets(spark, sf, "seq", "timestamp", "protocol", "sip", "modbus_fc", "modbus_regs_addr", "k")
    path = fresh_path(spark, "capture")
    p.select(F.expr(_LINE).alias("value")).write.text(path)
    r = J.read_packets(spark, path)
    return r.select("sq", "protocol", "sip", "modbus_fc", "modbus_regs_addr", F.col("meta.ts_ms").alias("ts_ms"),
                    F.col("meta.packet_ts_ms").alias("packet_ts_ms"), (~F.col("meta.id").startswith("file:")).alias("given_id"))


@query("stored_dictionaries", """SELECT 'count' AS what, CAST(user_id AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b FROM events GROUP BY user_id
UNION ALL SELECT 'range', event_type, min(value), max(value) FROM events GROUP BY event_type""")
def stored_dictionaries(spark, sf):
    """A dictionary and a range file written from the events and loaded again."""
    ev, root = table(spark, sf, "events"), fresh_path(spark, "dictionaries")

    def store(rows, name):  # one object per file: a few hundred names
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(f"{root}/{name}")

    store(ev.groupBy(F.col("user_id").cast("string").alias("k")).agg(F.count("*").alias("v")), "counts")
    ends = ev.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    store(ends.select(F.inline(F.array(F.struct(F.concat("event_type", F.lit("_min")).alias("k"), F.col("lo").alias("v")),
                                       F.struct(F.concat("event_type", F.lit("_max")).alias("k"), F.col("hi").alias("v"))))), "ranges")
    counts = P.load_dictionary(spark, f"{root}/counts")
    ranges = P.load_ranges(spark, f"{root}/ranges")
    n = F.col("id").cast("double")
    return counts.select(F.lit("count").alias("what"), F.col("token").alias("name"), n.alias("a"), n.alias("b")).unionAll(
        ranges.select(F.lit("range"), "feature", "vmin", "vmax"))


@query("catalog_file", """WITH f AS (SELECT DISTINCT event_type AS name FROM events)
SELECT name, true AS use, 1.0e0 AS weight FROM f UNION ALL SELECT unnest(['protocol', 'delta_t', 'match']), true, 1.0e0""")
def catalog_file(spark, sf):
    """A feature catalog written as policy lines and read again."""
    names = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    path = fresh_path(spark, "catalog")
    P.catalog_lines(P.catalog(spark, names)).write.text(path)
    return P.read_policy(spark, path)


@query("alert_ids_continued", f"""WITH {pkt_sql('seq', 'k')}, old AS (SELECT count(*) AS n FROM pkt WHERE k % 2 = 0)
SELECT seq, row_number() OVER (ORDER BY seq) + (SELECT n FROM old) AS alert_seq_id FROM pkt WHERE k % 2 = 1""")
def alert_ids_continued(spark, sf):
    """Alert ids that run on from the records stored before, counted from the files."""
    p = packets(spark, sf, "seq", "k")
    path = fresh_path(spark, "records")
    K.append_jsonl(p.where("k % 4 = 0"), path)
    K.append_jsonl(p.where("k % 4 = 2"), path)
    rest = p.where("k % 2 = 1").withColumn("run", F.lit(0))
    return O.with_ordinal(rest, event_track(rest, "run"), "alert_seq_id", start=K.count_records(spark, path) + 1).select("seq", "alert_seq_id")


def _rename_only(spark, folder: str) -> None:
    """Give the one text file below ``folder``/part the name p.jsonl."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    part = jvm.Path(f"{folder}/part")
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = next(f.getPath() for f in fs.listStatus(part) if f.getPath().getName().startswith("part-"))
    fs.rename(name, jvm.Path(f"{folder}/p.jsonl"))


@query("jsonl_scan_folders", """SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder, event_id, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS line_no,
 true AS own_id FROM events""")
def jsonl_scan_folders(spark, sf):
    """Two folders with files of one name: each file counts its own lines and names its own packets."""
    p = packets(spark, sf, "seq")
    root = fresh_path(spark, "folders")
    for k, folder in enumerate("ab"):
        lines = p.where(F.col("seq") % 2 == k).repartitionByRange(1, "seq").sortWithinPartitions("seq")
        lines.select(F.concat(F.lit('{"sq": "'), F.col("seq").cast("string"), F.lit('"}')).alias("value")).write.text(f"{root}/{folder}/part")
        _rename_only(spark, f"{root}/{folder}")
    r = J.read_packets(spark, f"{root}/*/*.jsonl")
    own = F.col("meta.id") == F.concat(F.lit("file:"), "file", F.lit(":"), F.col("line_no").cast("string"))
    return r.select(F.regexp_extract("file", "/([ab])/p[.]jsonl$", 1).alias("folder"), F.col("sq").cast("bigint").alias("event_id"), "line_no", own.alias("own_id"))


@query("jsonl_scan_bad_lines", """SELECT count(*) FILTER (event_id % 5 < 3) AS good, count(*) FILTER (event_id % 10 = 3) + count(*) FILTER (event_id % 5 = 4) AS bad FROM events""")
def jsonl_scan_bad_lines(spark, sf):
    """Unparsable lines kept with their text; blank ones still skipped."""
    p = packets(spark, sf, "seq", "timestamp", "protocol", "sip", "modbus_fc", "modbus_regs_addr", "k")
    path = fresh_path(spark, "capture")
    p.select(F.expr(_LINE).alias("value")).write.text(path)
    J.check_capture(spark, path)
    return J.read_packets(spark, path, keep_bad=True).agg(F.count_if(F.col("raw").isNull()).alias("good"), F.count("raw").alias("bad"))


@query("sink_roundtrip", f"""WITH {pkt_sql('seq', 'capture', 'protocol', 'sip', 'value', 'k')} SELECT 'csv' AS sink, seq, protocol, sip, value FROM pkt
UNION ALL SELECT 'jsonl', seq, protocol, sip, value FROM pkt UNION ALL SELECT 'jsonl', seq, protocol, sip, value FROM pkt UNION ALL SELECT 'run', seq, protocol, sip, value FROM pkt
UNION ALL SELECT 'incoming', seq, protocol, sip, value FROM pkt""")
def sink_roundtrip(spark, sf):
    """Packets through every sink and back: CSV, appended lines (twice), run folder, incoming audit."""
    p = packets(spark, sf, "seq", "capture", "protocol", "sip", "value", "k").select("seq", "protocol", "sip", "value")
    root = fresh_path(spark, "sinks")
    K.write_csv(p, f"{root}/csv")
    for _ in range(2):
        K.append_jsonl(p, f"{root}/jsonl")
    for _ in range(2):
        K.write_run(p, f"{root}/run")
    inc = K.incoming_record(p.withColumn("meta", F.struct(F.col("protocol"))).withColumn("id", F.col("seq")), "id")
    K.append_jsonl(inc, f"{root}/incoming")
    ddl = "seq bigint, protocol string, sip string, value double"
    cols = ["seq", "protocol", "sip", "value"]
    csv = K.read_csv(spark, f"{root}/csv").withColumns({"seq": F.col("seq").try_cast("bigint"), "value": F.col("value").try_cast("double")})
    out = csv.select(F.lit("csv").alias("sink"), *cols)
    for n in ("jsonl", "run"):
        out = out.unionByName(spark.read.schema(ddl).json(f"{root}/{n}").select(F.lit(n).alias("sink"), *cols))
    inc_back = spark.read.schema(f"ingest_id bigint, origin struct<{ddl.replace(' ', ':').replace(',:', ',')}>").json(f"{root}/incoming")
    return out.unionByName(inc_back.select(F.lit("incoming").alias("sink"), "origin.*"))


@query("null_pruned_json", f"""WITH {pkt_sql('seq', 'dip', 'src_asset', 'value', 'k')}
SELECT seq, concat('{{"dip":"', dip, '"', CASE WHEN src_asset IS NOT NULL THEN concat(',"src_asset":"', src_asset, '"') ELSE '' END, CASE WHEN k % 3 <> 0 THEN concat(',"half":', CAST(k // 2 AS VARCHAR), '.0') ELSE '' END,
 ',"ks":[', CASE WHEN k % 2 = 0 THEN concat(CAST(k AS VARCHAR), ',') ELSE '' END, '7]}}') AS json FROM pkt""")
def null_pruned_json(spark, sf):
    """Rows as JSON without nulls, NaN or infinity at any depth; model fields dropped."""
    p = packets(spark, sf, "seq", "dip", "src_asset", "value", "k")
    half = F.when(F.col("k") % 3 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("k") / 2).cast("double"))
    ks = F.array(F.when(F.col("k") % 2 == 0, F.col("k")), F.lit(7))
    r = K.raw_entry(p.select("seq", "dip", "src_asset", half.alias("half"), ks.alias("ks"), F.lit(1).alias("ml")))
    return r.select("seq", K.as_json(r.drop("seq")).alias("json"))


_POLICY = ("CASE p_partkey % 5 WHEN 0 THEN concat('# ', name) WHEN 1 THEN concat('X ', name) WHEN 2 THEN concat('  o   ', name, '   ', w) "
           "WHEN 3 THEN concat(name, ' ', w) ELSE concat('O ', name, ' heavy') END")


@query("feature_catalog", """WITH n AS (SELECT p_partkey, 'f' || (p_partkey % 997) AS name, p_size * 0.5 AS w FROM part),
x AS (SELECT name FROM n GROUP BY 1 HAVING bool_or(p_partkey % 5 = 1)),
k AS (SELECT name, max(CASE WHEN p_partkey % 5 IN (2, 3) THEN w WHEN p_partkey % 5 = 4 THEN 1.0 END) AS weight FROM n GROUP BY 1)
SELECT name, CAST(coalesce(weight, 1.0) AS DOUBLE) AS weight FROM k WHERE name NOT IN (SELECT name FROM x)""")
def feature_catalog(spark, sf):
    """Policy lines parsed, excluded features taken out of the key set, weights attached."""
    n = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("f"), (F.col("p_partkey") % 997).cast("string")).alias("name"),
                                        (F.col("p_size") * 0.5).cast("string").alias("w"))
    policy = P.parse_policy(n.select(F.expr(_POLICY).alias("value"))).select("name", "use", "weight")
    return P.select_features(n, policy)


@query("feature_list_tokens", """SELECT p_partkey, list_last(string_split(trim(p_name), ' ')) AS name FROM part WHERE trim(p_name) <> ''""")
def feature_list_tokens(spark, sf):
    """Feature list lines: the last token counts."""
    return P.feature_names(table(spark, sf, "part"), "p_name").select("p_partkey", "name")


@query("json_dictionary", f"WITH {pkt_sql('sip', 'smac', 'dip', 'dmac', 'k')}, {_HOSTS} SELECT token, id FROM hosts")
def json_dictionary(spark, sf):
    """A fitted vocabulary stored as JSON objects and loaded again; an absent file adds nothing."""
    from railtap.operators import fit as FT
    p = packets(spark, sf, "sip", "smac", "dip", "dmac", "k")
    v = FT.sorted_vocabulary(p, [FT.host_token(F.col("sip"), F.col("smac")), FT.host_token(F.col("dip"), F.col("dmac"))])
    path = fresh_path(spark, "vocab")
    P.save_dictionary(v, path, "token", "id")
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "id"))
    return lines.select("token", F.col("id").try_cast("bigint").alias("id")).unionByName(P.load_dictionary(spark, path + "-absent"))


_JOB_FEATURES = ["src_host_id", "len_norm", "modbus_regs_val_std", "xgt_data_mean_byte", "dns_qc_norm"]


@query("fit_transform_job", f"""WITH {_PARSED}, {_HOSTS}, {_ARPS}, {_VARS}, rows AS (SELECT seq, {', '.join(f'{_SERVE_SQL[f]} AS {f}' for f in _JOB_FEATURES)} {_FEATURE_FROM}
 LEFT JOIN vars vv ON vv.name = nullif(xgt_fen_vars, '')) SELECT seq // 40 AS window_id, CAST(count(*) AS INT) AS n, {', '.join(f'{sql_r6(f"sum({f})")} AS {f}' for f in _JOB_FEATURES)} FROM rows GROUP BY 1 HAVING count(*) > 1""")
def fit_transform_job(spark, sf):
    """Fit, store, load, then featurise whole windows of packets."""
    p = packets(spark, sf)
    fitted = OFF.fit_and_save(p, fresh_path(spark, "fitted"))
    cols = [c for c in p.columns if c not in ("capture", "k", "user_id", "value", "ts_us")]
    win = p.groupBy(F.floor(F.col("seq") / 40).alias("window_id")).agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("sequence_group"))
    out = OFF.featurise_windows(win, "window_id", "sequence_group", fitted)
    total = lambda f: F.aggregate("sequence_group", F.lit(0.0), lambda a, s: a + s[f])
    return out.select("window_id", F.size("sequence_group").alias("n"), *[r6(total(f)).alias(f) for f in _JOB_FEATURES])


@query("tagged_multi_input", """WITH u AS (SELECT 'even' AS tag, event_type, 0.5 AS threshold, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'odd', event_type, value, value FROM events WHERE event_id % 2 = 1)
SELECT tag, event_type, count(*) AS n, CAST(count(*) FILTER (value > threshold) AS BIGINT) AS above FROM u GROUP BY tag, event_type""")
def tagged_multi_input(spark, sf):
    """Two tagged inputs through one job, defaults filled in."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    even, odd = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1").withColumn("threshold", F.col("value"))
    u = OFF.tagged_union({"even": even, "odd": odd}, {"threshold": 0.5})
    return u.groupBy("tag", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("threshold")).alias("above"))


@query("train_reconstructor")
def train_reconstructor(spark, sf):
    """Reconstructor trained on windows, errors of both parts and the threshold they give."""
    w = reconstructed(spark, sf).select("vec_id", "x")
    _, errors, cal = TR.train_reconstructor(w, "vec_id", "x", T, D, k=8, weights=[1.0 + 0.5 * i for i in range(D)])
    threshold = cal.first()["threshold_p99"]
    return round_doubles(errors.withColumn("threshold_p99", F.lit(threshold))
                         .withColumn("is_anomaly_pred", anomaly_prediction(F.col("mse"), threshold)))


@query("bagged_reconstructor")
def bagged_reconstructor(spark, sf):
    """Windows reconstructed by the mean of several bootstrap-fitted models."""
    from railtap.operators.score import error_eval, squared_errors
    w = reconstructed(spark, sf).select("vec_id", "x")
    out = TR.bagged_reconstructor(w, "vec_id", "x", T, D, k=8, members=3).apply(w)
    return round_doubles(out.select("vec_id", error_eval(F.col("x"), squared_errors(F.col("x"), F.col("xh"))).alias("mse")))


_DRAWN = " + ".join(f"CASE WHEN u >= {n} THEN 1 ELSE 0 END" for n in TR._POISSON)


@query("bagging_draws", f"""WITH {_CELLS}, h AS (SELECT vec_id, member, CAST('0x' || substr(md5('42|' || CAST(member AS VARCHAR) || '|' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 AS u
 FROM (SELECT DISTINCT vec_id FROM m) JOIN (SELECT unnest(range(0, 3)) AS member) ON true),
d AS (SELECT vec_id, member, {_DRAWN} AS n FROM h)
SELECT CAST(member AS INT) AS member, CAST(pos AS INT) AS pos, {sql_r6('sum(x * n) FILTER (x <> -1.0) / sum(n) FILTER (x <> -1.0)')} AS mean, (SELECT CAST(sum(n) AS BIGINT) FROM d t WHERE t.member = d.member) AS drawn
FROM m JOIN d USING (vec_id) GROUP BY member, pos""")
def bagging_draws(spark, sf):
    """Bootstrap draws of the windows and the cell means that the members are fitted around."""
    w = reconstructed(spark, sf).select("vec_id", "x")
    rec = TR.bagged_reconstructor(w, "vec_id", "x", T, D, k=8, members=3)
    member = F.explode(F.array(*[F.lit(m) for m in range(3)])).alias("member")
    drawn = w.select("vec_id", member).groupBy("member").agg(
        F.sum(TR.bootstrap_weight(F.col("vec_id"), F.col("member")).cast("bigint")).alias("drawn"))
    means = spark.createDataFrame([(m, i, float(v)) for m, mean in enumerate(rec.mean) for i, v in enumerate(mean)], "member int, pos int, mean double")
    return means.join(drawn, "member").select("member", "pos", r6("mean").alias("mean"), "drawn")


@query("train_classifier")
def train_classifier(spark, sf):
    """Pattern classifier, cross-validated; hold-out metrics per candidate table."""
    v = vectors(spark, sf).select("vec_id", F.concat(F.lit("class"), F.col("label").cast("string")).alias("label"), "x")
    _, scored, cv = TR.train_classifier(v, "vec_id", "label", "x")
    scored = scored.withColumn("pl", F.get("probs", F.col("y")))
    best = TR.best_candidate(cv, "reg", "avg_f1").first()
    rep = EV.classification_report(scored, "y", "pattern_index", "pl")
    return round_doubles(rep.withColumns({"reg": F.lit(best["reg"]), "avg_f1": F.lit(best["avg_f1"])}))


@query("reconstructor_full_rank", """SELECT vec_id, CASE WHEN CAST('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 >= 1000 THEN 'train' ELSE 'test' END AS part,
 0.0e0 AS mse, 0.0e0 AS threshold_p99 FROM embeddings""")
def reconstructor_full_rank(spark, sf):
    """With as many components as cells nothing is lost; the model is stored and loaded before it scores."""
    w = reconstructed(spark, sf).select("vec_id", "x")
    rec, errors, cal = TR.train_reconstructor(w, "vec_id", "x", T, D, k=T * D)
    path = fresh_path(spark, "bundle")
    catalog = P.catalog(spark, [f"f{i}" for i in range(D)])
    TR.Bundle(rec, catalog, cal, {"steps": str(T)}).save(path)
    b = TR.Bundle.load(spark, path, TR.Reconstructor)
    again = b.model.apply(w).select("vec_id", error_train(F.col("x"), squared_errors(F.col("x"), F.col("xh"))).alias("mse"))
    return errors.select("vec_id", "part").join(again, "vec_id").select(
        "vec_id", "part", r6("mse").alias("mse"), r6(F.lit(b.threshold.first()["threshold_p99"])).alias("threshold_p99"))


@query("classifier_separable", """SELECT vec_id, 'class' || CAST(label AS VARCHAR) AS label, true AS correct FROM embeddings
 WHERE CAST('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR) || '|class' || CAST(label AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0""")
def classifier_separable(spark, sf):
    """A classifier whose vectors hold their class: the held-out fifth, by a hash of id and class, is all correct."""
    v = vectors(spark, sf)
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when(c == F.col("label"), 5.0).otherwise(0.0))
    v = v.withColumn("x", F.concat("x", own))
    rows = v.withColumn("label", F.concat(F.lit("class"), F.col("label").cast("string"))).select("vec_id", "label", "x")
    _, scored, _ = TR.train_classifier(rows, "vec_id", "label", "x")
    return scored.select("vec_id", "label", (F.col("y") == F.col("pattern_index")).alias("correct"))


_SERVE_FEATURES = ["protocol", "delta_t", "len_norm", "dir_code", "sp_norm", "modbus_fc_norm", "xgt_data_mean_byte", "dns_qc_norm"]


def _serving_inputs(spark, sf):
    cols = ["seq", "capture", "protocol", "timestamp", "dir", "sip", "smac", "dip", "dmac", "sp", "dp", "len", "sq", "delta_t", "match",
            "src_asset", "dst_asset", "modbus_fc", "xgt_fen_data", "xgt_fen_vars", "xgt_fen_cmd", "dns_qc", "dns_ac", "k"]
    p = packets(spark, sf, *cols)
    return p, OFF.fit_and_save(p, fresh_path(spark, "fitted"))


@query("serving_run")
def serving_run(spark, sf):
    """Merge, featurise, window, reconstruct and judge a capture, the reconstructor fitted on its own windows."""
    p, fitted = _serving_inputs(spark, sf)
    t = event_track(p)
    cells = SV.merged_cells(p, t, "seq", fitted, _SERVE_FEATURES)   # the same for the fit and the verdicts
    w = SV.cell_windows(cells, "capture", 16, 16)
    rec, _, cal = TR.train_reconstructor(w.withColumn("id", F.concat_ws("-", "capture", "window_id")), "id", "x", 16, len(_SERVE_FEATURES), k=6)
    v = SV.serve(p, t, "seq", fitted, _SERVE_FEATURES, lambda d: rec.apply(d), size=16, step=4, threshold=cal.first()["threshold_p99"], cells=cells)
    s = F.col("summary")
    return v.select("capture", "seq_id", "start", "end", "pattern", r6(s["anomaly_score"]).alias("anomaly_score"),
                    s["anomaly_type"].alias("anomaly_type"), s["risk"]["score"].alias("risk"), s["risk"]["src_ip"].alias("src_ip"),
                    F.size(s["feature_error"]).alias("n_features"), "alert")


@query("serving_patterns")
def serving_patterns(spark, sf):
    """Pattern classes of the anomalous windows only, from a classifier stored in a folder and loaded again."""
    p, fitted = _serving_inputs(spark, sf)
    t, width = event_track(p), len(_SERVE_FEATURES)
    labelled = SV.labelled_windows(p, t, fitted, _SERVE_FEATURES, F.lit("modbus_fc6"), 16, 16)
    rows = labelled.select(F.concat_ws("-", "capture", "window_id").alias("id"), "pattern", TR.pooled(compact(F.col("x"), 16), width).alias("v"), "x")
    pipe, _, _ = TR.train_classifier(rows, "id", "pattern", "v")
    rec, _, cal = TR.train_reconstructor(rows.where(F.size("x") == 16), "id", "x", 16, width, k=6)
    path = fresh_path(spark, "bundle")
    TR.Bundle(pipe, P.catalog(spark, _SERVE_FEATURES), cal, {"steps": "16"}).save(path)
    b = TR.Bundle.load(spark, path)
    v = SV.serve(p, t, "seq", fitted, _SERVE_FEATURES, lambda d: rec.apply(d), TR.classify_with(b, width), TR.class_names(b), size=16, step=4,
                 threshold=b.threshold.first()["threshold_p99"], always_classify=False)
    s = F.col("summary")
    return v.select("capture", "seq_id", "pattern", r6(s["anomaly_score"]).alias("anomaly_score"), s["anomaly_type"].alias("anomaly_type"),
                    r6(s["similarity"]).alias("similarity"), "alert")


_OWN = {"modbus": MODBUS_FEATURES, "dns": DNS_FEATURES, "arp": ARP_FEATURES, "s7comm": S7COMM_FEATURES}
_MATRIX = {q: [f for f in features if f in _FIT_FEATURES] for q, features in _OWN.items()}


@query("fit_matrices", f"""WITH {_PARSED}, {_HOSTS}, {_ARPS}, {_VARS},
lists AS (SELECT seq AS lseq, list_transform(CAST(xgt_fen_translated_addr AS JSON)::VARCHAR[], lambda s: CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)) AS xa,
 CAST(xgt_fen_word_value AS JSON)::DOUBLE[] AS xw FROM pkt),
rows AS (SELECT protocol AS owner, {', '.join(f'CAST({_FIT_FEATURES[f]} AS FLOAT) AS {f}' for fs in _MATRIX.values() for f in fs)}
{_FEATURE_FROM} LEFT JOIN vars vv ON vv.name = {_FIRST_VAR} JOIN lists ON lseq = seq)
{' UNION ALL '.join(f"SELECT '{q}' AS proto, {i} AS pos, '{f}' AS name, count(*) AS n, {sql_r6(f'sum(CAST({f} AS DOUBLE))')} AS total FROM rows WHERE owner = '{q}'" for q, fs in _MATRIX.items() for i, f in enumerate(fs))}""")
def fit_matrices(spark, sf):
    """Typed matrices per protocol of the fit-time rows, stored, and read back one protocol at a time."""
    p, fitted = _fitted(spark, sf)
    rows = X.featurise_fit(p.withColumn("owner", F.col("protocol")), fitted, ["seq", "owner"])
    path, out = fresh_path(spark, "matrices"), None
    K.save_matrices(rows, "owner", _MATRIX, path, "seq")
    for q in _MATRIX:
        m, names = K.load_matrix(spark, path, q)
        cells = m.select(F.posexplode("cells").alias("pos", "v")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("v").cast("double"))).alias("total"))
        named = cells.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)).withColumn("proto", F.lit(q))
        out = named if out is None else out.unionByName(named)
    return out


@query("labelled_capture", f"""WITH {pkt_sql('seq', 'capture', 'protocol', 'modbus_fc', 'xgt_fen_cmd', 'k')},
o AS (SELECT *, (protocol = 'xgt_fen' AND CAST(xgt_fen_cmd AS BIGINT) IN (88, 89)) OR (protocol = 'modbus' AND CAST(modbus_fc AS BIGINT) = 6) AS flag,
 row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i FROM pkt), w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 7) / 4.0)) AS BIGINT), i // 4 + 1)) AS window_id FROM o)
SELECT capture, window_id, count(*) AS n, CAST(count(*) AS INT) AS steps, CAST(bool_or(flag) AS INT) AS y_true, CASE WHEN bool_or(flag) THEN 'ATTACK' ELSE 'NORMAL' END AS pattern FROM w GROUP BY capture, window_id""")
def labelled_capture(spark, sf):
    """Feature windows of a labelled capture with their truth."""
    p, fitted = _serving_inputs(spark, sf)
    w = SV.labelled_windows(p, event_track(p), fitted, _SERVE_FEATURES, F.lit("modbus_fc6"), 8, 4)
    return w.select("capture", "window_id", "n", F.size("x").alias("steps"), "y_true", "pattern")
