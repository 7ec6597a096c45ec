"""Scoring queries over embedding vectors taken as 8 x 8 windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtap.functions import risk as R
from railtap.functions import scalars as S
from railtap.operators import evaluate as EV
from railtap.operators import score as SC
from railtap.operators import verdict as V
from railtap.operators import windows as WIN
from railtap.operators import order as O
from suite.base import event_track, packets, pkt_sql, query, r6, round_doubles, sql_r6, table
from suite.packets import SQL_IMPACT

T = D = 8
NAMES = [f"f{i}" for i in range(64)]
# Weights of the eight features in the weighted errors: 1, 1.5, 2, ...
WEIGHTS = [1.0 + 0.5 * i for i in range(D)]


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def centroids(v):
    """Mean vector per label: one row per label, joined back by Spark's own choice of strategy."""
    cells = v.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    return cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))),
                                                  lambda s: s["v"]).alias("c"))


def _grid(a):
    return F.transform(F.sequence(F.lit(0), F.lit(T - 1)), lambda i: F.slice(a, i * D + 1, F.lit(D)))


def reconstructed(spark, sf):
    """Windows with their reconstruction (the label's centroid) and padding cells on both sides."""
    v = vectors(spark, sf)
    j = v.join(centroids(v), "label")
    pad = lambda a: F.zip_with("x", a, lambda x, y: F.when(x < -0.3, -1.0).otherwise(y))
    j = j.select("vec_id", "label", pad(F.col("x")).alias("px"), pad(F.col("c")).alias("pc"))
    return j.select("vec_id", "label", _grid(F.col("px")).alias("x"), _grid(F.col("pc")).alias("xh"))


_CELLS = f"""v AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(list_transform(embedding, lambda a: CAST(a AS DOUBLE))) AS x FROM embeddings),
c AS (SELECT label, pos, avg(x) AS c FROM v GROUP BY label, pos),
m AS (SELECT vec_id, v.label, pos, pos // 8 AS t, pos % 8 AS d, CASE WHEN x < -0.3 THEN -1.0 ELSE x END AS x, CASE WHEN x < -0.3 THEN -1.0 ELSE c END AS xh FROM v JOIN c USING (label, pos)),
e AS (SELECT *, (xh - x) * (xh - x) AS se, (xh - x) * (xh - x) * (1.0 + 0.5 * d) AS wse FROM m),
s AS (SELECT vec_id, t, avg(se) AS se, avg(wse) AS wse, bool_or(x <> -1.0) AS live, bool_or(x <> -1.0 AND x <> -2.0) AS live2 FROM e GROUP BY vec_id, t)"""


@query("recon_error_train", f"""WITH {_CELLS} SELECT vec_id, {sql_r6('coalesce(sum(wse) FILTER (x <> -1.0), 0) / (count(*) FILTER (x <> -1.0) + 1e-8)')} AS mse FROM e GROUP BY vec_id""")
def recon_error_train(spark, sf):
    """Training error: weighted mean over real cells."""
    r = reconstructed(spark, sf)
    return r.select("vec_id", r6(SC.error_train(F.col("x"), SC.squared_errors(F.col("x"), F.col("xh"), WEIGHTS))).alias("mse"))


@query("recon_error_eval", f"""WITH {_CELLS} SELECT vec_id, {sql_r6('coalesce(sum(wse) FILTER (live), 0) / (count(*) FILTER (live) + 1e-8)')} AS mse FROM s GROUP BY vec_id""")
def recon_error_eval(spark, sf):
    """Evaluation error: mean step error over steps with a real cell."""
    r = reconstructed(spark, sf)
    return r.select("vec_id", r6(SC.error_eval(F.col("x"), SC.squared_errors(F.col("x"), F.col("xh"), WEIGHTS))).alias("mse"))


@query("recon_error_serve", f"""WITH {_CELLS}, a AS (SELECT vec_id, {sql_r6('coalesce(sum(se) FILTER (live2), 0) / (count(*) FILTER (live2) + 1e-8)')} AS mse,
 {sql_r6('max(se)')} AS temporal_error_max FROM s GROUP BY vec_id) SELECT *, CASE WHEN mse > 0.012 THEN 1 ELSE 0 END AS is_anomaly_pred FROM a""")
def recon_error_serve(spark, sf):
    """Serving error, worst step and verdict."""
    r = reconstructed(spark, sf).withColumn("se", SC.squared_errors(F.col("x"), F.col("xh")))
    r = r.select("vec_id", r6(SC.error_serve(F.col("x"), F.col("se"))).alias("mse"),
                 r6(SC.temporal_error_max(F.col("se"))).alias("temporal_error_max"))
    return r.withColumn("is_anomaly_pred", SC.anomaly_prediction(F.col("mse"), 0.012))


@query("feature_error_topk", f"""WITH {_CELLS}, f AS (SELECT vec_id, d, avg(se) AS err FROM e GROUP BY vec_id, d),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err DESC, d) AS rk FROM f)
SELECT vec_id, 'f' || d AS feature, {sql_r6('err')} AS err FROM k WHERE rk <= 7""")
def feature_error_topk(spark, sf):
    """The seven features reconstructed worst."""
    r = reconstructed(spark, sf).withColumn("se", SC.squared_errors(F.col("x"), F.col("xh")))
    top = r.select("vec_id", F.explode(SC.top_feature_errors(F.col("se"), NAMES[:D])).alias("feature", "err"))
    return round_doubles(top)


@query("contribution_topk", f"""WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(list_transform(embedding, lambda a: CAST(a AS DOUBLE))) AS x FROM embeddings),
z AS (SELECT vec_id, pos, abs((x - 0.01 * pos) / (CASE WHEN pos % 5 = 0 THEN 1.0 ELSE 0.1 * (pos % 5) END)) AS a FROM v),
p AS (SELECT *, a * 100.0 / (sum(a) OVER (PARTITION BY vec_id) + 1e-12) AS pct, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, pos) AS rk FROM z)
SELECT vec_id, CAST(rk - 1 AS INT) AS place, 'f' || pos AS name, floor(pct * 100 + 0.5) / 100 AS percent FROM p WHERE rk <= 3 AND pct > 0""")
def contribution_topk(spark, sf):
    """The three features that weigh most in a scaled vector."""
    v = vectors(spark, sf)
    wide = v.select("vec_id", *[F.get("x", i).alias(n) for i, n in enumerate(NAMES)])
    x = SC.standardise(SC.feature_vector(NAMES), [0.01 * i for i in range(64)], [0.1 * (i % 5) for i in range(64)])
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = wide.withColumn("z", x).select("vec_id", F.posexplode(SC.contributions(F.col("z"), names, 3)).alias("place", "c"))
    return rows.select("vec_id", "place", "c.name", "c.percent")


@query("feature_vector_sources", """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN coalesce(value, 0) ELSE 0.5 END AS a,
 CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS b, (CASE WHEN event_id % 3 = 0 THEN coalesce(value, 0) ELSE 0.5 END) * 2.0 + 1.0 AS scaled_a FROM events""")
def feature_vector_sources(spark, sf):
    """Selected features from the feature map or, without one, from the packet; min-max scaled."""
    ev = table(spark, sf, "events")
    feats = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.col("value").cast("string")))
    origin = F.create_map(F.lit("b"), F.get_json_object("props", "$.k"), F.lit("a"), F.lit("0.5"))
    rows = ev.select(F.col("event_id").alias("seq"), feats.alias("features"), origin.alias("origin"))
    x = SC.feature_vector(["a", "b"], sources=["features", "origin"])
    rows = rows.withColumn("x", x).withColumn("z", SC.minmax_scale(F.col("x"), [2.0, 1.0], [1.0, 0.0]))
    return rows.select("seq", F.get("x", 0).alias("a"), F.get("x", 1).alias("b"), F.get("z", 0).alias("scaled_a"))


_ERR = f"{_CELLS}, w AS (SELECT vec_id, coalesce(sum(se) FILTER (x <> -1.0), 0) / (count(*) FILTER (x <> -1.0) + 1e-8) AS mse FROM e GROUP BY vec_id)"
_CAL = f"{_ERR}, cal AS (SELECT quantile_cont(mse, 0.99) AS p99, avg(mse) + 3 * stddev_pop(mse) AS mu3, avg(mse) AS mean, stddev_pop(mse) AS std, min(mse) AS lo, max(mse) AS hi FROM w)"


def _errors(spark, sf):
    r = reconstructed(spark, sf)
    return r.select("vec_id", SC.error_train(F.col("x"), SC.squared_errors(F.col("x"), F.col("xh"))).alias("mse"))


@query("threshold_calibration", f"""WITH {_CAL} SELECT {sql_r6('p99')} AS threshold_p99, {sql_r6('mu3')} AS threshold_mu3, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std,
 {sql_r6('lo')} AS "min", {sql_r6('hi')} AS "max" FROM cal""")
def threshold_calibration(spark, sf):
    """Threshold candidates from training errors."""
    return round_doubles(SC.calibrate(_errors(spark, sf), "mse"))


@query("threshold_adjust", f"""WITH {_CAL}, k AS (SELECT unnest([0.5, 1.0, 9.0])::DOUBLE AS k)
SELECT k, {sql_r6('mean - k * std')} AS tau, {sql_r6('least(greatest(mean - k * std, lo), hi)')} AS tau_clip, {sql_r6('p99')} AS picked FROM cal, k""")
def threshold_adjust(spark, sf):
    """Thresholds lowered by k deviations, clipped to what was seen."""
    cal = SC.calibrate(_errors(spark, sf), "mse")
    picked = SC.pick_threshold(F.lit(None).cast("double"), F.col("threshold_p99"), F.col("threshold_mu3"))
    out = SC.adjust_thresholds(cal.withColumn("picked", picked), [0.5, 1.0, 9.0])
    return round_doubles(out.select("k", "tau", "tau_clip", "picked"), "k")


# --- packet verdicts ---------------------------------------------------------------

_MARGIN = "(k - 45.0) / 10.0 + value / 25.0"
_VERDICT = f"""{pkt_sql('seq', 'sip', 'dip', 'value', 'k', 'capture')}, z AS (SELECT *, {_MARGIN} AS z FROM pkt),
a AS (SELECT *, 1.0 - 1.0 / (1.0 + exp(-least(greatest(z, -20.0), 20.0))) AS p FROM z)"""


def _margins(spark, sf):
    p = packets(spark, sf, "seq", "sip", "dip", "value", "k", "capture")
    return p.withColumn("z", F.expr(_MARGIN))


@query("packet_verdict", f"""WITH {_VERDICT} SELECT seq, {sql_r6('p')} AS score, CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS by_probability,
 CASE WHEN z >= -1.26 THEN 1 ELSE 0 END AS by_margin, CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END AS by_label,
 CASE WHEN z >= 3.0 THEN 0 ELSE 1 END AS offline FROM a""")
def packet_verdict(spark, sf):
    """Anomaly probability of a linear margin and the ways to decide from it."""
    z = F.col("z")
    p = _margins(spark, sf).withColumn("p", SC.anomaly_probability(margin=z))
    return p.select("seq", r6("p").alias("score"), SC.match_decision(F.col("p"), 0.5).alias("by_probability"),
                    SC.match_decision(F.col("p"), -1.26, margin=z).alias("by_margin"),
                    SC.match_decision(F.col("p"), 0.5, label=F.col("k") % 2).alias("by_label"),
                    SC.offline_match(z, 3.0).alias("offline"))


@query("hash_fallback", f"""WITH {_VERDICT} SELECT seq, CASE WHEN p < 0.5 THEN 'O' WHEN sip <> '' AND dip <> ''
 AND CAST('0x' || substr(md5(sip || '-' || dip), 1, 8) AS BIGINT) % 100 < 5 THEN 'O' ELSE 'X' END AS mark FROM a""")
def hash_fallback(spark, sf):
    """Match marks with the address-pair fallback."""
    p = _margins(spark, sf)
    m = SC.match_decision(SC.anomaly_probability(margin=F.col("z")), 0.5)
    return p.select("seq", SC.match_mark(m, F.col("sip"), F.col("dip"), True).alias("mark"))


@query("verdict_tally", f"""WITH {_VERDICT} SELECT count(DISTINCT seq // 80) AS windows, count(*) AS rows, count(*) FILTER (k % 7 > 0 AND z >= 3.0) AS match0,
 count(*) FILTER (k % 7 > 0 AND z < 3.0) AS match1, count(*) FILTER (k % 7 = 0) AS match_none FROM a""")
def verdict_tally(spark, sf):
    """Totals of batch verdicts."""
    p = _margins(spark, sf).withColumn("m", SC.offline_match(F.when(F.col("k") % 7 > 0, F.col("z")), 3.0))
    return SC.verdict_tally(p.withColumn("w", F.floor(F.col("seq") / 80)), "m", "w")


_PROBS = """v AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(list_transform(embedding, lambda a: CAST(a AS DOUBLE))) AS x FROM embeddings),
c AS (SELECT label AS cls, pos, avg(x) AS c FROM v GROUP BY label, pos),
d AS (SELECT vec_id, label, cls, -4.0 * sum((x - c) * (x - c)) AS l FROM v JOIN c USING (pos) GROUP BY vec_id, label, cls),
q AS (SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM d)"""


def class_probs(spark, sf):
    """Class probabilities: softmax of the negative squared distance to every centroid.

    The centroids are the classifier's parameters, one vector per class, and
    enter the plan as literals.
    """
    v = vectors(spark, sf)
    cs = centroids(v).orderBy("label").collect()
    j = v.withColumn("cs", F.array(*[F.array(*[F.lit(float(a)) for a in r["c"]]) for r in cs]))
    dist = F.transform("cs", lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))
    j = j.select("vec_id", "label", dist.alias("dist")).withColumn("near", F.array_min("dist"))
    # from the nearest on: at least one term is 1, so the sum is never 0
    ex = F.transform("dist", lambda d: F.exp(-4.0 * (d - F.col("near"))))
    total = F.aggregate("ex", F.lit(0.0), lambda s, e: s + e)
    return j.select("vec_id", "label", ex.alias("ex")).select(
        "vec_id", "label", F.transform("ex", lambda e: e / total).alias("probs"))


@query("class_entropy", f"""WITH {_PROBS}, a AS (SELECT vec_id, -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS ent, max(p) AS top, arg_max(cls, p) AS best, count(*) AS n FROM q GROUP BY vec_id)
SELECT vec_id, CAST(best AS INT) AS pattern_index, {sql_r6('top')} AS pattern_prob, {sql_r6('top * 100')} AS similarity, {sql_r6('ent')} AS probs_entropy, CAST(n AS INT) AS num_classes,
 {sql_r6('-ln(greatest(top, 1e-12))')} AS latent_distance FROM a""")
def class_entropy(spark, sf):
    """Top class, confidence and entropy of class probabilities."""
    p = class_probs(spark, sf)
    return round_doubles(p.select("vec_id", *[e.alias(n) for n, e in R.class_summary(F.col("probs")).items()]))


@query("classification_report", f"""WITH {_PROBS}, a AS (SELECT vec_id, any_value(label) AS label, arg_max(cls, p) AS pred, max(p) FILTER (cls = label) AS pl FROM q GROUP BY vec_id),
t AS (SELECT label AS c, count(*) AS support, count(*) FILTER (pred = label) AS hit FROM a GROUP BY 1), k AS (SELECT pred AS c, count(*) AS called FROM a GROUP BY 1),
r AS (SELECT support, hit, coalesce(called, 0) AS called, CASE WHEN hit + 0 = 0 THEN 0.0 ELSE 2.0 * hit / (support + coalesce(called, 0)) END AS f1 FROM t LEFT JOIN k USING (c))
SELECT {sql_r6('sum(hit) / sum(support)')} AS accuracy, {sql_r6('sum(f1 * support) / sum(support)')} AS weighted_f1, {sql_r6('sum(hit / support * support) / sum(support)')} AS weighted_recall,
 (SELECT {sql_r6('-avg(ln(greatest(pl, 1e-12)))')} FROM a) AS mean_loss, CAST(sum(support) AS BIGINT) AS n FROM r""")
def classification_report(spark, sf):
    """Accuracy, weighted scores and loss of a nearest-centroid classifier."""
    p = class_probs(spark, sf)
    p = p.select("label", R.class_summary(F.col("probs"))["pattern_index"].alias("pred"), F.get("probs", F.col("label")).alias("pl"))
    return round_doubles(EV.classification_report(p, "label", "pred", "pl"))


@query("multiclass_roc", f"""WITH {_PROBS}, o AS (SELECT vec_id, cls, p, label = cls AS hit FROM q),
r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS rk, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mrk FROM o),
per AS (SELECT cls, count(*) FILTER (hit) AS support, (sum(rk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc FROM r GROUP BY cls),
mic AS (SELECT count(*) FILTER (hit) AS support, (sum(mrk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc FROM r)
SELECT 'micro' AS "scope", CAST(NULL AS INT) AS cls, {sql_r6('auc')} AS roc_auc, support FROM mic UNION ALL SELECT 'macro', NULL, {sql_r6('avg(auc)')}, NULL FROM per
UNION ALL (SELECT 'class', CAST(cls AS INT), {sql_r6('auc')}, support FROM per ORDER BY support DESC, cls LIMIT 5)""")
def multiclass_roc(spark, sf):
    """Micro, macro and largest-class AUC."""
    return round_doubles(EV.multiclass_auc(class_probs(spark, sf), "label", "probs", "vec_id", 5))


# --- risk ------------------------------------------------------------------------

_RISK = f"""{pkt_sql('seq', 'capture', 'protocol', 'value', 'timestamp', 'sip', 'dip', 'src_asset', 'dst_asset', 'k')},
o AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS i FROM pkt),
w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 19) / 20.0)) AS BIGINT), i // 20 + 1)) AS window_id FROM o),
g AS (SELECT capture, window_id, avg(value) / 20.0 AS mse, max(value) / 10.0 AS tmax, avg(k) / 99.0 AS p, min(k) / 25.0 AS ent, last(protocol ORDER BY i) AS protocol,
 last(src_asset ORDER BY i) AS src_any, max_by({{'s': src_asset, 'd': dst_asset, 'si': sip, 'di': dip, 't': "timestamp"}}, i) AS l FROM w GROUP BY capture, window_id HAVING count(*) = 20),
h AS (SELECT capture, window_id, {sql_r6('mse')} AS mse, {sql_r6('tmax')} AS tmax, CASE WHEN window_id % 4 > 0 THEN {sql_r6('p')} END AS p, CASE WHEN window_id % 4 > 0 THEN {sql_r6('ent')} END AS ent,
 protocol, l.s AS src_asset, l.d AS dst_asset, l.si AS sip, l.di AS dip, l.t AS ts FROM g),
x AS (SELECT *, mse > 0.9 AS bad, {SQL_IMPACT} AS impact, mse / 0.9 AS ratio FROM h),
y AS (SELECT *, least(greatest((1.0 / (1.0 + exp(-least(greatest((ratio - 1.0) * 6.0, -20.0), 20.0))) - 0.5) * 2.0, 0.0), 1.0) AS sev,
 least(greatest(log10(greatest(tmax, 0.0) + 1.0) / 6.0, 0.0), 1.0) AS tem, coalesce(least(greatest(1.0 - p, 0.0), 1.0), 0.0) AS sem,
 0.65 * (1.0 / (1.0 + exp(-least(greatest((ratio - 1.0) * 3.0, -20.0), 20.0)))) + 0.35 * coalesce(0.5 * p + 0.5 * (1.0 - least(greatest(ent / ln(10.0), 0.0), 1.0)), 0.5) AS conf FROM x),
z AS (SELECT *, 1.0 - (1.0 - sev) * (1.0 - 0.6 * tem) * (1.0 - 0.35 * sem) AS lik FROM y),
rk AS (SELECT *, CASE WHEN bad THEN floor(pow(1.0 - exp(-6.0 * impact * lik * conf), 0.85) * 10000.0 + 0.5) / 100.0 ELSE 0.0 END AS risk FROM z)"""


def _windows(spark, sf):
    p = packets(spark, sf, "seq", "capture", "protocol", "value", "timestamp", "sip", "dip", "src_asset", "dst_asset", "k")
    rows = O.with_ordinal(p, event_track(p), "i")
    last = F.struct("protocol", "timestamp", "sip", "dip", "src_asset", "dst_asset")
    w = WIN.sliding(rows, "capture", "i", 20, 20, {"mse": ("avg", F.col("value") / 20.0), "tmax": ("max", F.col("value") / 10.0),
                                                  "p": ("avg", F.col("k") / 99.0), "ent": ("min", F.col("k") / 25.0), "last": ("last", last)})
    w = round_doubles(w)
    anomaly = w.select("capture", "window_id", "mse", F.lit(0.9).alias("threshold"), F.col("tmax").alias("temporal_error_max"),
                       "last", SC.anomaly_prediction(F.col("mse"), 0.9).alias("is_anomaly_pred"))
    p1 = F.col("p")
    pattern = w.where(F.col("window_id") % 4 > 0).select(
        "capture", "window_id", F.concat(F.lit("c"), (F.col("window_id") % 3).cast("string")).alias("pattern"),
        p1.alias("pattern_prob"), F.col("ent").alias("probs_entropy"), F.lit(10).alias("num_classes"),
        (p1 * 100).alias("similarity"), (-F.log(S.clamp(p1, 1e-12, 1.0))).alias("latent_distance"))
    return anomaly, pattern


@query("risk_score", f"""WITH {_RISK} SELECT capture, window_id, mse, CASE WHEN bad THEN 'anomalous' ELSE 'normal' END AS anomaly_type, risk,
 CASE WHEN bad THEN floor(lik * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS likelihood, CASE WHEN bad THEN floor(conf * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS confidence, floor(impact * 1e4 + 0.5) / 1e4 AS impact FROM rk""")
def risk_score(spark, sf):
    """Risk of every window and its parts."""
    a, p = _windows(spark, sf)
    v = V.assess(V.merge_results(a, p, ["capture", "window_id"]), detail=True)
    s = F.col("summary")
    return v.select("capture", "window_id", "mse", s["anomaly_type"].alias("anomaly_type"), s["risk"]["score"].alias("risk"),
                    *[s["risk"][n].alias(n) for n in ("likelihood", "confidence", "impact")])


@query("verdict_normalised", f"""WITH {_RISK} SELECT capture, window_id, CASE WHEN window_id % 4 > 0 THEN 'c' || (window_id % 3) ELSE 'UNKNOWN' END AS pattern,
 risk AS risk_score, coalesce(nullif(ts, ''), '') AS detected_time, sip AS src_ip, dip AS dst_ip, src_asset, dst_asset, coalesce(p, 0.0) AS semantic_score, coalesce(ent, 0.0) AS similarity_entropy,
 {sql_r6('CASE WHEN p IS NULL THEN 0.0 ELSE -ln(greatest(p, 1e-12)) END')} AS latent_distance FROM rk""")
def verdict_normalised(spark, sf):
    """Verdicts with every gap filled."""
    a, p = _windows(spark, sf)
    v = V.normalise(V.assess(V.merge_results(a, p, ["capture", "window_id"])))
    s = F.col("summary")
    return v.select("capture", "window_id", "pattern", s["risk"]["score"].alias("risk_score"), s["risk"]["detected_time"].alias("detected_time"),
                    s["risk"]["src_ip"].alias("src_ip"), s["risk"]["dst_ip"].alias("dst_ip"), s["risk"]["src_asset"].alias("src_asset"),
                    s["risk"]["dst_asset"].alias("dst_asset"), s["semantic_score"].alias("semantic_score"),
                    s["similarity_entropy"].alias("similarity_entropy"), r6(s["latent_distance"]).alias("latent_distance"))


@query("alerts", f"""WITH {_RISK}, sel AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY window_id) AS seq_id FROM rk WHERE mse >= 0.9)
SELECT capture, seq_id, window_id, CASE WHEN bad AND window_id % 4 > 0 THEN 'c' || (window_id % 3) ELSE 'UNKNOWN' END AS pattern, CASE WHEN bad THEN floor(pow(1.0 - exp(-6.0 * impact *
 lik * conf), 0.85) * 10000.0 + 0.5) / 100.0 ELSE 0.0 END AS risk, 'dl' AS engine FROM sel""")
def alerts(spark, sf):
    """Alarm rows: alerting windows numbered per capture; patterns looked up only for anomalous ones."""
    a, p = _windows(spark, sf)
    wanted = p.join(V.needs_pattern(a).select("capture", "window_id"), ["capture", "window_id"], "left_semi")
    v = V.with_alert(V.normalise(V.assess(V.merge_results(a, wanted, ["capture", "window_id"], always=False))))
    hot = v.where("alert")
    t = O.track("capture", "window_id", 1 << 16)
    hot = O.with_ordinal(hot, t, "seq_id", start=1)
    pay = V.alarm_payload(hot.withColumn("pattern", F.concat_ws("|", F.col("capture").cast("string"), F.col("window_id").cast("string"), "pattern")))
    part = F.split("pattern", r"\|")
    return pay.select(part[0].cast("int").alias("capture"), "seq_id", part[1].cast("bigint").alias("window_id"), part[2].alias("pattern"),
                      F.col("risk.score").alias("risk"), "engine")


@query("alert_rule", """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN value >= 20.0 WHEN event_id % 3 = 1 THEN event_type IN ('click', 'view') ELSE value > 30 END OR event_id % 50 = 0 AS alert FROM events""")
def alert_rule(spark, sf):
    """The alert cascade, one branch per third of the rows, and the model's own alert."""
    ev = table(spark, sf, "events")
    i = F.col("event_id") % 3
    null = F.lit(None)
    score = F.when(i == 0, F.col("value"))
    word = F.when(i == 1, F.when(F.col("event_type").isin("click", "view"), " Attack").otherwise("normal"))
    risk = F.when((i == 2) & (F.col("value") > 30), 5.0)
    return ev.select(F.col("event_id").alias("seq"), R.alert(score, F.lit(20.0), word, risk, F.col("event_id") % 50 == 0).alias("alert"))


@query("window_filters", f"""WITH {_RISK} SELECT capture, window_id, {sql_r6('1.0 / (1.0 + exp(-least(greatest(mse * 10 - 9, -20.0), 20.0)))')} AS squashed, CASE WHEN mse > 0.9 THEN 1 ELSE 0 END AS pred, -1 AS pred_unknown
 FROM h WHERE window_id > 0""")
def window_filters(spark, sf):
    """Windows past the first, squashed score and verdict with and without a threshold."""
    a, _ = _windows(spark, sf)
    return a.where("window_id > 0").select("capture", "window_id", r6(S.sigmoid(F.col("mse") * 10 - 9)).alias("squashed"),
                                           SC.anomaly_prediction(F.col("mse"), 0.9).alias("pred"),
                                           SC.anomaly_prediction(F.col("mse"), None).alias("pred_unknown"))
