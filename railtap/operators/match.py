"""Matching labelled event lines to raw packets and patterns to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.operators.order import Track, occurrence

# Patterns of the match fields in a text line.
_TS = r'@timestamp\s*[:=]\s*"?([0-9T:\.\-Z\+]+)"?'
_FIELD = r'\b{}\s*[:=]\s*"?([^",>\s]+)"?'
_QUOTED_TS = r'timestamp="([\w\-\:\.TZ\+]+)"'

MATCH_KEYS = ("ts", "sq", "ak", "fl")


def _found(line: Column, pattern: str) -> Column:
    v = F.regexp_extract(line, pattern, 1)
    return F.when(v != "", v)


def line_fields(line: Column) -> Column:
    """``struct<ts,sq,ak,fl>`` of a text or JSON-object line; a null struct when one is missing."""
    is_obj = F.trim(line).startswith("{")

    def obj(name: str) -> Column:
        return F.get_json_object(line, f"$['{name}']")

    ts = F.when(is_obj, F.coalesce(F.nullif(obj("@timestamp"), F.lit("")), F.nullif(obj("timestamp"), F.lit(""))))
    ts = ts.otherwise(_found(line, _TS))
    rest = {f: F.when(is_obj, obj(f)).otherwise(_found(line, _FIELD.format(f))) for f in ("sq", "ak", "fl")}
    complete = ts.isNotNull()
    for c in rest.values():
        complete = complete & c.isNotNull()
    return F.when(complete, F.struct(ts.alias("ts"), *[c.alias(f) for f, c in rest.items()]))


def quoted_timestamp(line: Column) -> Column:
    """The ``timestamp="…"`` value of a line."""
    return _found(line, _QUOTED_TS)


def has_all(*columns: str) -> Column:
    """None of the columns is null or empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return out


def missing_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of (field, reason) over required fields, zero counts left out; one pass, one row before unpivoting."""
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f"{f}|null") for f in fields],
                    *[F.count_if(F.col(f) == "").alias(f"{f}|empty") for f in fields])
    long = counts.unpivot([], list(counts.columns), "_k", "n")
    part = F.split("_k", r"\|")
    return long.where("n > 0").select(part[0].alias("field"), part[1].alias("reason"), "n")


def protocol_in(protocol: Column, names: list[str]) -> Column:
    """Protocol subset; choosing XGT takes both spellings."""
    wanted = set(names)
    if wanted & {"xgt_fen", "xgt-fen"}:
        wanted |= {"xgt_fen", "xgt-fen"}
    return protocol.isin(*sorted(wanted))


# --- one-to-one by arrival -------------------------------------------------

def number_sides(lines: DataFrame, raw: DataFrame, keys, lines_track: Track, raw_track: Track,
                 fraction: float = 0.01):
    """Both sides with complete keys and the occurrence number of each key value."""
    left = occurrence(lines.where(has_all(*keys)), lines_track, keys, "_nth", fraction)
    right = occurrence(raw.where(has_all(*keys)), raw_track, keys, "_nth", fraction)
    return left, right


def match_fifo(lines: DataFrame, raw: DataFrame, keys, lines_track: Track, raw_track: Track,
               how: str = "inner", fraction: float = 0.01) -> DataFrame:
    """Line-to-packet match where the n-th line with a key takes the n-th packet with it.

    A packet is used at most once.  ``how="left"`` keeps unmatched lines.  The
    join key includes the occurrence number, so a key shared by a large part of
    the rows is spread over its occurrences.  ``fraction`` is the sample hot
    keys are looked for in.
    """
    left, right = number_sides(lines, raw, keys, lines_track, raw_track, fraction)
    right = right.withColumn("match", F.lit("O"))
    return left.join(right, [*keys, "_nth"], how).drop("_nth")


def fifo_coverage(lines: DataFrame, raw: DataFrame, keys, window: str, lines_track: Track,
                  raw_track: Track) -> DataFrame:
    """Totals of a FIFO match: lines, lines without fields, misses, matched lines, windows and matched windows."""
    hit = match_fifo(lines, raw.select(*keys, *raw_track.order), keys, lines_track, raw_track, "left")
    per = hit.groupBy(window).agg(F.count(F.lit(1)).alias("_lines"), F.count("match").alias("_hits"))
    base = lines.groupBy(window).agg(F.count(F.lit(1)).alias("_all"))
    j = base.join(per, window, "left")
    lines_n, keyed, hits = F.sum("_all"), F.coalesce(F.sum("_lines"), F.lit(0)), F.coalesce(F.sum("_hits"), F.lit(0))
    return j.agg(lines_n.alias("lines"), (lines_n - keyed).alias("no_fields"), (keyed - hits).alias("missed"),
                 hits.alias("matched"), F.count(F.lit(1)).alias("windows"),
                 F.count_if(F.col("_hits") > 0).alias("matched_windows"))


# --- whole windows or nothing ----------------------------------------------

def match_whole(lines: DataFrame, raw: DataFrame, key: str, window: str, raw_order: str) -> DataFrame:
    """Line-to-packet match that keeps a window only if every keyed line matched.

    Of packets sharing a key the last one counts; lines without a key are
    ignored, windows with no keyed line are dropped.
    """
    rest = [c for c in raw.columns if c not in (key,)]
    latest = raw.where(has_all(key)).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(raw_order)).alias("_p"))
    joined = lines.where(has_all(key)).join(latest, key, "left")
    complete = joined.groupBy(window).agg(F.count(F.lit(1)).alias("_n"), F.count("_p").alias("_m")) \
                     .where("_n = _m").select(window)
    return (joined.join(complete, window, "left_semi")
            .select(*lines.columns, *[F.col("_p")[c].alias(c) for c in rest], F.lit("O").alias("match")))


def whole_coverage(lines: DataFrame, raw: DataFrame, key: str, window: str) -> DataFrame:
    """Windows fully matched and dropped under :func:`match_whole`."""
    known = raw.where(has_all(key)).select(key).distinct().withColumn("_m", F.lit(1))
    # lines without a key are counted with their windows only: in a join they would meet in one task
    keyed = (lines.where(has_all(key)).select(window, key).join(known, key, "left").groupBy(window)
             .agg(F.count(F.lit(1)).alias("_n"), F.count("_m").alias("_k")))
    per = lines.select(window).distinct().join(keyed, window, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("_n", "_k")})
    full = (F.col("_n") > 0) & (F.col("_n") == F.col("_k"))
    return per.agg(F.count(F.lit(1)).alias("windows"), F.count_if(full).alias("full"),
                   F.count_if(~full).alias("dropped"))


# --- pattern positions -----------------------------------------------------

def pattern_positions(patterns: DataFrame, windows: DataFrame, keys, window: str, pattern: str,
                      line: str, pos: str) -> DataFrame:
    """Position in its window of every pattern line; the k-th use of a key takes its k-th place.

    Patterns with an unkeyed or unmatched line are dropped whole.  Groups here
    are the rows of one pattern or one window sharing a key, never more than
    the window length.
    """
    nth_line = F.row_number().over(W.partitionBy(pattern, *keys).orderBy(line))
    nth_pos = F.row_number().over(W.partitionBy(window, *keys).orderBy(pos))
    left = patterns.withColumn("_nth", F.when(has_all(*keys), nth_line))
    right = windows.where(has_all(*keys)).select(window, *keys, pos).withColumn("_nth", nth_pos)
    joined = left.join(right, [window, *keys, "_nth"], "left")
    complete = joined.groupBy(pattern).agg(F.count(F.lit(1)).alias("_n"), F.count(pos).alias("_m")) \
                     .where("_n = _m").select(pattern)
    return joined.join(complete, pattern, "left_semi").drop("_nth")


def position_array(positions: DataFrame, pattern: str, line: str, pos: str) -> DataFrame:
    """The ordered position list of every pattern."""
    ordered = F.array_sort(F.collect_list(F.struct(line, pos)))
    return positions.groupBy(pattern).agg(F.transform(ordered, lambda s: s[pos]).alias("index"))


def skip_reasons(patterns: DataFrame, windows: DataFrame, keys, window: str, pattern: str, line: str,
                 pos: str, label: str) -> DataFrame:
    """Why patterns were left out: noise label, no window id, unknown window, unmatched; and how many were written."""
    is_noise = F.coalesce(F.lower(F.trim(label)) == "noise", F.lit(False))
    known = windows.select(window).distinct().withColumn("_known", F.lit(1))
    done = pattern_positions(patterns.where(~is_noise), windows, keys, window, pattern, line, pos) \
        .select(pattern).distinct().withColumn("_done", F.lit(1))
    heads = patterns.groupBy(pattern).agg(
        F.min_by(window, F.struct(F.col(window).isNull(), F.col(line), F.col(window))).alias(window), F.bool_or(is_noise).alias("_noise"))
    named = heads.where(F.col(window).isNotNull()).join(known, window, "left")
    heads = named.unionByName(heads.where(F.col(window).isNull()).withColumn("_known", F.lit(None).cast("int"))).join(done, pattern, "left")
    reason = (F.when(F.col("_noise"), "noise").when(F.col(window).isNull(), "no_window_id")
              .when(F.col("_known").isNull(), "unknown_window").when(F.col("_done").isNull(), "unmatched")
              .otherwise("written"))
    return heads.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
