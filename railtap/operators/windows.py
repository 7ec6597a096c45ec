"""Count-based sliding windows and window tensors.

A window starts every ``step`` rows and covers ``size`` rows of its capture.
Rows are first folded into panes of ``gcd(size, step)`` rows; a window is then a
frame of consecutive panes.  The panes are the only thing shuffled a second
time, in blocks that borrow the panes their last windows reach into, so neither
a row nor a pane is copied once per window and no capture is bound to one task.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railtap.schema import MISSING, OUT_OF_RANGE

DEFAULT_BLOCK_PANES = 1 << 14

# how a per-pane partial is built and how partials combine over a frame
_FOLD = {
    "sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max),
    "any": (F.bool_or, F.bool_or), "all": (F.bool_and, F.bool_and),
}


def sliding(df: DataFrame, by, ordinal: str, size: int, step: int,
            aggs: dict[str, tuple[str, Column]], tail: str = "drop",
            block_panes: int = DEFAULT_BLOCK_PANES, max_windows: int | None = None) -> DataFrame:
    """One row per window: ``window_id, start, end, n`` and the requested aggregates.

    ``aggs`` maps a name to (kind, expression); kinds are sum, count, min, max,
    any, all, avg, first, last and rows (the ordered array).  ``tail`` says what
    becomes of windows the capture is too short for: drop, keep (every start
    inside the capture) or keep_last (only the first of them).  ``max_windows``
    stops after that many windows of a capture.
    """
    if step < 1 or step > size:
        raise ValueError("step must lie between 1 and size")
    if tail not in ("drop", "keep", "keep_last"):
        raise ValueError(f"unknown tail rule {tail!r}")
    by = (by,) if isinstance(by, str) else tuple(by)
    g = gcd(size, step)
    panes_per_window = size // g
    i = F.col(ordinal)

    pane_aggs, frame = [F.count(F.lit(1)).alias("_n")], {}
    for name, (kind, expr) in aggs.items():
        if kind == "avg":
            pane_aggs += [F.sum(expr).alias(f"_{name}_s"), F.count(expr).alias(f"_{name}_c")]
        elif kind == "first":
            pane_aggs.append(F.min_by(expr, i).alias(f"_{name}"))
        elif kind == "last":
            pane_aggs.append(F.max_by(expr, i).alias(f"_{name}"))
        elif kind == "rows":
            pane_aggs.append(F.array_sort(F.collect_list(F.struct(i.alias("i"), expr.alias("v"))))
                             .alias(f"_{name}"))
        else:
            pane_aggs.append(_FOLD[kind][0](expr).alias(f"_{name}"))
    source = df
    if max_windows is not None:
        source = df.where(i < max(0, max_windows - 1) * step + size)
    panes = source.groupBy(*by, F.floor(i / g).alias("_p")).agg(*pane_aggs)

    rows = max(block_panes, panes_per_window)
    home = F.floor(F.col("_p") / rows)
    reach = (F.col("_p") - home * rows < panes_per_window - 1) & (home > 0)
    panes = (panes.withColumn("_home", home)
             .withColumn("_blk", F.explode(F.when(reach, F.array(home - 1, home)).otherwise(F.array(home)))))
    w = W.partitionBy(*by, "_blk").orderBy("_p").rowsBetween(0, panes_per_window - 1)
    for name, (kind, _) in aggs.items():
        if kind == "avg":
            frame[name] = F.sum(f"_{name}_s").over(w) / F.sum(f"_{name}_c").over(w)
        elif kind in ("first", "last"):
            frame[name] = getattr(F, kind)(f"_{name}").over(w)
        elif kind == "rows":
            flat = F.flatten(F.collect_list(f"_{name}").over(w))
            frame[name] = F.transform(flat, lambda s: s["v"])
        else:
            frame[name] = _FOLD[kind][1](f"_{name}").over(w)
    start = F.col("_p") * g
    own = (F.col("_blk") == F.col("_home")) & (start % step == 0)
    # only frames that begin a window are worth computing arrays for, but the
    # frame must see every pane: filter after the window, project before it
    out = panes.withColumn("n", F.sum("_n").over(w))
    for name, e in frame.items():
        out = out.withColumn(name, e)
    out = out.where(own)
    if tail == "drop":
        out = out.where(F.col("n") == size)
    elif tail == "keep_last":
        out = out.where((F.col("n") == size) | (start == 0) | (F.col("n") >= size - step))
    if max_windows is not None:
        out = out.where(start < max_windows * step)
    return out.select(*by, (start / step).cast("bigint").alias("window_id"), start.cast("bigint").alias("start"),
                      (start + F.col("n") - 1).cast("bigint").alias("end"), F.col("n").cast("bigint").alias("n"),
                      *aggs)


def window_count(n: Column, size: int, step: int) -> Column:
    """Number of full windows over ``n`` rows."""
    return F.when(n < size, F.lit(0)).otherwise(1 + F.floor((n - size) / step)).cast("bigint")


def size_from_index(index: str) -> Column:
    """Aggregate: global window length as one more than the largest position used, 0 when there is none."""
    return F.coalesce(F.max(F.col(index)) + 1, F.lit(0)).cast("bigint")


def size_from_arrays(*arrays: str) -> Column:
    """Aggregate: global window length as the longest array present."""
    sizes = [F.coalesce(F.size(F.col(a)), F.lit(0)) for a in arrays]
    longest = sizes[0] if len(sizes) == 1 else F.greatest(*sizes)
    return F.coalesce(F.max(longest), F.lit(0)).cast("bigint")


def pad_by_index(df: DataFrame, window: str, line: str, index: str, size: int,
                 values: dict[str, str], pad: float = MISSING) -> DataFrame:
    """Spread a sparse pattern over ``size`` positions: last line of a position wins, gaps are padded.

    Positions at or past ``size`` are dropped.  Each value column comes back as
    an array of ``size`` cells.
    """
    # positions outside share one cell nobody reads: a pattern with no other is still a window of padding
    inside = (F.col(index) >= 0) & (F.col(index) < size)
    payload = F.struct(*[F.col(c) for c in values])
    cells = df.groupBy(window, F.when(inside, F.col(index).cast("int")).otherwise(-1).alias("_pos")).agg(
        F.max_by(payload, F.col(line)).alias("_cell"))
    packed = cells.groupBy(window).agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", "_cell"))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    empty = F.lit(float(pad))

    def column(c: str, name: str) -> Column:
        return F.transform(slots, lambda p: F.coalesce(
            F.try_element_at(F.col("_m"), p)[c].cast("double"), empty)).alias(name)

    return packed.select(window, *[column(c, name) for c, name in values.items()])


def pad_positions(df: DataFrame, window: str, line: str, index: str, size: int,
                  value: str, pad: float = MISSING) -> DataFrame:
    """Long form of :func:`pad_by_index`: one row per (window, position)."""
    wide = pad_by_index(df, window, line, index, size, {value: "_cells"}, pad)
    return wide.select(window, F.posexplode("_cells").alias("pos", value))


def tensor(rows: Column, size: int, width: int, pad: float) -> Column:
    """Fix an array of row vectors to ``size`` rows: cut the excess, pad the shortfall."""
    blank = F.array_repeat(F.lit(float(pad)), width)
    have = F.slice(rows, 1, size)
    return F.concat(have, F.array_repeat(blank, F.greatest(F.lit(size) - F.size(have), F.lit(0))))


def dense_cells(columns: list[str], pad: float) -> Column:
    """Row vector in catalog order, null or non-finite cells padded."""
    return F.array(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull(), F.lit(float(pad)))
                     .otherwise(F.col(c).cast("double")) for c in columns])


def compact(rows: Column, max_length: int, pads=(MISSING, OUT_OF_RANGE)) -> Column:
    """Drop steps that are all padding, zero the padding in the rest, cut to ``max_length``."""
    marks = F.array(*[F.lit(float(p)) for p in pads])

    def real(x: Column) -> Column:
        return x.isNotNull() & ~F.array_contains(marks, x)

    kept = F.filter(rows, lambda r: F.exists(r, real))
    clean = F.transform(kept, lambda r: F.transform(r, lambda x: F.when(real(x), x).otherwise(F.lit(0.0))))
    return F.slice(clean, 1, max_length)


def compact_length(compacted: Column) -> Column:
    """Length of a compacted sequence, at least 1."""
    return F.greatest(F.size(compacted), F.lit(1))


def first_of_run(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a whole run in order: its limit on raw packets, merged packets or windows."""
    return df.orderBy(*order).limit(n)
