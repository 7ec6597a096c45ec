"""Scalar feature formulas as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from railtap.schema import (MISSING, NORM_EPS, OUT_OF_RANGE, PROTOCOL_CODES, PROTOCOL_CODES_FIT)

_ROUND_EPS = 0.5


def code_map(codes: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])


def protocol_code(p: Column, mode: str = "serve") -> Column:
    """Protocol text to its code: 1-based with 0 unknown (serve) or 0-based with -1 unknown (fit)."""
    codes, unknown = (PROTOCOL_CODES, 0) if mode == "serve" else (PROTOCOL_CODES_FIT, -1)
    return F.coalesce(F.try_element_at(code_map(codes), p), F.lit(unknown))


def protocol_norm(code: Column, mode: str = "serve") -> Column:
    if mode == "serve":
        return minmax_sentinel(code.cast("double"), F.lit(0.0), F.lit(float(max(PROTOCOL_CODES.values()))))
    top = float(max(PROTOCOL_CODES_FIT.values()))
    return F.when(code < 0, F.lit(MISSING)).otherwise(code / F.lit(top))


def protocol_alias(p: Column) -> Column:
    return F.when(p == "xgt-fen", F.lit("xgt_fen")).otherwise(p)


def direction_code(d: Column, mode: str = "serve") -> Column:
    """Request is 1; serve maps everything else to 0, fit separates response (0) from unknown (-1)."""
    if mode == "serve":
        return F.when(d == "request", 1.0).otherwise(0.0)
    return F.when(d == "request", 1.0).when(d == "response", 0.0).otherwise(MISSING)


def minmax_sentinel(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling: no parameters or value -> 0, outside the range -> -2, degenerate range -> 0."""
    return (F.when(lo.isNull() | hi.isNull() | x.isNull(), F.lit(0.0))
            .when((x < lo) | (x > hi), F.lit(OUT_OF_RANGE))
            .when(hi == lo, F.lit(0.0))
            .otherwise((x - lo) / (hi - lo + F.lit(NORM_EPS))))


def minmax_plain(x: Column, lo: Column, hi: Column) -> Column:
    """Fit-time scaling without a range check: anything missing -> -1, degenerate range -> 0."""
    return (F.when(lo.isNull() | hi.isNull() | x.isNull(), F.lit(MISSING))
            .when(hi == lo, F.lit(0.0))
            .otherwise((x - lo) / (hi - lo)))


def high_nibble(x: Column, masked: bool = False) -> Column:
    """Value shifted right by four bits; the fit-time form also masks to one nibble."""
    y = F.shiftright(x, 4)
    return y.bitwiseAND(F.lit(15).cast("bigint")) if masked else y


def low_nibble(x: Column) -> Column:
    return x.bitwiseAND(F.lit(15).cast("bigint"))


def payload_bytes(payload: Column) -> Column:
    """Bytes of a hex payload with blanks; empty array for empty text; null when it is not hex."""
    body = F.replace(payload, F.lit(" "), F.lit(""))
    n = F.length(body) / 2
    codes = F.transform(F.sequence(F.lit(1), n.cast("int")),
                        lambda i: F.conv(F.substring(body, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    return (F.when(~body.rlike("^([0-9A-Fa-f]{2})*$"), None)
            .when(body == "", F.array().cast("array<int>")).otherwise(codes))


def payload_stats(payload: Column, data: Column) -> dict[str, Column]:
    """Shape of a payload given its text and its :func:`payload_bytes`.

    A null payload is missing; an empty one counts as hex with no bytes.
    """
    n = F.coalesce(F.size(data), F.lit(0))
    total = F.aggregate(data, F.lit(0).cast("bigint"), lambda a, b: a + b)
    zeros = F.size(F.filter(data, lambda b: b == 0))
    some = F.coalesce(F.size(data) > 0, F.lit(False))
    mean = F.when(some, total / n).otherwise(0.0)
    return {
        "missing": F.when(payload.isNull(), 1.0).otherwise(0.0),
        "len_chars": F.coalesce(F.length(payload), F.lit(0)).cast("double"),
        "num_spaces": F.coalesce(F.length(payload) - F.length(F.replace(payload, F.lit(" "), F.lit(""))),
                                 F.lit(0)).cast("double"),
        "is_hex": F.when(data.isNotNull(), 1.0).otherwise(0.0),
        "n_bytes": n.cast("double"),
        "zero_ratio": F.when(some, zeros / n).otherwise(0.0),
        "first_byte": F.coalesce(F.get(data, F.lit(0)), F.lit(0)).cast("double"),
        "last_byte": F.coalesce(F.when(some, F.try_element_at(data, F.lit(-1))), F.lit(0)).cast("double"),
        "mean_byte": mean,
        "bucket": F.when(some, mean_bucket(mean)).otherwise(0.0),
    }


def mean_bucket(mean: Column) -> Column:
    """Quarter of the byte range the mean falls in."""
    return F.when(mean <= 64, 0.0).when(mean <= 128, 1.0).when(mean <= 192, 2.0).otherwise(3.0)


def range_stats(values: Column, empty: float = 0.0) -> dict[str, Column]:
    """Count, min, max and range of an array; ``empty`` stands in when it has no elements."""
    some = F.size(values) > 0
    lo, hi = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    e = F.lit(float(empty))
    return {"count": F.size(values).cast("double"),
            "min": F.when(some, lo).otherwise(e),
            "max": F.when(some, hi).otherwise(e),
            "range": F.when(some, hi - lo).otherwise(e)}


def moment_stats(values: Column, empty: float = 0.0) -> dict[str, Column]:
    """Min, max, mean and population standard deviation of an array."""
    some = F.size(values) > 0
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2"))

    def step(a, x):
        d = x.cast("double") - a["mean"]
        mean = a["mean"] + d / (a["n"] + 1.0)
        return F.struct((a["n"] + 1.0).alias("n"), mean.alias("mean"),
                        (a["m2"] + d * (x.cast("double") - mean)).alias("m2"))

    std = F.aggregate(values, start, step, lambda a: F.sqrt(a["m2"] / F.greatest(a["n"], F.lit(1.0))))
    mean = F.aggregate(values, zero, lambda a, x: a + x.cast("double")) / F.size(values)
    e = F.lit(float(empty))
    return {"min": F.when(some, F.array_min(values).cast("double")).otherwise(e),
            "max": F.when(some, F.array_max(values).cast("double")).otherwise(e),
            "mean": F.when(some, mean).otherwise(e),
            "std": F.when(some, std).otherwise(e)}


def slot_column_name(address: str, prefix: str) -> str:
    """Feature column name of an address slot."""
    return f"{prefix}_slot_{re.sub('[^0-9A-Za-z_]', '_', re.sub('[% ]', '', address))}_norm"


def slot_column_expr(address: Column, prefix: str) -> Column:
    """The same name as a Column, for long-form slot tables."""
    clean = F.regexp_replace(F.regexp_replace(address, "[% ]", ""), "[^0-9A-Za-z_]", "_")
    return F.concat(F.lit(prefix + "_slot_"), clean, F.lit("_norm"))


def stable_hash(s: Column, mod: int) -> Column:
    """First eight hex digits of the MD5 digest, modulo ``mod``."""
    return F.pmod(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), F.lit(mod).cast("bigint"))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def sigmoid(x: Column) -> Column:
    """Logistic function with the argument clipped to +-20."""
    return 1.0 / (1.0 + F.exp(-clamp(x, -20.0, 20.0)))


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal rounding on the binary value, the same in every engine: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10 ** digits)
    return F.floor(x * k + _ROUND_EPS) / k


def normalized_hex(payload: Column) -> Column:
    """Payload without white space, lower case; empty for null."""
    return F.coalesce(F.lower(F.regexp_replace(payload, r"\s", "")), F.lit(""))


def is_all_zero(hex_text: Column) -> Column:
    return hex_text.rlike("^0+$")


def hex_word(hex_text: Column, index: int) -> Column:
    """The index-th four-digit word of a normalised payload."""
    return F.substring(hex_text, 4 * index + 1, 4)


def zip_shortest(keys: Column, values: Column) -> Column:
    """``array<struct<k,v>>`` of two arrays cut to the shorter one."""
    n = F.least(F.size(keys), F.size(values))
    return F.transform(F.slice(keys, F.lit(1), n), lambda k, i: F.struct(
        k.alias("k"), F.get(values, i).alias("v")))


def pair_map(pairs: Column, last: bool = False) -> Column:
    """Map of address to value; on a repeated address the first (or last) pair wins.

    One pass over the pairs: a map keeps the last of equal keys, which is a
    setting of the session (see :func:`railtap.session.configure`).
    """
    return F.map_from_entries(pairs if last else F.reverse(pairs))
