"""Coercion of loosely typed packet fields.

Every function maps a STRING Column to a typed Column with built-in
expressions only, so they fuse into the scan's generated code.  ANSI mode is
assumed: nothing here can raise on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain digits are by far the most common text, so every reading tries the cast
# first and looks at patterns only when that fails: CASE and coalesce are lazy.
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_FLOAT_OR_WORD = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_LIST = r"(?s)^\[.*\]$"
_MAX_EXACT = 9.2e18


def _bigint(c: Column) -> Column:
    return c.try_cast("bigint")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _trunc(d: Column) -> Column:
    """Double to BIGINT toward zero; null when not finite or too large."""
    return F.when(F.abs(d) < _MAX_EXACT, d.cast("bigint"))


_HEX = "[xX]0*[0-9A-Fa-f]{1,15}"
_OCTAL = "[oO]0*[0-7]{1,20}"
_BINARY = "[bB]0*[01]{1,62}"


def _unprefixed(t: Column) -> Column:
    """Text without its ``0x``-style mark and plus sign."""
    return F.regexp_replace(t, r"^\+?(-?)0[xXoObB]", "$1")


def hex_literal(t: Column) -> Column:
    """Signed ``0x`` literal to BIGINT, null when it is not one or has over 60 significant bits."""
    # a negative target base makes conv read and write the sign
    return F.when(t.rlike(f"^[+-]?0{_HEX}$"), _bigint(F.conv(_unprefixed(t), 16, -10)))


def _prefixed_literal(t: Column) -> Column:
    """The same for hexadecimal, octal and binary literals."""
    mark = F.lower(F.substring(F.ltrim(t, F.lit("+-")), 2, 1))
    base = F.when(mark == "x", 16).when(mark == "o", 8).otherwise(2)
    value = F.call_function("conv", _unprefixed(t), base, F.lit(-10))
    return F.when(t.rlike(f"^[+-]?0({_HEX}|{_OCTAL}|{_BINARY})$"), _bigint(value))


def py_float(s: Column, finite: bool = False) -> Column:
    """Text to DOUBLE by the usual float grammar (no ``1d`` suffixes); null when it does not parse."""
    return F.coalesce(_bigint(s).cast("double"),
                      _double(F.regexp_extract(F.trim(s), _FLOAT if finite else _FLOAT_OR_WORD, 0)))


def first_item(s: Column) -> Column:
    """First element when the text is a non-empty JSON list, else the text itself."""
    return F.when(F.trim(s).startswith("["), F.coalesce(F.get_json_object(s, "$[0]"), s)).otherwise(s)


def coerce_scalar(s: Column) -> Column:
    """Typed reading of a scalar: ``struct<i bigint, d double, s string>`` with one field set.

    ``0x`` text and digit strings become integers, text holding ``.``/``e``/``E``
    that parses becomes a float, anything else (blank included) stays text.
    """
    t = F.trim(s)
    as_int = F.coalesce(F.when(~t.startswith("+"), _bigint(t)), hex_literal(t))
    as_float = F.when(as_int.isNull() & t.rlike("[.eE]"), py_float(t))
    text = F.when(as_int.isNull() & as_float.isNull(), s)
    return F.struct(as_int.alias("i"), as_float.alias("d"), text.alias("s"))


def to_int(s: Column) -> Column:
    """Integer only when the value is integral (``6.0`` is, ``6.5`` is not); hex accepted; else null."""
    t = F.trim(s)
    d = py_float(t, finite=True)
    return F.coalesce(_bigint(t), hex_literal(t), F.when(d == F.floor(d), _trunc(d)))


def _literal(t: Column) -> Column:
    """Integer literal of trimmed text; a leading zero is fine only for zero itself."""
    v = _bigint(t)
    plain = F.when((v == 0) | ~F.ltrim(t, F.lit("+-")).startswith("0"), v)
    return F.when(v.isNotNull(), plain).otherwise(_prefixed_literal(t))


def safe_int(s: Column, default: int | None = 0) -> Column:
    """Integer literal with base prefix (``0x``, ``0o``, ``0b``); ``010`` and ``6.0`` give the default.

    A JSON list is read through its first element.
    """
    v = _literal(F.trim(F.when(F.ltrim(s).startswith("["), F.get_json_object(s, "$[0]")).otherwise(s)))
    return v if default is None else F.coalesce(v, F.lit(default).cast("bigint"))


def safe_int_offline(s: Column, default: int = 0) -> Column:
    """Labelling-job variant: first non-null list element, ``0x`` or plain digits (leading zeros fine)."""
    t = F.trim(s)
    items = F.filter(F.from_json(t, "array<string>"), lambda x: x.isNotNull())
    first = F.trim(F.get(items, 0))
    v = F.when(t.startswith("["), F.coalesce(_bigint(first), hex_literal(first))).otherwise(
        F.coalesce(_bigint(t), hex_literal(t)))
    return F.coalesce(v, F.lit(default).cast("bigint"))


def safe_float(s: Column, default: float = -1.0, finite: bool = False) -> Column:
    """Text to DOUBLE, default when null, blank or unparsable; ``finite`` also rejects NaN and infinity."""
    return F.coalesce(py_float(first_item(s), finite), F.lit(float(default)))


def hex_or_decimal_int(s: Column) -> Column:
    """``0x`` text or a decimal (truncated) to BIGINT; ``nan``, non-finite and other text give null."""
    t = F.trim(s)
    return F.coalesce(_bigint(t), hex_literal(t), _trunc(py_float(t, finite=True)))


def hex_or_decimal_float(s: Column) -> Column:
    return hex_or_decimal_int(s).cast("double")


def match_code(s: Column) -> Column:
    """Tri-state match flag: 1.0 yes, 0.0 no, -1.0 unknown."""
    # The accepted spellings.
    yes = ["1", "true", "True", "O", "o", "OK", "ok"]
    no = ["0", "false", "False", "X", "x"]
    return (F.when(s.isin(yes), F.lit(1.0)).when(s.isin(no), F.lit(0.0)).otherwise(F.lit(-1.0)))


def iso_epoch_ms(s: Column) -> Column:
    """ISO-8601 text to epoch milliseconds; no zone means UTC; 0 when missing or unparsable."""
    ok = F.trim(s).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.coalesce(F.when(ok, F.unix_millis(F.try_to_timestamp(F.trim(s)))),
                      F.lit(0).cast("bigint"))


# --- lists -----------------------------------------------------------------

def _json_items(s: Column) -> Column:
    """Elements of a JSON list, nested lists flattened one level; null when the text is not one.

    A parsed text array keeps an inner list as its own JSON text, so elements
    that again look like lists are opened and spliced in; one that cannot be read
    stays a single, bad element.
    """
    t = F.trim(s)
    items = F.when(t.rlike(_LIST), F.from_json(t, "array<string>"))
    opened = F.transform(items, lambda x: F.when(
        x.rlike(r"(?s)^\s*\[.*\]\s*$"), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x)))
    return F.flatten(opened)


def str_list(s: Column) -> Column:
    """JSON list or text delimited by comma, semicolon or blank -> trimmed non-blank strings."""
    parts = F.coalesce(_json_items(s), F.split(F.trim(s), "[,; ]"))
    trimmed = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def float_list(s: Column) -> Column:
    """JSON list or text delimited by comma or semicolon -> parsable numbers, bad items dropped."""
    parts = F.coalesce(_json_items(s), F.split(F.trim(s), "[,;]"))
    nums = F.filter(F.transform(parts, lambda x: py_float(x)), lambda x: x.isNotNull())
    return F.coalesce(nums, F.array().cast("array<double>"))


def int_list(s: Column) -> Column:
    """JSON list (numbers truncate) or delimited text of integer literals -> integers, bad items dropped."""
    listed = F.transform(_json_items(s), lambda x: F.coalesce(
        _bigint(x), _trunc(py_float(x, finite=True))))
    text = F.transform(F.split(F.trim(s), "[,; ]"), lambda x: safe_int(x, None))
    nums = F.filter(F.coalesce(listed, text), lambda x: x.isNotNull())
    return F.coalesce(nums, F.array().cast("array<bigint>"))


def hex_word_list(s: Column) -> Column:
    """JSON list (or a lone value) of hex or decimal words -> doubles."""
    items = F.coalesce(_json_items(s), F.when(F.trim(s) != "", F.array(s)))
    nums = F.filter(F.transform(items, hex_or_decimal_float), lambda x: x.isNotNull())
    return F.coalesce(nums, F.array().cast("array<double>"))


_NAN_WORDS = ["nan", "none", "null"]  # Fixed values: texts treated as "no name".


def clean_name(s: Column) -> Column:
    """Trimmed variable name; blank and nan-like texts give null."""
    t = F.trim(s)
    return F.when((t != "") & ~F.lower(t).isin(_NAN_WORDS), t)


def name_list(s: Column) -> Column:
    """JSON list or comma text of variable names, nan-like entries dropped."""
    parts = F.coalesce(_json_items(s), F.split(s, ","))
    return F.filter(F.transform(parts, clean_name), lambda x: x.isNotNull())


def address_numbers(s: Column) -> Column:
    """First run of digits of every address in a list (or a lone value) -> doubles."""
    items = F.coalesce(_json_items(s), F.when(F.trim(s) != "", F.array(s)))
    digits = F.transform(items, lambda x: F.regexp_extract(F.coalesce(clean_name(x), F.lit("")), r"(\d+)", 1))
    nums = F.transform(F.filter(digits, lambda x: x != ""), _double)
    return F.coalesce(nums, F.array().cast("array<double>"))


def first_present(df, names: list[str]) -> Column:
    """First of several alias columns the frame really has, chosen when the plan is built."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("string")


def parse_packet_text(s: Column, schema: str) -> Column:
    """A packet carried as JSON text; null unless it is one object."""
    t = F.trim(s)
    return F.when(t.startswith("{") & t.endswith("}"), F.from_json(t, schema))
