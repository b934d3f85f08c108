"""Cells of reports as column expressions: quoting, escaping, truncation, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL, DETAIL = 80, 800
#: What a bare cell may not be.
NUMBER_RE = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
QUOTED_RE = r'[:"\\\[\]{},\x00-\x1F]|^[ \t]|[ \t]\z|^[-#]'
#: Units of sizes.
UNITS = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
SIZE_RE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def truncate(text: Column, most: int = CELL) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def escaped(text: Column) -> Column:
    """Backslash, quote, newline, return and tab by two characters; other controls as \\u00xx."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    rest = [k for k in range(32) if chr(k) not in "\n\r\t"]
    spelt = out
    for k in rest:
        spelt = F.replace(spelt, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.when(out.rlike(r"[\x00-\x1F]"), spelt).otherwise(out)


def needs_quotes(text: Column) -> Column:
    return (text == "") | text.isin("true", "false", "null") | text.rlike(NUMBER_RE) | text.rlike(QUOTED_RE)


def cell(text: Column) -> Column:
    """A text as a cell: null, bare or quoted."""
    return F.when(text.isNull(), F.lit("null")).when(needs_quotes(text), F.concat(F.lit('"'), escaped(text), F.lit('"'))).otherwise(text)


def number(x: Column) -> Column:
    """A double as a cell: whole numbers below 1e16 without a point, what isn't finite as null.

    Others have their shortest digits: plainly from 1e-4 to 1e16, beyond that as 1.5e+20, 1e-05.
    """
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = finite & (x == F.rint(x)) & (F.abs(x) < 1e16)
    # the fewest digits that read back as the same number: 15, 16 or 17
    tries = [F.format_string(f"%.{k}e", F.abs(x)) for k in (14, 15, 16)]
    said = F.coalesce(*(F.when(t.cast("double") == F.abs(x), t) for t in tries[:2]), tries[2])
    shown = F.when(finite & ~whole, F.element_at(F.transform(F.array(said), _laid_out), 1))
    return F.when(~F.coalesce(finite, F.lit(False)), F.lit("null")).when(whole, x.cast("long").cast("string")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(""), shown))


def _laid_out(said: Column) -> Column:
    """A number written as 1.250e+20, without a sign, in the notation's form."""
    power = F.substring_index(said, "e", -1).cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(said, "e", 1), F.lit("."), F.lit("")), r"(?<=[0-9])0+\z", "")
    rest = lambda k: digits.substr(k, F.length(digits))
    large = F.concat(F.rpad(F.left(digits, power + 1), power + 1, F.lit("0")), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), rest(power + 2))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), rest(F.lit(2)))).otherwise("")
    size = F.abs(power).cast("string")
    science = F.concat(F.left(digits, F.lit(1)), fraction, F.when(power < 0, F.lit("e-")).otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    return F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(science)


def row(*cells: Column) -> Column:
    return F.concat_ws(",", *cells)


def size_of(text: Column) -> Column:
    """Bytes of a size such as 1.5m; NULL if it isn't one."""
    n, unit = F.regexp_extract(text, SIZE_RE, 1), F.lower(F.regexp_extract(text, SIZE_RE, 2))
    factor = F.lit(None).cast("long")
    for u, f in UNITS.items():
        factor = F.when(unit == u, F.lit(f).cast("long")).otherwise(factor)
    return F.when(n != "", F.floor(n.try_cast("double") * factor).cast("long"))


def parse_size(text: str) -> int:
    m = re.fullmatch(SIZE_RE.strip("^$"), text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].lower()])
