"""A contract as column expressions: coercion, defaults, constraints and their messages.

A parsed record is a variant column. For each field there are two expressions, both inside
whole-stage code: ``value`` (the coerced value, the default where the field is absent) and
``errors`` (an array of ``"name: message"``, empty when the field is right). Absent means
that the path gives SQL NULL; an explicit null is a variant null.

``spread`` lays a record out in three projections, each of which computes a thing once: the
fields' variants, their kinds and texts, and what they are coerced to. All messages, keys and
canonical records are then small expressions over these columns.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlog.contract import Contract, Field, Kind

#: What a string may say for a boolean.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]

#: Messages of wrong types.
WRONG = {
    "str": "Input should be a valid string",
    "int": "Input should be a valid integer",
    "float": "Input should be a valid number",
    "bool": "Input should be a valid boolean",
    "datetime": "Input should be a valid datetime",
    "date": "Input should be a valid date",
    "time": "Input should be in a valid time format",
    "uuid": "Input should be a valid UUID",
    "email": "Input should be a valid string",
    "list": "Input should be a valid list",
    "dict": "Input should be a valid dictionary",
}
INT_LONG = "Input should be a valid integer, of 64 bits at most"
INT_TEXT, INT_FRACTION = "Input should be a valid integer, unable to parse string as an integer", "Input should be a valid integer, got a number with a fractional part"
FLOAT_TEXT = "Input should be a valid number, unable to parse string as a number"
BOOL_TEXT = "Input should be a valid boolean, unable to interpret input"
EMAIL_TEXT = "value is not a valid email address"
REQUIRED, FORBIDDEN = "Field required", "Extra inputs are not permitted"

INT_RE = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0*)?\s*\z"
FLOAT_RE = r"(?i)^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?\s*\z|^\s*[+-]?(inf|infinity|nan)\s*\z"
UUID_RE = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\z"
EMAIL_RE = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]([A-Za-z0-9-]*[A-Za-z0-9])?\z"
ZONE = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})?"
DATETIME_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt _][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?" + ZONE + r")?\z"
DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
#: Numbers beyond this are milliseconds, others seconds.
MILLISECONDS_FROM = 20_000_000_000
#: The moments that can be written with four digits of a year.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799
NUMBER_TEXT_RE = r"^[+-]?[0-9]+(\.[0-9]+)?\z"
TIME_RE = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?" + ZONE + r"\z"


def path_of(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def part(rec: Column, name: str) -> Column:
    """The field's variant: NULL if absent."""
    return F.try_variant_get(rec, path_of(name), "variant")


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, OBJECT, ARRAY or VOID."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


class Seen(NamedTuple):
    """A value with its kind and text; and, where it is settled already, what it is coerced to and what is wrong with it."""

    v: Column
    kind: Column
    text: Column
    fit: tuple[Column, Column] | None = None


def seen(v: Column) -> Seen:
    return Seen(v, kind_of(v), text_of(v))


def settled(c: Column) -> Column:
    """The column, computed once where it stands: filters above aren't copied below it.

    Contract expressions are large; copied into every filter and projection that needs a part
    of them, they would be planned and evaluated many times over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def anchored(pattern: str) -> str:
    """The pattern with a closing $ as the end of the text and not as the end of its last line."""
    return pattern[:-1] + r"\z" if re.search(r"(?<!\\)(\\\\)*\$\Z", pattern) else pattern


def _moment(number: Column) -> Column:
    """Microseconds since 1970 of a number of seconds or milliseconds, or NULL."""
    seconds = F.when(F.abs(number) > MILLISECONDS_FROM, number / 1000).otherwise(number)
    return F.when((seconds >= FIRST_SECOND) & (seconds <= LAST_SECOND), F.round(seconds * 1000000).try_cast("long"))


def _once(c: Column, f) -> Column:
    """f of the column, which is computed once however often f uses it: expressions double in size with every use."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _spelt(micros: Column, pattern: str) -> Column:
    """A moment by a pattern, with its fraction if it has one, in UTC."""

    def one(m):
        part = F.pmod(m, F.lit(1000000))
        fraction = F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise("")
        return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_micros(m), F.current_timezone()), pattern), fraction, F.lit("Z"))

    return _once(micros, one)


CLOCK_RE = r"([0-9]{2}:[0-9]{2})(:[0-9]{2})?(\.[0-9]{1,9})?(Z|z|[+-][0-9]{2}:?[0-9]{2})?\z"


def _clock(text: Column) -> Column:
    """The time of day that a text ends with: seconds added, fractions of six digits or none, zones as Z or +hh:mm."""
    piece = lambda k: F.regexp_extract(text, CLOCK_RE, k)
    seconds = F.rpad(piece(2), 3, ":00")
    fraction = F.regexp_replace(F.regexp_replace(piece(3), r"^(\.[0-9]{1,6}).*", "$100000"), r"^(\.[0-9]{6}).*", "$1")
    zone = F.regexp_replace(F.upper(piece(4)), r"^([+-][0-9]{2}):?([0-9]{2})\z", "$1:$2")
    return F.concat(piece(1), seconds, F.regexp_replace(fraction, r"^\.000000\z", ""), F.regexp_replace(zone, r"^[+-]00:00\z", "Z"))


def typed(kind: Kind, given: Column | Seen) -> tuple[Column, Column]:
    """(value, message): of a present, non-null variant; the message is null if it fits."""
    v, k, s, _ = given if isinstance(given, Seen) else seen(given)
    is_text, is_num = k == "STRING", k.isin("DOUBLE", "DECIMAL", "FLOAT")
    none = F.lit(None).cast("string")
    wrong = F.lit(WRONG.get(kind.name, ""))
    name = kind.name
    if name == "any":
        return v, none
    if name == "dict":
        return v, F.when(k != "OBJECT", wrong)
    if name == "str":
        return s, F.when(~is_text, wrong)
    if name == "int":
        plain = F.regexp_replace(F.regexp_replace(F.trim(s), r"\.0*\z", ""), "_", "")
        no_fraction = is_num & (_number(v) == F.rint(_number(v)))
        whole = F.when((k == "BIGINT") | no_fraction, F.try_variant_get(v, "$", "long")).when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
        whole = whole.when(is_text & s.rlike(INT_RE), plain.try_cast("long"))
        long = no_fraction | (is_text & s.rlike(INT_RE))
        bad = F.when(whole.isNotNull(), none).when(long, F.lit(INT_LONG)).when(is_text, F.lit(INT_TEXT)).when(is_num, F.lit(INT_FRACTION)).otherwise(wrong)
        return whole, bad
    if name == "float":
        value = F.when(k.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), _number(v)).when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        value = value.when(is_text & s.rlike(FLOAT_RE), F.regexp_replace(F.trim(s), "_", "").try_cast("double"))
        return value, F.when(is_text & value.isNull(), F.lit(FLOAT_TEXT)).when(value.isNull(), wrong)
    if name == "bool":
        low = F.lower(s)
        value = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        value = value.when(k.isin("BIGINT", "DOUBLE", "DECIMAL") & _number(v).isin(0.0, 1.0), _number(v) == 1.0)
        value = value.when(is_text & low.isin(TRUE_WORDS), F.lit(True)).when(is_text & low.isin(FALSE_WORDS), F.lit(False))
        scalar = k.isin("BIGINT", "DOUBLE", "DECIMAL", "STRING")
        return value, F.when(value.isNull() & scalar, F.lit(BOOL_TEXT)).when(value.isNull(), wrong)
    if name == "enum":
        return _member(kind, v, k, s)
    if name == "email":
        return s, F.when(~is_text, wrong).when(~s.rlike(EMAIL_RE), F.lit(EMAIL_TEXT))
    if name == "uuid":
        plain = F.lower(F.replace(s, F.lit("-"), F.lit("")))
        shown = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
        return shown, F.when(~is_text | ~s.rlike(UUID_RE), wrong)
    number = F.when(k.isin("BIGINT", "DOUBLE", "DECIMAL"), _number(v)).when(is_text & s.rlike(NUMBER_TEXT_RE), s.try_cast("double"))
    if name == "datetime":
        clock = F.when(F.length(s) == 10, F.lit("00:00:00")).otherwise(_clock(s))
        given = _once(F.when(is_text & s.rlike(DATETIME_RE), F.concat(F.left(s, F.lit(10)), F.lit("T"), clock)), lambda x: F.when(F.try_to_timestamp(F.substring(x, 1, 19)).isNotNull(), x))
        value = F.coalesce(_spelt(_once(number, _moment), "yyyy-MM-dd'T'HH:mm:ss"), given)
    elif name == "date":
        day = _once(F.when(is_text, F.regexp_replace(s, r"[Tt ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?\z", "")), lambda x: F.when(x.rlike(DATE_RE) & x.try_cast("date").isNotNull(), x))
        midnight = _once(_once(number, _moment), lambda m: F.when(F.pmod(m, F.lit(86400 * 1000000)) == 0, m))
        value = F.coalesce(F.left(_spelt(midnight, "yyyy-MM-dd"), F.lit(10)), day)
    elif name == "time":
        in_day = _once(number, lambda x: F.when((x >= 0) & (x < 86400), _moment(x)))
        value = F.coalesce(_spelt(in_day, "HH:mm:ss"), F.when(is_text & s.rlike(TIME_RE), _clock(s)))
    else:
        raise AssertionError(name)
    return value, F.when(value.isNull(), wrong)


def _member(kind: Kind, v: Column, k: Column, s: Column) -> tuple[Column, Column]:
    words = [x for x in kind.values if isinstance(x, str)]
    numbers = [x for x in kind.values if not isinstance(x, str)]
    fits = F.lit(False)
    if words:
        fits = fits | ((k == "STRING") & s.isin(words))
    if numbers:  # a number, or a boolean, that equals one of the values
        as_number = F.coalesce(_number(v), F.try_variant_get(v, "$", "boolean").cast("double"))
        fits = fits | ((k != "STRING") & as_number.isin([float(x) for x in numbers]))
    told = [repr(x) if isinstance(x, str) else str(x) for x in kind.values]
    said = told[0] if len(told) == 1 else ", ".join(told[:-1]) + " or " + told[-1]
    ok = F.coalesce(fits, F.lit(False))
    return F.when(ok, s.try_cast(kind.spark) if not isinstance(kind.spark, T.StringType) else s), F.when(~ok, F.lit(f"Input should be {said}"))


def _plural(n: int, unit: str) -> str:
    return f"{n} {unit}" + ("" if n == 1 else "s")


def broken_rule(f: Field, x: Column) -> Column:
    """The message of the first rule that the coerced value breaks, or null."""
    r, checks = f.rules, []
    if "multiple_of" in r:
        by = r["multiple_of"]
        whole = f.kind.name == "int" and float(by).is_integer()
        off = (x % F.lit(int(by)) != 0) if whole else F.abs(x / F.lit(float(by)) - F.rint(x / F.lit(float(by)))) > 1e-9
        checks.append((off, f"Input should be a multiple of {by}"))
    for rule, off, words in (
        ("le", lambda b: x > b, "less than or equal to"), ("lt", lambda b: x >= b, "less than"),
        ("ge", lambda b: x < b, "greater than or equal to"), ("gt", lambda b: x <= b, "greater than"),
    ):
        if rule in r:
            checks.append((F.isnan(x.cast("double")) | off(F.lit(r[rule])), f"Input should be {words} {r[rule]}"))
    if f.kind.name == "list":
        n = F.size(x)
        if "min_length" in r:
            checks.append((n < r["min_length"], F.concat(F.lit(f"List should have at least {_plural(r['min_length'], 'item')} after validation, not "), n.cast("string"))))
        if "max_length" in r:
            checks.append((n > r["max_length"], F.concat(F.lit(f"List should have at most {_plural(r['max_length'], 'item')} after validation, not "), n.cast("string"))))
    else:
        if "min_length" in r:
            checks.append((F.char_length(x) < r["min_length"], f"String should have at least {_plural(r['min_length'], 'character')}"))
        if "max_length" in r:
            checks.append((F.char_length(x) > r["max_length"], f"String should have at most {_plural(r['max_length'], 'character')}"))
        if "pattern" in r:
            checks.append((~x.rlike(anchored(r["pattern"])), f"String should match pattern '{r['pattern']}'"))
    out = F.lit(None).cast("string")
    for off, message in reversed(checks):
        out = F.when(off, message if isinstance(message, Column) else F.lit(message)).otherwise(out)
    return out


def default_of(f: Field) -> Column:
    if f.kind.name in ("any", "dict"):
        return F.parse_json(F.lit(json.dumps(f.default)))
    if f.default is None:
        return F.lit(None).cast(f.kind.spark)
    if f.kind.name == "list":
        return F.from_json(F.lit(json.dumps(f.default)), f.kind.spark) if f.default else F.array().cast(f.kind.spark)
    return F.lit(f.default if not isinstance(f.kind.spark, T.StringType) else str(f.default)).cast(f.kind.spark)


def _said(name: str, message: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), message)


def _list_fit(f: Field, s: Seen) -> tuple[Column, Column]:
    """(items coerced, messages of items that don't fit) of a list; both null if it isn't one."""
    is_list, items = s.kind == "ARRAY", F.try_variant_get(s.v, "$", "array<variant>")
    none = F.lit(None).cast("string")

    def fault(x, i):
        if f.kind.items.name == "any":
            return none
        wrong = F.lit(WRONG.get(f.kind.items.name, "Input should be valid"))
        said = F.when(x.isNull() | F.is_variant_null(x), wrong).otherwise(typed(f.kind.items, x)[1])
        return F.concat(F.lit(f"{f.name}."), i.cast("string"), F.lit(": "), said)

    return F.when(is_list, F.transform(items, lambda x: typed(f.kind.items, x)[0])), F.when(is_list, F.array_compact(F.transform(items, fault)))


def fit_of(f: Field, s: Seen) -> tuple[Column, Column]:
    """(coerced value, what is wrong with its type) of a present value."""
    return s.fit or (_list_fit(f, s) if f.kind.name == "list" else typed(f.kind, s))


def field_columns(f: Field, rec: Column | Seen) -> tuple[Column, Column]:
    """(value, errors array) of a field of the record, or of the field's variant as it was seen."""
    s = rec if isinstance(rec, Seen) else seen(part(rec, f.name))
    absent, null = s.v.isNull(), F.is_variant_null(s.v)
    empty = F.array().cast("array<string>")
    one = lambda m: F.when(m.isNull(), empty).otherwise(F.array(_said(f.name, m)))
    missing = F.array(F.lit(f"{f.name}: {REQUIRED}")) if f.required else empty
    value, fault = fit_of(f, s)
    if f.kind.name == "list":
        wrong = F.array(F.lit(f"{f.name}: {WRONG['list']}"))
        errors = F.when(fault.isNull(), wrong).when(F.size(fault) > 0, fault).otherwise(one(broken_rule(f, value)))
        wrong_null = empty if f.nullable else wrong
    else:
        errors = one(F.coalesce(fault, broken_rule(f, value)))
        wrong_null = empty if f.nullable or f.kind.name == "any" else one(fault)
    value = F.when(absent, default_of(f)).when(null, default_of(f) if f.kind.name in ("any", "dict") and f.nullable and f.default is None else F.lit(None).cast(f.kind.spark)).otherwise(value)
    return value, F.when(absent, missing).when(null, wrong_null).otherwise(errors)


class Record:
    """A record's fields: looked up in a variant, or in the columns that spread() has laid out."""

    def __init__(self, rec: Column, fields: dict[str, Seen] | None = None):
        self.rec, self.fields = rec, fields or {}

    def __getitem__(self, name: str) -> Seen:
        return self.fields.get(name) or seen(part(self.rec, name))


def spread(df: DataFrame, contract: Contract, rec: str = "rec") -> tuple[DataFrame, Record]:
    """df with the columns _parts, _kinds and _fits, and the record that reads them."""
    named = list(enumerate(contract.fields))
    df = df.withColumn("_parts", settled(F.struct(*(part(F.col(rec), f.name).alias(f"v{k}") for k, f in named))))
    v = lambda k: F.col(f"_parts.v{k}")
    df = df.withColumn("_kinds", settled(F.struct(*(c for k, _ in named for c in (kind_of(v(k)).alias(f"k{k}"), text_of(v(k)).alias(f"s{k}"))))))
    plain = {f.name: Seen(v(k), F.col(f"_kinds.k{k}"), F.col(f"_kinds.s{k}")) for k, f in named}
    made = [c for k, f in named for c in zip(fit_of(f, plain[f.name]), (f"x{k}", f"m{k}"))]
    df = df.withColumn("_fits", settled(F.struct(*(c.alias(n) for c, n in made))))
    return df, Record(F.col(rec), {f.name: plain[f.name]._replace(fit=(F.col(f"_fits.x{k}"), F.col(f"_fits.m{k}"))) for k, f in named})


SPREAD = ("_parts", "_kinds", "_fits")


def _record(rec: Column | Record) -> Record:
    return rec if isinstance(rec, Record) else Record(rec)


def extras(contract: Contract, rec: Column) -> Column:
    """Names of undeclared fields, in the record's (sorted) order."""
    keys = F.map_keys(F.try_variant_get(rec, "$", "map<string,variant>"))
    return F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*(F.lit(n) for n in contract.names)))


def values(contract: Contract, rec: Column | Record) -> dict[str, Column]:
    record = _record(rec)
    return {f.name: field_columns(f, record[f.name])[0] for f in contract.fields}


def issues(contract: Contract, rec: Column | Record) -> Column:
    """All messages of a record, joined by "; " in the contract's order, extras last; '' if it is right."""
    record = _record(rec)
    found = [field_columns(f, record[f.name])[1] for f in contract.fields]
    if contract.extra == "forbid":
        found.append(F.transform(extras(contract, record.rec), lambda n: F.concat(n, F.lit(f": {FORBIDDEN}"))))
    return F.array_join(F.concat(*found) if len(found) > 1 else found[0], "; ")


def canonical(contract: Contract, rec: Column | Record) -> Column:
    """The record as compact JSON: coerced, defaults filled in, declared fields in order, then extras if allowed."""
    declared = F.to_json(F.struct(*(v.alias(n) for n, v in values(contract, rec).items())), {"ignoreNullFields": "false"})
    rec = _record(rec).rec
    if contract.extra != "allow":
        return declared
    raw = F.to_json(F.map_filter(F.try_variant_get(rec, "$", "map<string,variant>"), lambda k, _: F.array_contains(extras(contract, rec), k)))
    return F.when(F.size(extras(contract, rec)) == 0, declared).otherwise(F.concat(F.substring(declared, F.lit(1), F.char_length(declared) - 1), F.lit(","), F.substring(raw, F.lit(2), F.char_length(raw))))
