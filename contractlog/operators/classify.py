"""Lines as versions: parsed, told apart from tombstones and bad lines, and validated.

The first that applies names a bad line: torn tail, invalid json, missing key, contract
violation. Blank lines are neither records nor bad. A record whose ``_deleted`` is truthy is
a tombstone of its key and isn't validated.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlog.contract import Contract
from contractlog.functions import checks
from contractlog.functions.checks import settled

TORN, VIOLATION = "torn tail: no trailing newline", "contract violation: "
#: Wrapped around a line to prove that its JSON ends where the line ends.
NONCE = "␠end"
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*"


def _told(texts: pd.Series) -> pd.Series:
    """What a strict JSON reader says of lines that the built-in one refused: "=" and the value written again, or a reason."""

    def one(text):
        if text is None:
            return None
        try:
            return "=" + json.dumps(json.loads(text), ensure_ascii=False, allow_nan=False)
        except json.JSONDecodeError as e:
            return f"invalid json: {e.msg} at col {e.colno}"
        except (ValueError, RecursionError) as e:  # NaN and infinities, numbers or nesting without end
            return f"invalid json: {e}"

    return texts.map(one, na_action="ignore").astype(object)


def parse(lines: DataFrame) -> DataFrame:
    """lines(raw, torn, ...) with rec (variant) and parse_reason; blank lines are left out.

    A line is wrapped into an array with a nonce behind it, which proves that its JSON ends
    where the line ends; that is parsed once. Only lines that the built-in parser refuses are
    handed to Python, for the exact message (and for repeated keys, which the last one wins):
    of the others no byte leaves the JVM.
    """
    told = F.pandas_udf(_told, "string").asNondeterministic()
    given = lines.columns
    text = F.regexp_replace(F.make_valid_utf8(F.col("raw")), f"^{BLANKS}|{BLANKS}\\z", "")
    rows = lines.withColumn("_text", settled(text)).where((F.col("_text") != "") | F.col("torn"))
    rows = rows.withColumn("_w", settled(F.when(~F.col("torn"), F.try_parse_json(F.concat(F.lit("["), F.col("_text"), F.lit(f', "{NONCE}"]'))))))
    at = lambda k, kind: F.try_variant_get(F.col("_w"), f"$[{k}]", kind)
    whole = (at(1, "string") == NONCE) & at(2, "variant").isNull()
    rows = rows.withColumn("_rec", settled(F.when(whole, at(0, "variant"))))
    rows = rows.withColumn("_told", told(F.when(F.col("_rec").isNull() & ~F.col("torn"), F.col("_text"))))
    rows = rows.withColumn("_again", settled(F.when(F.col("_told").startswith("="), F.try_parse_json(F.substring("_told", 2, 2**31 - 1)))))
    reason = F.when(F.col("torn"), F.lit(TORN)).when(F.col("_rec").isNull() & F.col("_again").isNull(), F.when(F.col("_told").startswith("="), F.lit("invalid json")).otherwise(F.col("_told")))
    return rows.select(*given, F.coalesce("_rec", "_again").alias("rec"), reason.alias("parse_reason"))


def truthy(v: Column) -> Column:
    """Whether a variant counts as true: not absent, null, false, 0, "", [] or {}."""
    _, kind, text, _ = checks.seen(v)
    empty = (
        F.is_variant_null(v)
        | ((kind == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean"))
        | (kind.isin("BIGINT", "DOUBLE", "DECIMAL") & (F.try_variant_get(v, "$", "double") == 0))
        | ((kind == "STRING") & (text == ""))
        | (kind.isin("ARRAY", "OBJECT") & F.to_json(v).isin("[]", "{}"))
    )
    return v.isNotNull() & ~F.coalesce(empty, F.lit(False))


def classify(parsed: DataFrame, contract: Contract, record: bool = False, only: str | None = None) -> DataFrame:
    """parse() with key, tombstone, reason (null if good) and readable (good but for the contract).

    The key is the coerced key's text, so ``1`` and ``1.0`` are one key of an int field.
    record: the canonical record as well. only: rows of this key, found before the contract is applied.
    """
    key_field = contract[contract.key]
    if only is not None:
        rows = parsed.withColumn("_raw_key", settled(checks.part(F.col("rec"), contract.key)))
        spelt = checks.seen(F.col("_raw_key"))
        found, _ = checks.field_columns(key_field, spelt)
        parsed = rows.withColumn("_key", settled(F.coalesce(found.cast("string"), spelt.text))).where(F.col("_key") == only).drop("_raw_key", "_key")
    rows, fields = checks.spread(parsed, contract)
    key, _ = checks.field_columns(key_field, fields[contract.key])
    has_key = F.coalesce(fields[contract.key].v.isNotNull(), F.lit(False))
    rows = rows.withColumn("_gone", settled(checks.part(F.col("rec"), "_deleted")))
    tombstone = F.when(has_key & F.col("_gone").isNotNull(), truthy(F.col("_gone"))).otherwise(F.lit(False))
    made = [
        F.coalesce(key.cast("string"), F.when(has_key, fields[contract.key].text)).alias("key"),
        tombstone.alias("tombstone"),
        (F.col("parse_reason").isNull() & has_key).alias("readable"),
    ]
    rows = rows.withColumn("_c", settled(F.struct(*made)))
    judged = F.col("_c.readable") & ~F.col("_c.tombstone")
    rows = rows.withColumn("_issues", settled(F.when(judged, checks.issues(contract, fields))))
    reason = (
        F.when(F.col("parse_reason").isNotNull(), F.col("parse_reason"))
        .when(~F.col("_c.readable"), F.lit(f"missing key '{contract.key}'"))
        .when(F.col("_issues") != "", F.concat(F.lit(VIOLATION), F.col("_issues")))
    )
    kept = [c for c in parsed.columns if c != "parse_reason"]
    more = [settled(F.when(judged & (F.col("_issues") == ""), checks.canonical(contract, fields))).alias("record")] if record else []
    return rows.select(*kept, "_c.key", "_c.tombstone", reason.alias("reason"), "_c.readable", *more)


def bad_lines(classified: DataFrame) -> DataFrame:
    return classified.where("reason is not null").select("offset", "line", "reason", "raw")
