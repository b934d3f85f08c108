"""Registry of the record-log queries and of the SQL that each must equal.

Every query runs over whole tables and has its SQL.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractlog import present, scratch
from contractlog.contract import Contract, Field, Kind, parse_contract
from contractlog.functions import checks, text
from contractlog.operators import changes, classify, fold, maintenance
from contractlog.plans import logs
from contractlog.plans.logs import table
from contractlog.storage import open_store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


# ---- the fold over the events log -------------------------------------------------------


def gone():
    return F.col("event_type") == "error"


COLS = ["event_id", "event_type", "value"]

_FOLD_SQL = """WITH cut AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id),
live AS (SELECT e.* FROM events e JOIN cut USING (user_id) WHERE event_type <> 'error' AND (c IS NULL OR event_id > c)),
folded AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS pos FROM live GROUP BY user_id)
"""


def _folded(spark, sf_dir) -> DataFrame:
    return fold.fold(logs.events_log(spark, sf_dir), "user_id", F.col("event_id"), gone(), COLS).drop("last")


@query(_FOLD_SQL + "SELECT * FROM folded")
def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)


@query(_FOLD_SQL.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)") + "SELECT * FROM folded")
def fold_events_hot_keys(spark, sf_dir):
    """The fold where one key holds a third of the log."""
    hot = logs.events_log(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))
    return fold.fold(hot, "user_id", F.col("event_id"), gone(), COLS).drop("last")


@query(_FOLD_SQL + "SELECT user_id, event_id, pos, row_number() OVER (ORDER BY pos) AS ordinal FROM folded")
def fold_insertion_order(spark, sf_dir):
    return fold.numbered(_folded(spark, sf_dir).select("user_id", "event_id", "pos"), "pos")


@query(
    """SELECT l_orderkey, l_linenumber, arg_max(l_quantity, k) AS l_quantity, arg_max(l_extendedprice, k) AS l_extendedprice, count(*) AS versions
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS k FROM lineitem)
GROUP BY 1, 2"""
)
def fold_large_lineitem(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # the order column is the whole row; its maximum is combined before the shuffle
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*order)).alias("r"), F.count("*").alias("versions"))
    return best.select("l_orderkey", "l_linenumber", "r.l_quantity", "r.l_extendedprice", "versions")


@query("SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t <> 'error'")
def index_keys(spark, sf_dir):
    return fold.live_keys(logs.events_log(spark, sf_dir), "user_id", F.col("event_id"), gone())


@query(_FOLD_SQL + "SELECT * FROM folded WHERE user_id = 7")
def get_by_key(spark, sf_dir):
    return _folded(spark, sf_dir).where("user_id = 7")


@query(_FOLD_SQL + "SELECT * FROM folded WHERE user_id = -1")
def get_missing_key(spark, sf_dir):
    return _folded(spark, sf_dir).where("user_id = -1")


@query(_FOLD_SQL + "SELECT * FROM folded ORDER BY pos LIMIT 100")
def list_page_100(spark, sf_dir):
    return fold.ordered(_folded(spark, sf_dir), 100)


@query(_FOLD_SQL + "SELECT value, user_id FROM folded ORDER BY pos LIMIT 100")
def list_fields_projection(spark, sf_dir):
    return fold.ordered(_folded(spark, sf_dir), 100).select("value", "user_id")


@query(_FOLD_SQL + "SELECT * FROM folded LIMIT 0")
def list_limit_zero(spark, sf_dir):
    return fold.ordered(_folded(spark, sf_dir), 0)


@query(_FOLD_SQL + "SELECT user_id FROM folded ORDER BY pos LIMIT 20")
def keys_page(spark, sf_dir):
    return fold.ordered(_folded(spark, sf_dir), 20).select("user_id")


@query(_FOLD_SQL + "SELECT least(count(*), 100) AS shown, count(*) AS total FROM folded")
def count_shown_of_total(spark, sf_dir):
    return _folded(spark, sf_dir).agg(F.least(F.count("*"), F.lit(100)).alias("shown"), F.count("*").alias("total"))


@query(
    """SELECT CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS dups, CAST(sum(t) AS BIGINT) AS tombs
FROM (SELECT count(*) FILTER (event_type <> 'error') AS n, count(*) FILTER (event_type = 'error') AS t FROM events GROUP BY user_id)"""
)
def append_only_violations(spark, sf_dir):
    return maintenance.append_only_violations(logs.events_log(spark, sf_dir), "user_id", gone())


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS repeats FROM events WHERE event_type <> 'error'")
def repeat_lines(spark, sf_dir):
    # the first line of a key is a minimum: no window over all lines of a hot key
    rows = logs.events_log(spark, sf_dir).where(~gone()).select("event_id", "user_id")
    first = rows.groupBy("user_id").agg(F.min("event_id").alias("f"))
    return rows.join(first, "user_id").select("event_id", "user_id", (F.col("event_id") > F.col("f")).alias("repeats"))


# ---- lines --------------------------------------------------------------------------------

_LINES = "WITH l AS (" + logs.EVENT_LINES_SQL + ")"
_CLASSES = _LINES + """, p AS (
  SELECT *, trim(raw) AS t, json_valid(trim(raw)) AS ok FROM l WHERE trim(raw) <> ''),
q AS (SELECT *, CASE WHEN ok THEN json_extract_string(t, '$.user_id') END AS k,
  coalesce(CASE WHEN ok THEN json_extract_string(t, '$._deleted') END = 'true', false) AS gone FROM p),
e AS (SELECT *, CASE WHEN ok AND k IS NOT NULL AND NOT gone THEN concat_ws('; ',
    CASE WHEN CAST(k AS BIGINT) < 0 THEN 'user_id: Input should be greater than or equal to 0' END,
    CASE WHEN json_type(t, '$.seq') IS NULL THEN 'seq: Field required'
      WHEN json_type(t, '$.seq') = 'VARCHAR' THEN 'seq: Input should be a valid integer, unable to parse string as an integer' END,
    CASE WHEN json_type(t, '$.note') = 'NULL' THEN 'note: Input should be a valid string'
      WHEN length(json_extract_string(t, '$.note')) > 8 THEN 'note: String should have at most 8 characters' END,
    CASE WHEN json_type(t, '$.zip') IS NOT NULL THEN 'zip: Extra inputs are not permitted' END) END AS issues FROM q),
c AS (SELECT seq, k AS key, gone AS tombstone, ok AND k IS NOT NULL AS readable, raw,
  CASE WHEN NOT ok THEN 'invalid json' WHEN k IS NULL THEN 'missing key ''user_id''' WHEN issues <> '' THEN 'contract violation: ' || issues END AS reason FROM e)
"""


def _lines(spark, sf_dir, record: bool = False) -> DataFrame:
    return classify.classify(classify.parse(logs.dealt(logs.event_lines(spark, sf_dir), "seq")), logs.event_contract(), record)


#: The exact text after "invalid json" is the JSON reader's own; SQL has no such message.
def short():
    return F.when(F.col("reason").startswith("invalid json"), F.lit("invalid json")).otherwise(F.col("reason"))


@query(_CLASSES + "SELECT seq, key, tombstone, readable, reason FROM c")
def classify_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("seq", "key", "tombstone", "readable", short().alias("reason"))


@query(_CLASSES + "SELECT seq, reason, raw FROM c WHERE reason IS NOT NULL")
def bad_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where("reason is not null").select("seq", short().alias("reason"), "raw")


@query(_CLASSES + "SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason")
def bad_count_by_reason(spark, sf_dir):
    return _lines(spark, sf_dir).where("reason is not null").groupBy(short().alias("reason")).agg(F.count("*").alias("n"))


_LIVE = _CLASSES + """, cut AS (SELECT key, max(seq) FILTER (tombstone) AS x FROM c WHERE readable GROUP BY key),
good AS (SELECT c.* FROM c JOIN cut USING (key) WHERE readable AND NOT tombstone AND (x IS NULL OR seq > x)),
folded AS (SELECT key, max(seq) AS seq, min(seq) AS pos FROM good WHERE reason IS NULL GROUP BY key),
indexed AS (SELECT key, max(seq) AS seq, min(seq) AS pos FROM good GROUP BY key)
"""


def _versions(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).select("key", "seq", "tombstone", "readable", "reason")


def _line_fold(spark, sf_dir, valid_only: bool) -> DataFrame:
    rows = scratch.settle(_versions(spark, sf_dir).where("readable"), "versions")
    valid = F.col("reason").isNull() if valid_only else None
    return fold.fold(rows, "key", F.col("seq"), F.col("tombstone"), ["seq"], valid).select("key", "seq", "pos")


@query(_LIVE + "SELECT key, seq, pos FROM folded")
def fold_lines(spark, sf_dir):
    return _line_fold(spark, sf_dir, True)


@query(_LIVE + "SELECT key, seq, pos FROM indexed")
def index_fold_lines(spark, sf_dir):
    return _line_fold(spark, sf_dir, False)


@query(_LIVE + "SELECT key, i.seq AS index_seq, f.seq AS fold_seq FROM indexed i FULL JOIN folded f USING (key) WHERE i.seq IS DISTINCT FROM f.seq")
def fold_vs_index_divergence(spark, sf_dir):
    rows = _versions(spark, sf_dir).where("readable")
    both = fold.last_versions(rows, "key", F.col("seq"), F.col("tombstone"), F.col("reason").isNull())
    return both.where(~F.col("readable_at").eqNullSafe(F.col("valid_at"))).select("key", F.col("readable_at").alias("index_seq"), F.col("valid_at").alias("fold_seq"))


@query(_LIVE + "SELECT (SELECT count(*) FROM folded) AS valid, (SELECT count(*) FROM c WHERE reason IS NOT NULL) AS bad")
def validate_summary(spark, sf_dir):
    return maintenance.validity(_versions(spark, sf_dir), "key", F.col("seq"))


_OFFSETS = _LINES + """, o AS (SELECT seq, raw, CAST(coalesce(sum(strlen(raw) + 1) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
  row_number() OVER (ORDER BY seq) AS line FROM l)
"""
BLOCK = 4096


def _offsets(spark, sf_dir) -> DataFrame:
    """Running sums by blocks of lines, groups of blocks, and the groups: no window meets all lines."""
    rows = logs.event_lines(spark, sf_dir).withColumn("b", F.expr(f"seq div {BLOCK}")).withColumn("n", F.octet_length("raw").cast("long") + 1)
    w = Window.partitionBy("b").orderBy("seq")
    blocks = rows.groupBy("b").agg(F.sum("n").alias("bytes"), F.count("*").alias("rows")).withColumn("c", F.expr(f"b div {BLOCK}"))
    # blocks within a group of BLOCK blocks, and then the groups: one row for each 16 million lines
    within, over = Window.partitionBy("c").orderBy("b"), Window.orderBy("c")
    groups = blocks.groupBy("c").agg(F.sum("bytes").alias("cb"), F.sum("rows").alias("cr"))
    groups = groups.select("c", (F.sum("cb").over(over) - F.col("cb")).alias("gb"), (F.sum("cr").over(over) - F.col("cr")).alias("gr"))
    blocks = blocks.withColumn("b0", F.sum("bytes").over(within) - F.col("bytes")).withColumn("l0", F.sum("rows").over(within) - F.col("rows"))
    blocks = blocks.join(groups, "c").select("b", (F.col("b0") + F.col("gb")).alias("b0"), (F.col("l0") + F.col("gr")).alias("l0"))
    rows = rows.withColumn("at", F.sum("n").over(w) - F.col("n")).withColumn("k", F.row_number().over(w)).join(blocks, "b")
    return rows.select("seq", "raw", (F.col("b0") + F.col("at")).alias("byte_offset"), (F.col("l0") + F.col("k")).cast("long").alias("line"))


@query(_OFFSETS + "SELECT seq, byte_offset, line FROM o")
def scan_offsets_lines(spark, sf_dir):
    return _offsets(spark, sf_dir).drop("raw")


@query(_OFFSETS + "SELECT seq, byte_offset FROM o WHERE byte_offset >= 100000")
def tail_scan_from_offset(spark, sf_dir):
    return _offsets(spark, sf_dir).where("byte_offset >= 100000").select("seq", "byte_offset")


@query(_FOLD_SQL + "SELECT * FROM folded")
def incremental_catchup(spark, sf_dir):
    """The fold of a prefix, kept as state, then caught up with the rest: equal to one fold."""
    from contractlog.streaming.incremental import caught_up

    rows = logs.events_log(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    half = rows.agg(F.expr("max(event_id) div 2").alias("h"))
    marked = rows.crossJoin(F.broadcast(half))  # one row
    early, late = (marked.where(c).drop("h") for c in ("event_id <= h", "event_id > h"))
    state = fold.fold(early, "user_id", F.col("event_id"), gone(), COLS).drop("last")
    return caught_up(state, late, "user_id", F.col("event_id"), gone(), COLS)


# ---- contracts over tables ----------------------------------------------------------------


def _rec(df: DataFrame, **cols) -> DataFrame:
    """The columns as a record, with the id column beside it."""
    return df.withColumn("rec", F.parse_json(F.to_json(F.struct(*(c.alias(n) for n, c in cols.items())), {"ignoreNullFields": "false"})))


def _issues(contract: Contract):
    return checks.settled(checks.issues(contract, F.col("rec")))


def _customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return _rec(c, id=F.col("c_custkey"), name=F.col("c_name"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"))


_CUSTOMER_ISSUES = r"""concat_ws('; ',
  CASE WHEN NOT regexp_matches(c_name, '^Customer#0*[0-9]*[02468]\z') THEN 'name: String should match pattern ''^Customer#0*[0-9]*[02468]$''' END,
  CASE WHEN c_acctbal < 0 THEN 'balance: Input should be greater than or equal to 0' END,
  CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 'segment: Input should be ''AUTOMOBILE'', ''BUILDING'', ''FURNITURE'' or ''MACHINERY''' END)"""


@query(f"SELECT * FROM (SELECT c_custkey, {_CUSTOMER_ISSUES} AS issues FROM customer) WHERE issues <> ''")
def validate_issues(spark, sf_dir):
    issues = _issues(parse_contract(logs.CUSTOMER_CONTRACT))
    return _customers(spark, sf_dir).select("c_custkey", issues.alias("issues")).where("issues <> ''")


@query(f"SELECT c_custkey, {_CUSTOMER_ISSUES} <> '' AS was_bad, c_acctbal < -500 AS is_bad FROM customer WHERE ({_CUSTOMER_ISSUES} <> '') <> (c_acctbal < -500)")
def contract_evolution_diff(spark, sf_dir):
    """Records that a looser contract judges otherwise than the one before."""
    old = parse_contract(logs.CUSTOMER_CONTRACT)
    new = parse_contract("fields: {id: int, name: str, balance: {type: float, ge: -500}, segment: str}")
    rows = _customers(spark, sf_dir).select("c_custkey", (_issues(old) != "").alias("was_bad"), (_issues(new) != "").alias("is_bad"))
    return rows.where("was_bad <> is_bad")


#: name -> (table, key, record column, contract field, SQL condition of a breach, message)
RULES = {
    "constraint_ge": ("customer", "c_custkey", "c_acctbal", "{type: float, ge: 0}", "c_acctbal < 0", "Input should be greater than or equal to 0"),
    "constraint_le": ("part", "p_partkey", "p_size", "{type: int, le: 40}", "p_size > 40", "Input should be less than or equal to 40"),
    "constraint_gt": ("part", "p_partkey", "p_retailprice", "{type: float, gt: 1000}", "p_retailprice <= 1000", "Input should be greater than 1000"),
    "constraint_lt": ("orders", "o_orderkey", "o_totalprice", "{type: float, lt: 200000}", "o_totalprice >= 200000", "Input should be less than 200000"),
    "constraint_multiple_of": ("part", "p_partkey", "p_size", "{type: int, multiple_of: 3}", "p_size % 3 <> 0", "Input should be a multiple of 3"),
    "constraint_min_length": ("documents", "doc_id", "text", "{type: str, min_length: 300}", "length(text) < 300", "String should have at least 300 characters"),
    "constraint_max_length": ("documents", "doc_id", "text", "{type: str, max_length: 3000}", "length(text) > 3000", "String should have at most 3000 characters"),
    "constraint_pattern": ("part", "p_partkey", "p_brand", "{type: str, pattern: '[1-3]$'}", r"NOT regexp_matches(p_brand, '[1-3]\z')", "String should match pattern '[1-3]$'"),
    "constraint_enum": ("orders", "o_orderkey", "o_orderstatus", "{type: enum, values: [O, F]}", "o_orderstatus NOT IN ('O', 'F')", "Input should be 'O' or 'F'"),
    "constraint_required": ("events", "event_id", "CASE WHEN event_type <> 'view' THEN event_type END", "str", "event_type = 'view'", "Field required"),
}


def _rule_query(name: str):
    source, key, column, spec, breach, message = RULES[name]

    def run(spark, sf_dir):
        contract = parse_contract(f"key: id\nfields:\n  id: int\n  x: {spec}\n")
        df = table(spark, sf_dir, source)
        absent_if_null = {"ignoreNullFields": "true"}
        rows = df.withColumn("rec", F.parse_json(F.to_json(F.struct(F.col(key).alias("id"), F.expr(column).alias("x")), absent_if_null)))
        return rows.select(key, _issues(contract).alias("issues")).where("issues <> ''")

    run.__name__ = name
    said = message.replace("'", "''")
    query(f"SELECT {key}, 'x: {said}' AS issues FROM {source} WHERE {breach}")(run)


for _name in RULES:
    _rule_query(_name)

#: name -> (kind, JSON text of the value by event_id n, in SQL; coerced value in SQL or NULL; message in SQL or NULL)
COERCIONS = {
    "coerce_int": (
        "int",
        "CASE n % 7 WHEN 0 THEN '' || n WHEN 1 THEN '\"' || n || '\"' WHEN 2 THEN n || '.0' WHEN 3 THEN n || '.5' WHEN 4 THEN 'true' WHEN 5 THEN '\"x' || n || '\"' ELSE '[1]' END",
        "CASE WHEN n % 7 < 3 THEN CAST(n AS VARCHAR) WHEN n % 7 = 4 THEN '1' END",
        "CASE n % 7 WHEN 3 THEN 'Input should be a valid integer, got a number with a fractional part' WHEN 5 THEN 'Input should be a valid integer, unable to parse string as an integer' WHEN 6 THEN 'Input should be a valid integer' END",
    ),
    "coerce_float": (
        "float",
        "CASE n % 5 WHEN 0 THEN '' || n WHEN 1 THEN '\"' || n || '.25\"' WHEN 2 THEN 'false' WHEN 3 THEN '\"1,5\"' ELSE '{}' END",
        "CASE n % 5 WHEN 0 THEN CAST(n AS VARCHAR) || '.00' WHEN 1 THEN n || '.25' WHEN 2 THEN '0.00' END",
        "CASE n % 5 WHEN 3 THEN 'Input should be a valid number, unable to parse string as a number' WHEN 4 THEN 'Input should be a valid number' END",
    ),
    "coerce_bool": (
        "bool",
        "CASE n % 7 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '\"Yes\"' WHEN 3 THEN '\"off\"' WHEN 4 THEN '2' WHEN 5 THEN '\"maybe\"' ELSE '[]' END",
        "CASE n % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END",
        "CASE WHEN n % 7 IN (4, 5) THEN 'Input should be a valid boolean, unable to interpret input' WHEN n % 7 = 6 THEN 'Input should be a valid boolean' END",
    ),
    "coerce_date": (
        "date",
        "CASE n % 4 WHEN 0 THEN '\"2024-02-29\"' WHEN 1 THEN '\"2023-02-29\"' WHEN 2 THEN '\"2024-1-05\"' ELSE '\"2024-0' || (1 + n % 9) || '-05\"' END",
        "CASE n % 4 WHEN 0 THEN '2024-02-29' WHEN 3 THEN '2024-0' || (1 + n % 9) || '-05' END",
        "CASE WHEN n % 4 IN (1, 2) THEN 'Input should be a valid date' END",
    ),
    "coerce_datetime": (
        "datetime",
        "CASE n % 6 WHEN 0 THEN '\"2026-08-30T10:11:12+02:00\"' WHEN 1 THEN '\"2026-08-30 10:11\"' WHEN 2 THEN '\"2026-08-30\"' WHEN 3 THEN '86400' WHEN 4 THEN 'true' ELSE '\"2026-13-01T00:00:00\"' END",
        "CASE n % 6 WHEN 0 THEN '2026-08-30T10:11:12+02:00' WHEN 1 THEN '2026-08-30T10:11:00' WHEN 2 THEN '2026-08-30T00:00:00' WHEN 3 THEN '1970-01-02T00:00:00Z' END",
        "CASE WHEN n % 6 > 3 THEN 'Input should be a valid datetime' END",
    ),
    "coerce_time": (
        "time",
        "CASE n % 5 WHEN 0 THEN '\"10:11:12\"' WHEN 1 THEN '\"10:11\"' WHEN 2 THEN '\"25:00\"' WHEN 3 THEN '3661' ELSE '\"x\"' END",
        "CASE n % 5 WHEN 0 THEN '10:11:12' WHEN 1 THEN '10:11:00' WHEN 3 THEN '01:01:01Z' END",
        "CASE WHEN n % 5 IN (2, 4) THEN 'Input should be in a valid time format' END",
    ),
    "coerce_uuid": (
        "uuid",
        "CASE n % 3 WHEN 0 THEN '\"' || upper(md5('' || n)) || '\"' WHEN 1 THEN '\"' || md5('' || n) || 'f\"' ELSE '' || n END",
        "CASE WHEN n % 3 = 0 THEN concat_ws('-', substr(md5('' || n), 1, 8), substr(md5('' || n), 9, 4), substr(md5('' || n), 13, 4), substr(md5('' || n), 17, 4), substr(md5('' || n), 21, 12)) END",
        "CASE WHEN n % 3 > 0 THEN 'Input should be a valid UUID' END",
    ),
    "coerce_email": (
        "email",
        "CASE n % 4 WHEN 0 THEN '\"u' || n || '@example.com\"' WHEN 1 THEN '\"u' || n || '@\"' WHEN 2 THEN '\"u..v@example.com\"' ELSE '' || n END",
        "CASE WHEN n % 4 = 0 THEN 'u' || n || '@example.com' END",
        "CASE WHEN n % 4 IN (1, 2) THEN 'value is not a valid email address' WHEN n % 4 = 3 THEN 'Input should be a valid string' END",
    ),
}


def _coercion_query(name: str):
    kind, given, value, message = COERCIONS[name]

    def run(spark, sf_dir):
        rows = logs.events_log(spark, sf_dir).select(F.col("event_id").alias("n")).select("n", F.parse_json(F.expr(given)).alias("v"))
        x, said = checks.typed(Kind(kind), F.col("v"))
        shown = x.cast("decimal(20,2)") if kind == "float" else x
        return rows.select("n", shown.cast("string").alias("x"), said.alias("message")).select("n", F.when(F.col("message").isNull(), F.col("x")).alias("x"), "message")

    run.__name__ = name
    query(f"SELECT n, {value} AS x, {message} AS message FROM (SELECT event_id AS n FROM events)")(run)


for _name in COERCIONS:
    _coercion_query(_name)


def _event_variants(spark, sf_dir, given: str) -> DataFrame:
    rows = logs.events_log(spark, sf_dir).select(F.col("event_id").alias("n"), "props")
    return rows.select("n", F.parse_json(F.expr(given)).alias("rec"))


_ROLE = "CASE n % 3 WHEN 0 THEN '{\"id\":1}' WHEN 1 THEN '{\"id\":1,\"role\":null}' ELSE '{\"id\":1,\"role\":\"r' || n || '\"}' END"


@query("SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN 'member' WHEN 2 THEN 'r' || event_id END AS role FROM events")
def default_materialise(spark, sf_dir):
    c = parse_contract("fields: {id: int, role: {type: str, default: member}}")
    return _event_variants(spark, sf_dir, _ROLE).select("n", checks.values(c, F.col("rec"))["role"].alias("role"))


@query("SELECT event_id AS n, CASE WHEN event_id % 3 = 1 THEN 'role: Input should be a valid string' ELSE '' END AS with_default, '' AS optional FROM events")
def null_vs_absent(spark, sf_dir):
    a = parse_contract("fields: {id: int, role: {type: str, default: member}}")
    b = parse_contract("fields: {id: int, role: {type: str, required: false}}")
    return _event_variants(spark, sf_dir, _ROLE).select("n", _issues(a).alias("with_default"), _issues(b).alias("optional"))


@query(
    """SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'tags.1: Input should be a valid integer, unable to parse string as an integer'
ELSE 'tags: Input should be a valid list' END AS issues FROM events"""
)
def list_items_check(spark, sf_dir):
    given = "CASE n % 3 WHEN 0 THEN '{\"id\":1,\"tags\":[1,\"2\"]}' WHEN 1 THEN '{\"id\":1,\"tags\":[' || n || ',\"x\"]}' ELSE '{\"id\":1,\"tags\":\"x\"}' END"
    c = parse_contract("fields: {id: int, tags: {type: list, items: int}}")
    return _event_variants(spark, sf_dir, given).select("n", _issues(c).alias("issues"))


@query("SELECT event_id AS n, CASE event_id % 2 WHEN 0 THEN '' ELSE 'meta: Input should be a valid dictionary' END AS issues FROM events")
def dict_object_check(spark, sf_dir):
    given = "CASE n % 2 WHEN 0 THEN '{\"id\":1,\"meta\":' || props || '}' ELSE '{\"id\":1,\"meta\":[' || n || ']}' END"
    c = parse_contract("fields: {id: int, meta: dict}")
    return _event_variants(spark, sf_dir, given).select("n", _issues(c).alias("issues"))


_EXTRA = "'{\"id\":' || n || ',\"k2\":' || props || ',\"a\":null}'"


def _extra(policy: str) -> Contract:
    return parse_contract(f"extra: {policy}\nfields: {{id: int}}\n")


@query("SELECT event_id AS n, 'a: Extra inputs are not permitted; k2: Extra inputs are not permitted' AS issues FROM events")
def extra_forbid(spark, sf_dir):
    return _event_variants(spark, sf_dir, _EXTRA).select("n", _issues(_extra("forbid")).alias("issues"))


@query("SELECT event_id AS n, '' AS issues, '{\"id\":' || event_id || '}' AS record FROM events")
def extra_ignore(spark, sf_dir):
    c = _extra("ignore")
    return _event_variants(spark, sf_dir, _EXTRA).select("n", _issues(c).alias("issues"), checks.canonical(c, F.col("rec")).alias("record"))


@query("SELECT event_id AS n, '' AS issues, '{\"id\":' || event_id || ',\"a\":null,\"k2\":' || replace(props, ' ', '') || '}' AS record FROM events")
def extra_allow(spark, sf_dir):
    c = _extra("allow")
    return _event_variants(spark, sf_dir, _EXTRA).select("n", _issues(c).alias("issues"), checks.canonical(c, F.col("rec")).alias("record"))


# ---- writes -------------------------------------------------------------------------------

#: The events after the middle of the log are a batch that meets the fold of those before it.
_BATCH = """WITH h AS (SELECT max(event_id) // 2 AS h FROM events),
old AS (SELECT user_id, arg_max(event_type, event_id) AS body FROM events, h WHERE event_id <= h AND event_type <> 'error' GROUP BY user_id),
new AS (SELECT event_id AS seq, user_id, event_type AS body FROM events, h WHERE event_id > h),
met AS (SELECT n.*, o.body AS now, lag(n.body) OVER (PARTITION BY n.user_id, n.body = 'signup' ORDER BY seq) AS before FROM new n LEFT JOIN old o USING (user_id)),
ops AS (SELECT seq, user_id, body, CASE WHEN body = 'signup' THEN 'rejected' WHEN coalesce(before, now) IS NULL THEN 'created' WHEN coalesce(before, now) = body THEN 'unchanged' ELSE 'updated' END AS op FROM met)
"""


def _upserted(spark, sf_dir) -> DataFrame:
    rows = logs.events_log(spark, sf_dir).crossJoin(F.broadcast(logs.events_log(spark, sf_dir).agg(F.expr("max(event_id) div 2").alias("h"))))
    live = rows.where("event_id <= h and event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("body"))
    batch = rows.where("event_id > h").select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("body"))
    batch = batch.withColumn("issues", F.when(F.col("body") == "signup", "no signups here").otherwise(""))
    return changes.upserts(batch, live, "user_id", "seq", "body", "issues").drop("issues")


@query(_BATCH + "SELECT * FROM ops")
def upsert_classify(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query(_BATCH + "SELECT user_id, op, count(*) AS n, min(seq) AS first FROM ops GROUP BY ALL")
def upsert_batch_sequence(spark, sf_dir):
    return _upserted(spark, sf_dir).groupBy("user_id", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query(_BATCH + "SELECT count(*) FILTER (op IN ('created', 'updated')) AS written, count(*) FILTER (op = 'rejected') AS rejected, count(*) FILTER (op = 'unchanged') AS unchanged FROM ops")
def put_counts(spark, sf_dir):
    return changes.counts(_upserted(spark, sf_dir))


@query("SELECT event_id AS n, 'set' AS kind, CAST(k AS VARCHAR) AS k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def set_overrides_merge(spark, sf_dir):
    """Each record under an override of one field: the override wins, the rest stays."""
    given = F.from_json(F.col("props"), "map<string,string>")
    over = F.create_map(F.lit("kind"), F.lit("set"))
    plain = F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key(over, k)), over)
    return logs.events_log(spark, sf_dir).select(F.col("event_id").alias("n"), plain["kind"].alias("kind"), plain["k"].alias("k"))


@query(
    """WITH live AS (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) WHERE t <> 'error'),
ids AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT c_custkey FROM customer)
SELECT user_id, CASE WHEN l.user_id IS NOT NULL AND k = 1 THEN 'deleted' ELSE 'absent' END AS op
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) AS k FROM ids) LEFT JOIN live l USING (user_id)"""
)
def delete_classify(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    live = fold.live_keys(logs.events_log(spark, sf_dir), "user_id", F.col("event_id"), gone())
    return changes.deletes(c.unionAll(c), live, "user_id")


# ---- maintenance --------------------------------------------------------------------------


@query(_LIVE + "SELECT f.key, f.pos, '{\"user_id\":' || f.key || ',\"seq\":' || f.seq || ',\"kind\":\"' || json_extract_string(raw, '$.kind') || '\",\"props\":' || replace(json_extract_string(raw, '$.props'), ' ', '') || ',\"note\":\"none\"}' AS record FROM folded f JOIN c USING (seq)")
def compact_result(spark, sf_dir):
    """What compaction writes: canonical records with their defaults, in order of pos."""
    rows = _lines(spark, sf_dir, record=True).where("readable").select("key", "seq", "tombstone", "reason", "record")
    rows = scratch.settle(rows, "compact")
    return fold.fold(rows, "key", F.col("seq"), F.col("tombstone"), ["record"], F.col("reason").isNull()).select("key", "pos", "record")


@query(_LIVE + """, w AS (SELECT sum(strlen('{"user_id":' || f.key || ',"seq":' || f.seq || ',"kind":"' || json_extract_string(raw, '$.kind') || '","props":' || replace(json_extract_string(raw, '$.props'), ' ', '') || ',"note":"none"}') + 1) AS after FROM folded f JOIN c USING (seq))
SELECT CAST((SELECT sum(strlen(raw) + 1) FROM l) - after AS BIGINT) AS reclaimed_bytes FROM w""")
def compact_reclaimed_bytes(spark, sf_dir):
    before = logs.event_lines(spark, sf_dir).agg(F.sum(F.octet_length("raw") + 1).alias("b"))
    after = compact_result(spark, sf_dir).agg(F.coalesce(F.sum(F.octet_length("record") + 1), F.lit(0)).alias("a"))
    return before.crossJoin(after).select((F.col("b") - F.col("a")).cast("long").alias("reclaimed_bytes"))  # a row each


@query(_LIVE + "SELECT 'bad' AS side, seq FROM c WHERE reason IS NOT NULL UNION ALL SELECT 'kept', seq FROM folded")
def repair_split(spark, sf_dir):
    # what a line is gets settled once, by writing it; both sides read that
    rows = scratch.settle(_versions(spark, sf_dir), "repair")
    kept = fold.fold(rows.where("readable"), "key", F.col("seq"), F.col("tombstone"), ["seq"], F.col("reason").isNull())
    return rows.where("reason is not null").select(F.lit("bad").alias("side"), "seq").unionAll(kept.select(F.lit("kept"), "seq"))


_DAYS = "SELECT seq // 1000 AS segment, seq, raw FROM l"


@query(_LINES + f"""SELECT segment, count(*) FILTER (trim(raw) <> '') AS records, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes,
sha256(string_agg(raw, chr(10) ORDER BY seq) || chr(10)) AS sha256 FROM ({_DAYS}) GROUP BY segment""")
def segment_stats(spark, sf_dir):
    lines = logs.event_lines(spark, sf_dir).withColumn("segment", F.expr("seq div 1000"))
    return maintenance.segment_stats(lines, ["segment"], "seq", "raw").withColumn("bytes", F.col("bytes").cast("long"))


@query("""SELECT strftime(ts, '%Y%m%dT000000Z') AS stamp, count(*) AS records, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1""")
def segment_manifest_by_day(spark, sf_dir):
    e = logs.events_log(spark, sf_dir)
    return e.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyyMMdd'T'HHmmss'Z'").alias("stamp")).agg(F.count("*").alias("records"), F.sum(F.octet_length("props") + 1).cast("long").alias("bytes"))


_SIZES = ["7", "0", "300 b", "3K", "20 kb", "0.25MB", "1.75g", "8 Gb", "  12 m  ", "", " ", "kb", "9PB", "+4", "ten", "5 k b", ".5m", "4.", "1e3"]


@query(
    "SELECT given, CASE WHEN n <> '' AND f IS NOT NULL THEN CAST(floor(CAST(n AS DOUBLE) * f) AS BIGINT) END AS bytes, coalesce(CASE WHEN n <> '' THEN CAST(n AS DOUBLE) * f END, 0) >= 1 AS rolls FROM (SELECT given, regexp_extract(given, '^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([A-Za-z]*)\\s*$', 1) AS n, CASE lower(regexp_extract(given, '^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([A-Za-z]*)\\s*$', 2)) WHEN '' THEN 1 WHEN 'b' THEN 1 WHEN 'k' THEN 1024 WHEN 'kb' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'mb' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 'gb' THEN 1073741824 END AS f FROM (VALUES "
    + ", ".join(f"('{s}')" for s in _SIZES)
    + ") v(given))"
)
def roll_threshold(spark, sf_dir):
    df = spark.createDataFrame([(s,) for s in _SIZES], "given string").withColumn("bytes", text.size_of(F.col("given")))
    return df.withColumn("rolls", F.coalesce(F.col("bytes") >= 1, F.lit(False)))


# ---- cells --------------------------------------------------------------------------------

_ESC = "replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_QUOTED = r"""({x} = '' OR {x} IN ('true', 'false', 'null') OR regexp_matches({x}, '^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z') OR regexp_matches({x}, '[:"\\\[\]{{}},\x00-\x1F]|^[ \t]|[ \t]\z|^[-#]'))"""


@query(f"SELECT doc_id, {_ESC.format(x='text')} AS cell FROM documents")
def toon_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escaped(F.col("text")).alias("cell"))


@query(f"SELECT doc_id, {_QUOTED.format(x='text')} AS quoted, {_QUOTED.format(x='lang')} AS lang_quoted FROM documents")
def toon_needs_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.needs_quotes(F.col("text")).alias("quoted"), text.needs_quotes(F.col("lang")).alias("lang_quoted"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END AS discount FROM lineitem")
def toon_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.number(F.col("l_quantity")).alias("quantity"), text.number(F.col("l_discount")).alias("discount")
    )


#: A cell by event_id n, and how it must be written: bare or quoted.
_CELLS = [
    ("'+' || n", "quoted"), ("'-' || n || 'e5'", "quoted"), ("n || '.'", "bare"), ("'a-' || n", "bare"), ("''", "quoted"), ("' x' || n", "quoted"), ("'k' || n || ': v'", "quoted"),
    ("'null'", "quoted"), ("'# ' || n", "quoted"), ("'plain ' || n", "bare"), ("n || '.5E+' || n", "quoted"), ("'x' || n || ' '", "quoted"), ("'[' || n", "quoted"), ("'e' || n", "bare"), ("'1-' || n", "bare"),
]
_GIVEN = "CASE n % {k} {w} END".format(k=len(_CELLS), w=" ".join(f"WHEN {k} THEN {x}" for k, (x, _) in enumerate(_CELLS)))
_BARE = ", ".join(str(k) for k, (_, how) in enumerate(_CELLS) if how == "bare")


@query(f"SELECT n, CASE WHEN n % {len(_CELLS)} IN ({_BARE}) THEN x ELSE '\"' || x || '\"' END AS cell FROM (SELECT n, {_GIVEN} AS x FROM (SELECT event_id AS n FROM events))")
def toon_cells(spark, sf_dir):
    given = logs.events_log(spark, sf_dir).select(F.col("event_id").alias("n")).withColumn("x", F.expr(_GIVEN))
    return given.select("n", text.cell(F.col("x")).alias("cell"))


@query(
    """SELECT n, CASE WHEN x = round(x) AND abs(x) < 1e16 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS cell
FROM (SELECT event_id AS n, CAST((event_id % 997 - 300) || 'e' || (event_id % 61 - 30) AS DOUBLE) AS x FROM events)"""
)
def toon_number_magnitudes(spark, sf_dir):
    x = F.concat((F.col("event_id") % 997 - 300).cast("string"), F.lit("e"), (F.col("event_id") % 61 - 30).cast("string")).cast("double")
    return logs.events_log(spark, sf_dir).select(F.col("event_id").alias("n"), text.number(x).alias("cell"))


@query(
    f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN {_QUOTED.format(x='o_orderpriority')} THEN '\"' || {_ESC.format(x='o_orderpriority')} || '\"' ELSE o_orderpriority END || ',null' AS line FROM orders"
)
def toon_row(spark, sf_dir):
    cells = [F.col("o_orderkey").cast("string"), text.cell(F.col("o_orderpriority")), text.cell(F.lit(None).cast("string"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", text.row(*cells).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS cell FROM documents")
def truncate_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), text.CELL).alias("cell"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END AS detail, length(text) AS full_length FROM documents")
def truncate_detail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), text.DETAIL).alias("detail"), F.char_length("text").cast("long").alias("full_length"))


@query("SELECT event_id, replace(props, ' ', '') AS cell FROM events")
def nonscalar_cell_json(spark, sf_dir):
    return logs.events_log(spark, sf_dir).select("event_id", F.to_json(F.parse_json("props")).alias("cell"))


# ---- stores -------------------------------------------------------------------------------

_NATIONS = "key: n\nfields: {n: int, name: str, region: int}\n"


def _shared(spark, what: str) -> str:
    path = f"{scratch.shared_dir(spark).removeprefix('file://').removeprefix('file:')}/contractlog/{what}-{uuid.uuid4().hex}"
    os.makedirs(path)
    scratch.drop_at_exit(spark, path)
    return path


def _nation_lines(spark, sf_dir) -> dict:
    """region -> its nations as lines of JSON, by key: 25 nations at any size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_regionkey", F.lower("r_name").alias("r")).orderBy("n_nationkey").collect()
    out: dict = {}
    for x in rows:
        out.setdefault(x.r, []).append(json.dumps({"n": x.n_nationkey, "name": x.n_name, "region": x.r_regionkey}, separators=(",", ":")))
    return out


@query("SELECT replace(lower(r_name), ' ', '-') || '.jsonl' AS file, 'schema-' || replace(lower(r_name), ' ', '-') || '.yaml' AS contract, count(*) AS records FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def discover_stores(spark, sf_dir):
    """A store for each region, found with its contract and the number of its live keys."""
    folder = _shared(spark, "stores")
    for region, lines in _nation_lines(spark, sf_dir).items():
        stem = f"{folder}/{region.replace(' ', '-')}"
        with open(f"{stem}.jsonl", "w") as f:
            f.write("".join(f"{x}\n" for x in lines))
        with open(f"{folder}/schema-{os.path.basename(stem)}.yaml", "w") as f:
            f.write(_NATIONS)
    found, _ = present.discover(folder, count=lambda path, contract: open_store(spark, path, contract).count())
    return spark.createDataFrame([(x["file"], x["contract"], x["records"]) for x in found], "file string, contract string, records long")


@query(
    """SELECT count(*) AS records, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY n_nationkey)) AS sha256, true AS ok
FROM (SELECT n_nationkey, '{"n":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' AS line FROM nation)"""
)
def manifest_list(spark, sf_dir):
    """A log that is sealed, listed by its archive's manifest and held against it."""
    path = f"{_shared(spark, 'rolled')}/nations.jsonl"
    lines = sorted((x for xs in _nation_lines(spark, sf_dir).values() for x in xs), key=lambda x: json.loads(x)["n"])
    with open(path, "w") as f:
        f.write("".join(f"{x}\n" for x in lines))
    store = open_store(spark, path, parse_contract(_NATIONS))
    store.roll()
    ok = {x["segment"]: x["ok"] for x in store.audit()}
    rows = [json.loads(r.record) for r in store.manifest().live().collect()]  # a row for each segment
    return spark.createDataFrame([(r["records"], r["bytes"], r["sha256"], ok[r["segment"]]) for r in rows], "records long, bytes long, sha256 string, ok boolean")


# ---- reports of contracts -----------------------------------------------------------------


@query(
    """SELECT * FROM (VALUES (0, 'user_id', 'int', true, 'ge=0'), (1, 'seq', 'int', true, ''), (2, 'kind', 'enum[click,error,purchase,signup,view]', true, ''),
(3, 'props', 'dict', false, ''), (4, 'note', 'str', false, 'max_length=8')) v(place, field, type, required, rules)"""
)
def schema_summary(spark, sf_dir):
    rows = [(k, *x) for k, x in enumerate(logs.event_contract().summary())]
    return spark.createDataFrame(rows, "place int, field string, type string, required boolean, rules string")


@query("SELECT * FROM (VALUES (0, 'user_id'), (1, 'seq'), (2, 'kind'), (3, 'note')) v(place, field)")
def default_fields(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(logs.event_contract().default_fields())), "place int, field string")


__all__ = ["Field", "oracle_sql", "queries"]
