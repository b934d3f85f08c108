"""Tables of the test data seen as logs.

``events_log``: the events in order of event_id, keyed by user, where an error is a
tombstone. ``event_lines``: the same as JSON lines, some of them damaged by rule; SQL builds
the identical text in EVENT_LINES_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlog.contract import parse_contract

EVENT_CONTRACT = """
name: Event
key: user_id
extra: forbid
fields:
  user_id: {type: int, ge: 0}
  seq: int
  kind: {type: enum, values: [click, error, purchase, signup, view]}
  props: {type: dict, default: {}}
  note: {type: str, default: none, max_length: 8}
"""

CUSTOMER_CONTRACT = """
name: Customer
key: id
fields:
  id: int
  name: {type: str, pattern: '^Customer#0*[0-9]*[02468]$'}
  balance: {type: float, ge: 0}
  segment: {type: enum, values: [AUTOMOBILE, BUILDING, FURNITURE, MACHINERY]}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over as many tasks as there are cores at least: a small file is one split, and its lines cost work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def event_contract():
    return parse_contract(EVENT_CONTRACT)


#: One line of each event; {m}: event_id modulo 97. Both engines concatenate the same parts.
_LINE = [
    ("= 3", "'{{\"user_id\":' || {user} || ',\"seq\":' || {seq} || ',\"ki'"),
    ("= 5", "'{{\"seq\":' || {seq} || ',\"kind\":\"' || kind || '\"}}'"),
    ("= 7", "'{{\"user_id\":-' || {user} || ',\"seq\":\"' || {seq} || 'x\",\"kind\":\"' || kind || '\"}}'"),
    ("= 11", "'  '"),
    ("= 13", "'{{\"user_id\":' || {user} || ',\"seq\":' || {seq} || ',\"kind\":\"' || kind || '\",\"zip\":1,\"note\":null}}'"),
    ("= 17", "'{{\"user_id\":' || {user} || ',\"seq\":' || {seq} || ',\"kind\":\"' || kind || '\",\"note\":\"far too long\"}}'"),
]
_TOMB = "'{{\"user_id\":' || {user} || ',\"_deleted\":true}}'"
_GOOD = "'{{\"user_id\":' || {user} || ',\"seq\":' || {seq} || ',\"kind\":\"' || kind || '\",\"props\":' || props || '}}'"


def _case(user: str, seq: str) -> str:
    whens = "".join(f" when m {m} then " + text.format(user=user, seq=seq) for m, text in _LINE)
    return f"case{whens} when kind = 'error' then {_TOMB.format(user=user, seq=seq)} else {_GOOD.format(user=user, seq=seq)} end"


EVENT_LINES_SQL = (
    "SELECT seq, " + _case("CAST(user_id AS VARCHAR)", "CAST(seq AS VARCHAR)") + " AS raw FROM"
    " (SELECT event_id AS seq, user_id, event_type AS kind, props, event_id % 97 AS m FROM events)"
)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, raw, torn) of every event; seq orders the lines."""
    rows = events_log(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("kind"), "props", (F.col("event_id") % 97).alias("m")
    )
    return rows.select("seq", F.expr(_case("cast(user_id as string)", "cast(seq as string)")).alias("raw"), F.lit(False).alias("torn"))
