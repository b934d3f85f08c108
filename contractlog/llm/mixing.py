"""Mixing sources to target weights: temperature mixing (DataFrame functions only).

A source with share p of all tokens gets weight ``p ** a / sum(p ** a)``. The exponent a is
bisected in [0, 1]: the largest for which the weights' entropy is at least ``entropy`` times
that of equal weights, and, if that would repeat some source more than ``repeats`` times, the
least that keeps to ``repeats`` (a = 1 repeats all sources alike).

The weights are realised as a block permutation with a budget. A document's block is one of
BLOCKS, by a hash of its id; in each epoch the blocks of a source follow each other in an
order of their own, and the documents in a block likewise. A source is run through whole
epochs and then through blocks until its quota of tokens is met: the last document taken is
the one that reaches it. Where the running sum ends is found from block totals (at most
BLOCKS rows a source) and then inside one block, so no window ever meets all rows of a
source. What is left for each document is a comparison with three values of its source.

Tokens are words ([^\\x20\\x09-\\x0D]+). A null source is a source of its own. A null text has
no tokens; sources without any token get no weight. Documents without tokens go where their
place in the order puts them. Rows that repeat an id share its place, all or none are taken;
a null id is hashed like an empty one. An empty table gives an empty mixture. Other columns
stay as they are in ``mix``, whatever they are called, and are ignored in ``plan``.

A plan has one row a source and is written to the shared folder. Documents meet it by a
broadcast while it has at most MOST_SOURCES rows; with more sources, by a join in which each
source is dealt out to SALTS tasks, so that a source with a third of all rows isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlog.llm.common import Scratch

#: Share of the greatest entropy that the weights must have; times that a source may be repeated; seed of all orders.
ENTROPY, REPEATS, SEED = 0.98, 4.0, "mix-1"
BISECTIONS = 60
#: Blocks of a source: three hexadecimal digits.
BLOCK_DIGITS = 3
NULL_SOURCE = "\u0000null"
#: Rows of a plan that are broadcast at most (some 100 bytes each); tasks that share a source beyond that.
MOST_SOURCES, SALTS = 50_000, 64


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, tokens) of every row, written once: texts are read no more than that."""
    rows = docs.select(named(id_col), named(source_col), tokens(named(text_col)).alias("tokens"))
    return Scratch(docs.sparkSession, "counted").write(rows, "tokens")


def _placed(docs: DataFrame, id_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """_source, _block, _spelt (the id, by which documents are ordered) and what else is asked for."""
    spelt = F.coalesce(named(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(named(source_col).cast("string"), F.lit(NULL_SOURCE)).alias("_source"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}/"), spelt)), 1, BLOCK_DIGITS).alias("_block"),
        spelt.alias("_spelt"),
        *more,
    )


def block_order(source: Column, block: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), epoch.cast("string"), source, block))


def row_order(spelt: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), epoch.cast("string"), spelt))


def weights(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """totals(_source, _tokens) with exponent, weight, quota (tokens) and epochs, rest of the quota.

    budget: tokens of the mixture, by default as many as there are; never over repeats times that.
    """
    some = totals.where("_tokens > 0")
    # one number for each source: sources are few beside documents
    one = some.agg(F.sort_array(F.collect_list(F.col("_tokens").cast("double"))).alias("ts"), F.sum("_tokens").cast("double").alias("total"))
    least = f"least({float(budget)!r}D, {float(repeats)!r}D * total)" if budget is not None else f"least(total, {float(repeats)!r}D * total)"
    power = "aggregate(ps, 0D, (z, p) -> z + pow(p, {a}))"
    h = f"(ln({power}) - {{a}} * aggregate(ps, 0D, (z, p) -> z + pow(p, {{a}}) * ln(p)) / {power})"
    rep = f"(budget / total * pow(array_min(ps), {{a}} - 1D) / {power})"

    def bisected(holds: str, low: str, high: str) -> str:
        """The end of the bisection of holds(mid), whose truth moves the bound named first."""
        mid = "((s.lo + s.hi) / 2D)"
        test = holds.format(a=mid)
        return (
            f"aggregate(sequence(1, {BISECTIONS}), named_struct('lo', 0D, 'hi', 1D), (s, i) ->"
            f" named_struct('lo', if({test}, {low}, s.lo), 'hi', if({test}, s.hi, {high})))"
        ).replace("MID", mid)

    by_entropy = bisected(f"{h} >= {float(entropy)!r}D * ln(size(ps))", "MID", "MID")
    by_repeats = bisected(f"{rep} > {float(repeats)!r}D", "MID", "MID")
    one = one.select(F.expr("transform(ts, t -> t / total)").alias("ps"), "total", F.expr(least).alias("budget"))
    one = one.select(
        "ps", "total", "budget",
        F.expr(f"if({h.format(a='1D')} >= {float(entropy)!r}D * ln(size(ps)), 1D, ({by_entropy}).lo)").alias("ea"),
        F.expr(f"if({rep.format(a='0D')} <= {float(repeats)!r}D, 0D, ({by_repeats}).hi)").alias("ra"),
    ).withColumn("exponent", F.greatest("ea", "ra"))
    one = one.withColumn("z", F.expr(power.format(a="exponent")))
    made = some.crossJoin(F.broadcast(one.drop("ps", "ea", "ra")))  # one row
    return made.select(
        "_source", "_tokens", "exponent", F.expr("pow(_tokens / total, exponent) / z").alias("weight"), "budget"
    ).withColumn("quota", F.col("weight") * F.col("budget")).withColumn(
        "epochs", F.floor(F.col("quota") / F.col("_tokens") + 1e-9).cast("long")
    ).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("_tokens")))


def plan(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """One row per source with tokens: its weight, epochs, and where the partial epoch ends.

    Columns: _source, tokens, exponent, weight, quota, epochs, cut_block, cut_row. In the
    partial epoch the blocks before cut_block are taken whole, and of that block the rows up
    to cut_row; both are null if the epochs meet the quota. tokens_col: a column that holds
    the token counts already; otherwise they are counted in text_col.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    size = named(tokens_col) if tokens_col else tokens(named(text_col))
    rows = _placed(docs, id_col, source_col, seed, size.alias("_tokens"))
    rows = scratch.write(rows, "placed")  # read three times below
    blocks = rows.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_tokens"))
    blocks = scratch.write(blocks, "blocks")
    wanted = weights(blocks.groupBy("_source").agg(F.sum("_tokens").alias("_tokens")), entropy, repeats, budget)
    goal = wanted.select("_source", "epochs", "rest").where("rest > 0.5")
    ranked = blocks.join(goal, "_source").withColumn("_at", block_order(F.col("_source"), F.col("_block"), F.col("epochs"), seed))
    w = Window.partitionBy("_source").orderBy("_at")
    ranked = ranked.withColumn("_before", F.sum("_tokens").over(w) - F.col("_tokens")).where("_before < rest")
    cut = ranked.groupBy("_source").agg(F.max_by(F.struct("_block", F.col("_at").alias("cut_block"), "_before"), "_at").alias("c"))
    cut = cut.join(goal, "_source").select("_source", "c._block", "c.cut_block", "c._before", "epochs", "rest")
    inside = rows.join(cut, ["_source", "_block"]).withColumn("_row", row_order(F.col("_spelt"), F.col("epochs"), seed))
    # rows that repeat an id have one place
    inside = inside.groupBy("_source", "_row", "cut_block", "_before", "rest").agg(F.sum("_tokens").alias("_tokens"))
    v = Window.partitionBy("_source").orderBy("_row")
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_tokens").over(v) - F.col("_tokens")).where("_upto < rest")
    ends = inside.groupBy("_source").agg(F.first("cut_block").alias("cut_block"), F.max("_row").alias("cut_row"))
    made = wanted.join(ends, "_source", "left").select(
        "_source", F.col("_tokens").alias("tokens"), "exponent", "weight", "quota", "epochs", "cut_block", "cut_row"
    )
    made = scratch.write(made, "plan")
    scratch.forget("placed")
    return made


def _copies(docs: DataFrame, plans: DataFrame, seed: str, id_col: str, source_col: str, *more: Column) -> DataFrame:
    """_placed rows that are taken, with _copies."""
    placed = _placed(docs, id_col, source_col, seed, *more)
    p = plans.select("_source", F.col("epochs").alias("_epochs"), F.col("cut_block").alias("_cb"), F.col("cut_row").alias("_cr"))
    if plans.count() <= MOST_SOURCES:
        met = placed.join(F.broadcast(p), "_source")
    else:
        p = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = placed.withColumn("_salt", F.pmod(F.xxhash64("_spelt"), F.lit(SALTS)).cast("int")).join(p, ["_source", "_salt"])
    at = block_order(F.col("_source"), F.col("_block"), F.col("_epochs"), seed)
    row = row_order(F.col("_spelt"), F.col("_epochs"), seed)
    taken = F.coalesce((at < F.col("_cb")) | ((at == F.col("_cb")) & (row <= F.col("_cr"))), F.lit(False))
    return met.withColumn("_copies", F.col("_epochs") + taken.cast("long")).where("_copies > 0")


def occurrences(docs: DataFrame, plans: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """One row for each time a document is taken: id, source, tokens, epoch, block_at, row_at.

    Ordered by (epoch, block_at, row_at), a source's rows are its permutation of that epoch.
    tokens_col: as in plan().
    """
    size = named(tokens_col) if tokens_col else tokens(named(text_col))
    took = _copies(docs, plans, seed, id_col, source_col, named(id_col).alias("_id"), named(source_col).alias("_given"), size.alias("_tokens"))
    each = took.withColumn("epoch", F.explode(F.expr("sequence(0L, _copies - 1)")))
    return each.select(
        F.col("_id").alias(id_col), F.col("_given").alias(source_col), F.col("_tokens").alias("tokens"), "epoch",
        block_order(F.col("_source"), F.col("_block"), F.col("epoch"), seed).alias("block_at"),
        row_order(F.col("_spelt"), F.col("epoch"), seed).alias("row_at"),
    )


def mix(docs: DataFrame, plans: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mixture takes them, all columns as they were."""
    took = _copies(docs, plans, seed, id_col, source_col, F.struct(*(named(c) for c in docs.columns)).alias("_row"))
    each = took.select("_row", F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"))
    return each.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


OCCURRENCES_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s, CAST(len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
    coalesce(CAST(doc_id AS VARCHAR), '') AS spelt, substr(md5('SEED/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS block FROM documents),
totals AS (SELECT s, CAST(sum(tokens) AS DOUBLE) AS t FROM rows GROUP BY s HAVING sum(tokens) > 0),
one AS (SELECT sum(t) AS total, count(*) AS k, min(t) / sum(t) AS least FROM totals),
ps AS (SELECT list(t / total ORDER BY t) AS p FROM totals, one),
bis(i, lo, hi, rlo, rhi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, CASE WHEN over THEN rmid ELSE rlo END, CASE WHEN over THEN rhi ELSE rmid END
  FROM (SELECT i, lo, hi, rlo, rhi, (lo + hi) / 2 AS mid, (rlo + rhi) / 2 AS rmid,
      ln(list_sum([pow(x, (lo + hi) / 2) FOR x IN p])) - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) FOR x IN p]) / list_sum([pow(x, (lo + hi) / 2) FOR x IN p]) >= ENTROPY * ln(k) AS ok,
      pow(least, (rlo + rhi) / 2 - 1) / list_sum([pow(x, (rlo + rhi) / 2) FOR x IN p]) > REPEATS AS over
    FROM bis, ps, one WHERE i < 60)),
ends AS (
  SELECT CASE WHEN -list_sum([x * ln(x) FOR x IN p]) >= ENTROPY * ln(k) THEN 1.0 ELSE lo END AS ea,
    CASE WHEN 1 / least / k <= REPEATS THEN 0.0 ELSE rhi END AS ra FROM bis, ps, one WHERE i = 60),
a AS (SELECT greatest(ea, ra) AS a FROM ends),
w AS (SELECT s, t, pow(t / total, a) / (SELECT sum(pow(x.t / total, a)) FROM totals x) * total AS quota FROM totals, one, a),
q AS (SELECT *, CAST(floor(quota / t + 1e-9) AS BIGINT) AS epochs FROM w),
goal AS (SELECT *, greatest(0, quota - epochs * t) AS rest FROM q),
blocks AS (
  SELECT s, block, sum(tokens) AS bt, md5('SEED/' || epochs || '/' || s || '/' || block) AS bat, rest FROM rows JOIN goal USING (s) WHERE rest > 0.5 GROUP BY s, block, epochs, rest),
before AS (SELECT *, sum(bt) OVER (PARTITION BY s ORDER BY bat) - bt AS b FROM blocks),
cut AS (SELECT s, block, bat AS cb, b FROM before WHERE b < rest QUALIFY row_number() OVER (PARTITION BY s ORDER BY bat DESC) = 1),
inside AS (
  SELECT s, md5('SEED/' || epochs || '/' || spelt) AS rat, cb, b, rest, sum(tokens) AS it FROM rows JOIN cut USING (s, block) JOIN goal USING (s) GROUP BY ALL),
upto AS (SELECT *, b + sum(it) OVER (PARTITION BY s ORDER BY rat) - it AS u FROM inside),
stops AS (SELECT s, min(cb) AS cb, max(rat) AS cr FROM upto WHERE u < rest GROUP BY s),
met AS (
  SELECT r.*, epochs + CASE WHEN md5('SEED/' || epochs || '/' || s || '/' || block) < cb OR (md5('SEED/' || epochs || '/' || s || '/' || block) = cb AND md5('SEED/' || epochs || '/' || spelt) <= cr) THEN 1 ELSE 0 END AS copies
  FROM rows r JOIN goal USING (s) LEFT JOIN stops USING (s))
SELECT doc_id, source, tokens, epoch, md5('SEED/' || epoch || '/' || s || '/' || block) AS block_at, md5('SEED/' || epoch || '/' || spelt) AS row_at
FROM (SELECT *, unnest(range(copies)) AS epoch FROM met WHERE copies > 0)
""".replace("SEED", SEED).replace("ENTROPY", repr(ENTROPY)).replace("REPEATS", repr(REPEATS))
