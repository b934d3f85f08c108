"""BPE, chat formatting, rollups and mixing against brute force, round trips and SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contractlog.llm import byte_bpe, catalog, chat_format, mixing, token_rollup
from contractlog.scratch import shared_dir

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n  x", "naïve café 中文字 😀👩‍👩‍👧", "don't we'll I'M 's", "a" * 5000, "é" * 3000, " \x85  　x", "0123456789" * 50, "<|endoftext|>", "\x00\x01", "ﷺ�"]


def reference_encoding():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_vocabulary_splits_in_two():
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    assert all(len(byte_bpe.split_below(t, ranks)) == 2 for t in ranks if len(t) > 1)


def test_bpe_equals_the_rank_library(spark):
    ref = reference_encoding()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700), 10, 32])) for _ in range(60)) for _ in range(300)]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD + noise)], "doc_id long, text string")
    both = docs.unionByName(more)
    got = {r.doc_id: r for r in byte_bpe.digests(both).collect()}
    for r in both.collect():
        ids = ref.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), r
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and g.chars_covered == len(r.text or "")


def test_bpe_interface(spark):
    df = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(ODD)], "doc_id long, text string, other string").withColumn("ids", F.lit("clash"))
    coded = byte_bpe.encode(df)
    assert coded.columns == ["doc_id", "text", "other", "ids", "starts", "ends"]
    back = byte_bpe.decode(coded).collect()
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode() and r.decoded_text == (r.text or "") and r.other == "keep"
        assert len(r.ids) == len(r.starts) == len(r.ends) and all(a <= b for a, b in zip(r.starts, r.ends))
    emoji = next(r for r in back if r.text and r.text.startswith("naïve"))
    assert max(emoji.ends) == len(emoji.text)
    part = byte_bpe.decode(spark.createDataFrame([(emoji.ids[:-1],), ([],), (None,)], "ids array<int>")).collect()
    assert emoji.text.encode().startswith(bytes(part[0].decoded)) and [r.decoded_text for r in part[1:]] == ["", ""]
    assert byte_bpe.encode(df.limit(0)).count() == 0
    plain = byte_bpe.encode(df, offsets=False)
    assert [r.ids for r in plain.collect()] == [r.ids for r in back]


def brute_chat(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(said), sha(said))
    return out


def test_chat_formatting(spark):
    rng = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "<\\\\|im_end|>\n", "\n", "é😀", "text", " ", "$1", "assistant"]
    roles = ["user", "assistant", "assistant", "system", None, "odd\nrole~<|"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(8)))])) for _ in range(200)]
    rows += [(77, 0, "assistant", "only"), (78, 0, "user", "x" * 200000), (79, 0, None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("k", F.lit(2))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(df).collect()}
    assert got == brute_chat(rows)
    for r in chat_format.examples(df).collect():
        assert (r.loss_start is None) == (r.loss_end is None)
        if r.loss_start is not None:
            assert r.formatted[: r.loss_start].endswith("<|im_start|>assistant\n") and r.formatted[r.loss_end :] == "<|im_end|>\n"
            assert "<|" not in r.formatted[r.loss_start : r.loss_end]
    assert chat_format.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_token_rollup", "op7_exact_dedup", "op9_mixing"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SMALL)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_rollup_is_idempotent(spark):
    docs = spark.createDataFrame([("a", "en", "one two"), ("a", None, "x"), (None, "en", None), ("a", "en", "three")], "source string, lang string, text string").withColumn("tokens", F.lit("clash"))
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-test")
    state = lambda: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert state() == {} and rollup.batches() == []
    assert rollup.commit("1", token_rollup.inserts(docs)) and not rollup.commit("1", token_rollup.inserts(docs))
    first = state()
    assert first[("a", "en", "words-1")] == (2, 3) and first[(None, "en", "words-1")] == (1, 0) and first[("a", None, "bytes-1")] == (1, 1)
    rollup.compact()
    assert state() == first and not rollup.commit("1", token_rollup.inserts(docs)) and rollup.batches() == ["1"]
    before = docs.where("text = 'three'")
    assert rollup.commit("2", token_rollup.revisions(before, before.withColumn("text", F.lit("a b c d"))))
    assert state()[("a", "en", "words-1")] == (2, 6)
    assert rollup.commit("3", token_rollup.deletes(docs.where("lang is null"))) and ("a", None, "bytes-1") not in state()
    rollup.compact()
    rollup.compact()
    assert rollup.batches() == ["1", "2", "3"] and rollup.known("2") and not rollup.known("4") and state()[("a", "en", "words-1")] == (2, 6)
    staged = f"{rollup.path}/staging/left-over"
    token_rollup.summed(token_rollup.inserts(docs)).write.parquet(staged)  # as of a commit that died
    assert state()[("a", "en", "words-1")] == (2, 6)
    assert rollup.commit("4", token_rollup.inserts(docs.limit(0))) and state()[("a", "en", "words-1")] == (2, 6)
    odd = "5/../1 %2F ü"  # an id is a text, not a path
    assert rollup.commit(odd, token_rollup.inserts(docs.limit(1))) and not rollup.commit(odd, token_rollup.inserts(docs))
    after = state()
    rollup.compact()
    assert rollup.batches() == ["1", "2", "3", "4", odd] and not rollup.commit(odd, token_rollup.inserts(docs)) and state() == after
    assert after[("a", "en", "words-1")] == (3, 8)


def test_totals_cover_every_row(spark):
    ref, name = reference_encoding(), "byte-bpe-multi-50k-1"
    texts = [*ODD[:4], "中文字" * 4000, "QUJD" * 5000, "five words stand right here", "five words stand right here", "\ttwo  words\n"]
    rows = [("ab"[k % 2], [None, "en"][k % 3 == 0], t) for k, t in enumerate(texts)] + [(None, None, "x")]
    df = spark.createDataFrame(rows, "source string, lang string, text string")
    want = {}
    for source, lang, text in rows:
        text = text or ""
        for tokenizer, n in (("words-1", len(text.split())), ("bytes-1", len(text.encode())), (name, len(ref.encode_ordinary(text)))):
            docs, tokens = want.get((source, lang, tokenizer), (0, 0))
            want[(source, lang, tokenizer)] = (docs + 1, tokens + n)
    state = lambda found: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in found.collect()}
    assert state(token_rollup.whole(df)) == want
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-versions")
    rollup.commit("1", token_rollup.inserts(df, models=token_rollup.MODELS))
    rollup.commit("2", token_rollup.deletes(df, tokenizers={}, models=token_rollup.MODELS))
    rollup.commit("3", token_rollup.inserts(df, tokenizers={}, models={"byte-bpe-multi-50k-2": byte_bpe.default_ranks()}))
    assert state(rollup.totals()) == {(s, g, t.replace("50k-1", "50k-2")): n for (s, g, t), n in want.items()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert {r.tokenizer: r.n for r in catalog.token_totals(spark, SMALL).groupBy("tokenizer").agg(F.sum("documents").alias("n")).collect()} == {
        t: docs.count() for t in ("words-1", "bytes-1", name)
    }


def brute_weights(totals, entropy, repeats, budget=None):
    t = np.array(sorted(totals.values()), float)
    total, p = t.sum(), np.sort(t / t.sum())
    budget = min(budget if budget is not None else total, repeats * total)
    w = lambda a: p**a / (p**a).sum()
    h = lambda a: -(w(a) * np.log(w(a))).sum()
    rep = lambda a: (w(a) * budget / t).max()
    grid = np.linspace(0, 1, 100001)
    ea = 1.0 if h(1) >= entropy * np.log(len(p)) else max(a for a in grid if h(a) >= entropy * np.log(len(p)))
    ra = 0.0 if rep(0) <= repeats else min(a for a in grid if rep(a) <= repeats or a == 1)
    a = max(ea, ra)
    return a, {s: (v / total) ** a / (p**a).sum() for s, v in totals.items()}, budget


@pytest.mark.parametrize("entropy, repeats, budget", [(0.9, 4.0, None), (0.99, 1.5, None), (0.5, 2.0, 30000), (1.0, 100.0, 200000)])
def test_mixing_weights_and_quotas(spark, entropy, repeats, budget):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))), rng.choice(["big"] * 12 + ["mid"] * 3 + ["low", None])) for k in range(3000)]
    rows += [(5000, None, "empty"), (5001, "", "empty"), (5002, None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epochs", F.lit("clash"))
    totals, size = {}, {}
    for k, text, source in rows:
        size[k] = len((text or "").split())
        totals[source] = totals.get(source, 0) + size[k]
    totals.pop("empty")
    a, want, budget = brute_weights(totals, entropy, repeats, budget)
    plans = mixing.plan(df, entropy, repeats, budget).cache()
    got = {None if r._source == mixing.NULL_SOURCE else r._source: r for r in plans.collect()}
    assert set(got) == set(want) and all(abs(got[s].exponent - a) < 2e-5 and abs(got[s].weight - want[s]) < 1e-4 for s in want)
    took = mixing.occurrences(df, plans).collect()
    by = {}
    for r in took:
        by.setdefault((r.source, r.epoch), []).append(r)
    for s in want:
        mine = sum(size[r.doc_id] for r in took if r.source == s)
        assert 0 <= mine - got[s].quota + 0.6 <= 62, (s, mine, got[s])
        for e in range(got[s].epochs):
            assert len(by[(s, e)]) == sum(1 for x in rows if x[2] == s)
        last = sorted(by.get((s, got[s].epochs), []), key=lambda r: (r.block_at, r.row_at))
        # the partial epoch is the beginning of its permutation: without its last row it misses the quota
        rest = got[s].quota - got[s].epochs * got[s].tokens
        assert not last or sum(r.tokens for r in last[:-1]) < rest + 1e-6
    mixed = mixing.mix(df, plans)
    assert mixed.columns == df.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in took)
    again = sorted(mixing.occurrences(df.repartition(5), mixing.plan(df.repartition(3), entropy, repeats, budget)).collect())
    assert again == sorted(took)


def test_mixing_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    plans = mixing.plan(df)
    assert plans.count() == 0 and mixing.mix(df, plans).count() == 0 and mixing.occurrences(df, plans).count() == 0
    df = spark.createDataFrame([(None, "a b", "s"), (1, "c " * 50000, "s"), (1, "c " * 50000, "s"), (2, "d", "s")], df.schema)
    assert mixing.mix(df, mixing.plan(df)).count() == 4  # one source: as it is


def test_mixing_keeps_columns_of_any_name(spark, monkeypatch):
    names = ["_tokens", "_source", "_block", "_spelt", "_copies", "_copy", "_row", "_salt", "tokens", "a.b", "c`d"]
    rows = [(k, f"w{k} " * (1 + k % 7), "big" if k % 3 else "low") for k in range(300)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = plain.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    plans = mixing.plan(df, entropy=1.0)
    got = sorted(tuple(r) for r in mixing.mix(df, plans).collect())
    assert mixing.mix(df, plans).columns == df.columns and {r[0] for r in got} <= set(range(300)) and len(got) > 250
    assert all(r[3:] == tuple(f"{n}{r[0]}" for n in names) and r[:3] == rows[r[0]] for r in got)
    counted = mixing.counted(df)
    assert sorted(mixing.occurrences(counted, mixing.plan(counted, 1.0, tokens_col="tokens"), tokens_col="tokens").collect()) == sorted(mixing.occurrences(df, plans).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)  # the salted join
    assert sorted(tuple(r) for r in mixing.mix(df, plans).collect()) == got
