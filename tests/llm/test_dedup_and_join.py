"""Exact dedup and the n-gram join against brute force, with edge cases."""

import hashlib
import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from contractlog.llm import exact_dedup, ngram_join
from contractlog.llm.common import Scratch, filter_bits, maybe_member, membership
from contractlog.llm.components import components

DOCS = "doc_id long, text string, lang string"


def least_reachable(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute_sets(texts, n=5):
    out = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    return out


def brute_join(texts, n=5, percent=75):
    sets = brute_sets(texts, n)
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in least_reachable(texts, links).items()}


def joined(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.links(df, **more).collect()}


def near_copies(rng, base, count, rate):
    return [" ".join(w if rng.random() > rate else rng.choice("xyzuvw") + w for w in base) for _ in range(count)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == least_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_membership_has_no_false_negative(spark):
    keys, bits = spark.range(0, 3000, 3), filter_bits(1000)
    got = maybe_member(spark.range(3000), "id", membership(keys, "id", bits), bits)
    rows = {r.id: r.maybe for r in got.collect()}
    assert len(rows) == 3000 and all(rows[k] for k in range(0, 3000, 3))
    assert sum(rows.values()) < 1500


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(200))
    passage = [word() for _ in range(55)]
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(3, 120))]
        texts += near_copies(rng, base, rng.randrange(1, 6), rng.choice([0, 0.01, 0.03, 0.06]))
        texts.append(" ".join(base[: len(base) // 2] + passage))
    texts += near_copies(rng, [word() for _ in range(80)], 60, 0.015) + [" ".join(passage + [word()]) for _ in range(20)]
    texts += [None, "", "  \t ", "one", "ONE", "one two", "a b c d", "A b\tc d", "p\x0bq\x0cr\x1cs t\u00a0u v\x85w", "P q R\x1cs\n\r t\u00a0u v\x85w ", "ÀB ÇD É F G H", "àb çd é f g h"]
    rng.shuffle(texts)
    texts = dict(enumerate(texts, 7))
    assert joined(spark, texts) == brute_join(texts)


def test_shingles_of_slices(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 3000)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_batches(max_chunksize=90)
    got = {i: len(s) for i, s in ngram_join._texts((b.slice(3) for b in docs), 5)}
    want = {i: t for b in docs for i, t in zip(*(c.to_pylist()[3:] for c in b.columns))}
    assert got == {i: len(s) for i, s in brute_sets(want).items()}


def test_every_round_reaches_the_rest(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = dict(enumerate(near_copies(rng, base, 50, 0.03) + [" ".join(base)]))
    assert joined(spark, texts) == brute_join(texts)


def test_steps_of_the_join_leave_little_on_the_disk(spark, monkeypatch):
    """Shuffles of the counts, the prefixes and the lists are dropped in between; only lists of several components are settled again."""
    steps, comps, write, tidy = [], {}, Scratch.write, Scratch.tidy

    def writing(self, df, name, **options):
        steps.append(name)
        out = write(self, df, name, **options)
        if name.startswith("lists-"):
            comps[name] = [r.c for r in out.groupBy("h").agg(F.countDistinct("comp").alias("c")).collect()]
        return out

    monkeypatch.setattr(Scratch, "write", writing)
    monkeypatch.setattr(Scratch, "tidy", lambda self: (steps.append("tidy"), tidy(self)))
    rng = random.Random(6)
    texts = []
    passage = [f"p{k}" for k in range(30)]
    for k in range(12):
        base = [f"w{k}x{j}" for j in range(60)]
        texts += near_copies(rng, base, 4, 0.01) + near_copies(rng, base[:24] + passage, 3, 0.01)
    texts = dict(enumerate(texts))
    assert joined(spark, texts) == brute_join(texts)
    between = lambda a, b: steps[steps.index(a) + 1 : steps.index(b)]
    assert between("often", "prefix") == ["tidy"] and between("prefix", "lists") == ["tidy"]
    assert comps["lists-0"] and all(c > 1 for cs in comps.values() for c in cs)


def test_marks_of_many_groups(spark, monkeypatch):
    """Groups of few documents, buckets of few marks and rows of few: no link is lost."""
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "SEVERAL", 9)
    monkeypatch.setattr(ngram_join, "MARKS_IN_ROW", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 1000)
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(rng.randrange(4, 70))]
        texts += near_copies(rng, base, rng.randrange(1, 5), rng.choice([0, 0.02, 0.05]))
    texts = dict(enumerate([*texts, None, "", "one"] + ["the very same words here"] * 30))
    assert joined(spark, texts) == brute_join(texts)
    monkeypatch.setattr(ngram_join, "MOST_FILTER_BITS", 0)  # beyond the filter's bound texts meet the classes by a shuffle
    assert joined(spark, texts) == brute_join(texts)


@pytest.mark.parametrize(("n", "percent"), [(1, 50), (3, 90), (2, 100)])
def test_other_thresholds(spark, n, percent):
    rng = random.Random(n)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdef") + str(rng.randrange(60)) for _ in range(rng.randrange(1, 40))]
        texts += near_copies(rng, base, rng.randrange(1, 6), rng.choice([0, 0.05, 0.2]))
    texts = dict(enumerate(texts))
    assert joined(spark, texts, n=n, percent=percent) == brute_join(texts, n, percent)


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(k, f"some text of its own number {k}", "en") for k in range(9)] + [(20, "some text of its own number 3", "en")]
    df = spark.createDataFrame(rows, DOCS).withColumn("a.b", F.col("doc_id")).withColumn("c`d", F.lit(1))
    kept = ngram_join.dedup(df)
    assert kept.columns == df.columns and sorted(r["a.b"] for r in kept.collect()) == list(range(9))


def test_join_on_documents_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.links(docs).collect()}
    assert got == brute_join(texts)


def test_join_edges(spark):
    df = spark.createDataFrame([], DOCS)
    assert ngram_join.links(df).count() == 0 and ngram_join.dedup(df).count() == 0
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (2, long, "x"), (1, long + " z", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("h", F.lit(0))
    got = sorted(map(tuple, ngram_join.links(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (2, 29996, 1), (1, 29997, 1)], key=str)
    kept = ngram_join.dedup(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]


def test_one_id_on_several_texts(spark):
    words = lambda a: [f"{a}{k}" for k in range(60)]
    text = lambda a, *more: " ".join([*words(a), *more])
    rows = [(1, text("a")), (7, text("a", "end")), (7, text("b")), (8, text("b", "end")), (9, text("a", "last")), (7, "alone on this id"), (7, None)]
    rows += [(20, text("c")), (20, text("c", "end")), (21, text("c").upper()), (None, text("c")), (30, text("d")), (30, text("d"))]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS).withColumn("_key", F.lit(1))
    sets = brute_sets(dict(enumerate(t for _, t in rows)))
    known = [k for k in sets if rows[k][0] is not None]
    links = [(a, b) for a in known for b in known if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = least_reachable(sets, links)
    least = lambda k: min((rows[j][0] for j in known if group[j] == group[k]), default=None)
    got = sorted(map(tuple, ngram_join.links(df).collect()), key=str)
    assert got == sorted(((i, len(sets[k]), None if i is None else least(k)) for k, (i, _) in enumerate(rows)), key=str)
    kept = ngram_join.dedup(df)
    assert kept.columns == df.columns
    stay = {0, 2, 5, 6, 10, 11, 12}
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [x for x in left if x[0] != 20]  # of the near copies on one id one stays
    assert one == sorted((rows[k] for k in stay), key=str) and len(left) == len(one) + 1


def test_equal_keys_are_salted_anew(spark, monkeypatch):
    whole = ngram_join._key
    monkeypatch.setattr(ngram_join, "_key", lambda salt, *cols: whole(salt, *cols) if salt else F.pmod(whole(0, *cols), F.lit(8)))
    base = [f"w{k}" for k in range(60)]
    texts = dict(enumerate([*near_copies(random.Random(6), base, 12, 0.01), *(f"text {k}" for k in range(20))]))
    assert joined(spark, texts) == brute_join(texts)


def brute_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def test_exact_dedup(spark):
    rng = random.Random(5)
    words = ["a", "b", "é中😀", " ", "x\ty", "A"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(4)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, " "), (903, "\n\t"), (None, "a"), (None, "alone"), (904, "q" * 300000), (905, "q" * 300000), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS).withColumn("_id", F.lit(1)).withColumn("maybe", F.lit(2))
    got = exact_dedup.classes(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_copies(rows), key=str)
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {(k, s) for _, k, _, _, s in brute_copies(rows)}
    assert len(ids) == len(want) and sorted(map(str, ids)) == sorted(str(k) for k, _ in want)
    assert exact_dedup.classes(df.limit(0)).count() == 0 and exact_dedup.dedup(df.limit(0)).count() == 0


def test_equal_digests_are_verified(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2)))
    rows = [(k, f"text {k % 150}") for k in range(600)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.classes(df).collect()}
    assert got == {(k, k % 150, 4) for k in range(600)}


def test_equal_digests_in_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 1)))
    rows = [(k, f"text {k % 40}") for k in range(200)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    assert sorted(r.doc_id for r in exact_dedup.dedup(df).collect()) == list(range(40))
    monkeypatch.setattr(exact_dedup.common, "MOST_FILTER_BITS", 0)  # beyond the filter's bound
    assert sorted(r.doc_id for r in exact_dedup.dedup(df).collect()) == list(range(40))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.classes(df).collect()} == {(k, k % 40, 5) for k in range(200)}


def test_dedup_keeps_columns_of_any_name_and_type(spark):
    rows = [(k % 60, f"text {k % 40}", "en") for k in range(120)]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(n).alias(n) for n in ("_first", "_none", "_row", "_digest", "_least", "a.b", "c`d")))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("v", F.parse_json(F.lit('{"a":1}')))
    kept = exact_dedup.dedup(df)
    got = kept.collect()
    assert kept.columns == df.columns and len(got) == 40 == len({r.text for r in got}) and {r.doc_id for r in got} == set(range(20))
    assert all(r["a.b"] == "a.b" and r["c`d"] == "c`d" and r["_first"] == "_first" and r.m == {"k": r.doc_id} for r in got)


def test_hot_texts_come_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    rows = [(k, "the hot text" if k % 3 else f"text {k % 50}") for k in range(400)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    assert sorted(map(tuple, exact_dedup.classes(df).collect()), key=str) == sorted(brute_copies(rows), key=str)


def test_index_lookup_and_later_batches(spark):
    rows = [(k, f"text {k % 70}") for k in range(300)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    index, digests = exact_dedup.build(df.where("doc_id >= 100"), Scratch(spark, "t"))
    assert [len(x) for x in index.levels] == [0, 1] and digests.count() == 200
    index.flush(exact_dedup.with_digest(df.where("doc_id < 100")).select("_id", "_digest"), "late")
    assert [len(x) for x in index.levels] == [1, 1]
    assert {r._least: r._copies for r in index.entries().collect()} == {k: 5 if k < 20 else 4 for k in range(70)}
    asked = [hashlib.sha256(f"text {k}".encode()).digest() for k in (3, 69, 500)]
    assert {r._least: r._copies for r in index.lookup(asked).collect()} == {3: 5, 69: 4}


def test_index_levels(spark):
    rows = [(k, f"text {k % 70}") for k in range(300)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    index = exact_dedup.DigestIndex(Scratch(spark, "t"))
    texts = exact_dedup.with_digest(df).select("_id", "_digest")
    for k in range(9):
        index.flush(texts.where(f"_id % 9 = {k}"), str(k))
    index.flush(texts.where("_id % 9 = 8"), "8")  # again: nothing changes
    assert [len(x) for x in index.levels] == [1, 1]
    got = {r._least: r._copies for r in index.entries().collect()}
    assert got == {k: 5 if k < 20 else 4 for k in range(70)}
