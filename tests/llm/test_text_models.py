"""Classifiers: held-out accuracy on the labelled tables, edge cases, and what may not count."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractlog.llm import language_id, quality, sampling, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    pos = label == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def judged(found, labels, col):
    rows = found.where("held_out").join(labels, "doc_id").where(F.col(col).isNotNull()).select("score", "predicted", col).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[2] for r in rows])


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    found = quality.scores(docs, model).cache()
    score, predicted, label = judged(found, labels, "quality")
    print("quality", auc(score, label), (predicted == label).mean(), predicted[label == 1].mean(), predicted[label == 0].mean(), len(label))
    assert auc(score, label) > 0.9 and predicted[label == 1].mean() > 0.95
    assert found.count() == docs.count() and found.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.keep(docs, model).count() == found.where("predicted = 1").count()


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    found = toxicity.scores(docs, model).cache()
    score, predicted, label = judged(found, labels, "toxic")
    print("toxic", auc(score, label), (predicted == label).mean(), predicted[label == 1].mean(), predicted[label == 0].mean(), len(label))
    assert auc(score, label) > 0.95 and predicted[label == 0].mean() < 0.03 and predicted[label == 1].mean() > 0.85
    assert found.count() == docs.count() and found.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_meets_unseen_misspellings():
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abdeghilmnoprstu"), rng.integers(3, 9))) for _ in range(400)]
    bad = ["scoundrel", "halfwit", "worthlessness"]
    texts, labels = [], []
    for k in range(500):
        words = list(rng.choice(plain, 60))
        if k % 3 == 0:
            words[int(rng.integers(60))] = bad[k % len(bad) if k % 2 else 0]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, labels, {0: 0.67, 1: 0.33})
    base = " ".join(plain[:60])
    odd = [base + f" {w} " + base for w in ("scoundrell", "sc0undrel", "skoundrel")]
    assert (model.score(odd) > model.score([base + " " + base])[0] + 0.3).all()


def test_votes_equal_brute_force():
    """Every cosine, every vote by itself; ties at the edge go to the first vectors."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "d3lta", "!!", "eps-ilon", "zeta,"], rng.integers(1, 30))) for _ in range(120)]
    labels = [int("!!" in t) for t in texts]
    texts += texts[:30]  # equal vectors: ties
    labels += [1 - x for x in labels[:30]]
    model = quality.fit(texts, labels, {0: 0.6, 1: 0.4})
    asked = [*texts[:40], "something else", "", None, "  ", "alpha " * 5000]
    bags = quality.bags(asked)
    want = []
    for t, x in zip(asked, bags):
        if not (t or "").strip():
            want.append(0.4)
            continue
        v = model.project(x[None])[0]
        cos = [float(np.float32(v @ u)) for u in model.vectors]
        near = sorted(range(len(cos)), key=lambda k: (-round(cos[k], 5), k))[: quality.NEIGHBOURS]
        vote = [max(cos[k], 1e-3) ** quality.POWER * ({0: 0.6, 1: 0.4}[labels[k]] / labels.count(labels[k])) for k in near]
        want.append(sum(v for v, k in zip(vote, near) if labels[k]) / sum(vote))
    got = model.score(asked)
    assert np.abs(got - want).max() < 0.02 and np.median(np.abs(got - want)) < 1e-4


def test_nearest_breaks_ties_by_place():
    cos = np.round(np.random.default_rng(3).random((50, 90)), 1)
    got = quality.nearest(cos, 12)
    assert all(sorted(g) == sorted(sorted(range(90), key=lambda j: (-c[j], j))[:12]) for g, c in zip(got.tolist(), cos.tolist()))


def test_lexical_terms_are_words_and_runs():
    words = lambda t: sorted(quality._lexical(np.frombuffer(t.encode(), np.uint8))[0].tolist())
    assert words("  The cat\tTHE\n") == words("cat the the") and words("ab ba") != words("ab ab") and words(" \n") == []
    assert len(set(words("one two three four five six"))) == 6 and len(quality._lexical(np.frombuffer(b"abcdef", np.uint8))[1]) == 3


def brute_facts(model, text):
    """Windows one by one, each n-gram looked up by itself."""
    words = (text or "").lower().translate(toxicity._MARKS).split()
    if not words:
        return None
    weight = []
    for w in words:
        bucket, _, _ = toxicity.ngrams([w])
        weight.append([model.weight[b] for b in bucket])
    mean = lambda ws: sum(map(sum, ws)) / max(1, sum(map(len, ws))) + model.bias
    starts = range(max(1, len(words) - toxicity.WINDOW + 1))
    logits = [mean(weight[k : k + toxicity.WINDOW]) for k in starts]
    return max(logits), np.log1p(sum(max(0.0, x) for x in logits)), np.log(len(starts)), 1.0


def test_facts_equal_brute_force():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.3, np.array([1.0, 0.5, -0.2, 0.1]), 0.25)
    texts = ["", None, " .,; ", "a", "One two", "é中😀 ab-c", *(" ".join("".join(rng.choice(list("abcé😀"), rng.integers(1, 9))) for _ in range(rng.integers(1, 40))) for _ in range(60))]
    got = model.facts(texts)
    for t, x, p in zip(texts, got, model.score(texts)):
        want = brute_facts(model, t)
        if want is None:
            assert np.isnan(x).all() and p == 0.25
        else:
            assert np.allclose(x, want) and np.isclose(p, 1 / (1 + np.exp(-np.dot(want, model.curve))))


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 100)").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = sampling.labelled_sample(docs, labels, "quality", 50, most_bytes=750).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 7, 1: 7}
    assert sampling.labelled_sample(docs, labels, "quality", 50, most_bytes=1).count() == 2


def test_windows_cover_every_word():
    for n in (0, 1, 5, 6, 7, 8, 9, 10, 30):
        s, e, t = toxicity.windows(np.array([0, n]))
        assert {w for a, b in zip(s, e) for w in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in zip(s, e))


@pytest.mark.parametrize("module, col", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, col):
    long = "lorem ipsum dolor " * 40000
    rows = [(1, None, None, None), (2, "", "x", "y"), (3, " \n ", "x", "y"), (None, "a b c", None, None), (4, long, "x", "y"), (4, long, "x", "y"), (5, "é中😀", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("label", F.lit("clash")).withColumn("id", F.lit(3))
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    one = module.scores(docs, module.train(docs, labels, col)).collect()
    assert len(one) == 7 and len({r.score for r in one}) == 1
    none = module.scores(docs, module.train(docs, labels.limit(0), col)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    many = [(k, ("good words here " if k % 2 else "BAD!! ### ") * (1 + k % 7), "x", "y") for k in range(40)]
    other = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    model = module.train(spark.createDataFrame(many, DOCS), other, col)
    got = module.scores(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got] == [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got]
    assert module.scores(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = sampling.labelled_sample(docs, labels, "quality", 1000).select("id").collect()
    assert {r.id for r in got} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert sampling.labelled_sample(docs, labels, "quality", 7).count() == 7


def brute_language(pages, model):
    """The formula of the module, page by page."""
    import re

    langs, k = model.langs, len(model.langs)
    p = [model.posterior(language_id.visible(h)) for _, _, h in pages]
    host, suffix, said = [], [], []
    for _, url, h in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
        host.append(m[1].lower() if m else "")
        m = re.search(r"\.([^.]+)\.?$", host[-1])
        suffix.append(m[1] if m else "")
        m = re.search(r"(?i)<html\b([^>]*)>", h or "")
        m = re.search(r"""(?i)(?:^|\s)(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", m[1] if m else "")
        said.append(m[1].lower() if m else "")
    out = {}
    for i, (page, _, _) in enumerate(pages):
        of = lambda keys: [max(0.0, sum(p[j][x] for j in range(len(p)) if keys[j] == keys[i]) - p[i][x]) for x in range(k)]  # noqa: E731, B023
        g, s, h, d = of([0] * len(p)), of(suffix), of(host), of(said)
        level = lambda c, q: [(x + y * language_id.SMOOTH) / (sum(c) + language_id.SMOOTH) for x, y in zip(c, q)]
        prior = level(h, level(s, level(g, [1 / k] * k)))
        own = [language_id.CLEAN if x == said[i] else language_id.OTHER for x in langs]
        told = [1.0] * k if not said[i] else [(x + y) / (z + language_id.CLEAN + language_id.OTHER * k) for x, y, z in zip(d, own, g)]
        post = [a * b * c for a, b, c in zip(prior, p[i], told)]
        top = max(range(k), key=lambda x: post[x])
        out[page] = (langs[top], round(post[top] / sum(post), 9), said[i], host[i], suffix[i])
    return out


def test_language_equals_brute_force(spark):
    model = language_id.fit(["the cat and the dog", "der Hund und die Katze", "le chat et le chien"] * 3, ["en", "de", "fr"] * 3)
    rng = np.random.default_rng(2)
    texts = ["the dog and", "die Katze und", "le chien et", "", "x"]
    urls = ["https://a.example.de/x", "http://b.example.de", "https://u@c.fr:8/?q", None, "nonsense", "https://a.example.de/y"]
    tags = ['<html lang="de">', "<HTML LANG=en-US>", "<html class=x lang='fr'>", "", "<html lang=xx>"]
    pages = [(k, urls[rng.integers(6)], None if k == 50 else tags[rng.integers(5)] + "<script>var le='et'</script><p>" + texts[rng.integers(5)]) for k in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("xx")).withColumn("p", F.lit(1))
    got = {r.page_id: (r.lang, round(r.probability, 9), r.declared, r.host, r.suffix) for r in language_id.identify(df, model).collect()}
    want = brute_language(pages, model)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert sum(got[k][0] != want[k][0] for k in got) == 0
    assert language_id.identify(df.limit(0), model).count() == 0


def test_references_and_bare_signs_are_text(spark):
    assert language_id.visible("a < b and c > d <b>e</b>f<!-- g --><?h?></i >&lt;p&gt;").split() == "a < b and c > d e f <p>".split()
    assert language_id.visible("&#1087;&#x440;&eacute;&nbsp;&uuml;&amp;eacute;") == "\u043f\u0440\u00e9\u00a0\u00fc&eacute;"
    texts = ["привет большой мир", "der große Hund über München", "le château de la forêt"]
    model = language_id.fit(texts * 3, ["ru", "de", "fr"] * 3)
    coded = ["".join(f"&#{ord(c)};" for c in texts[0]), "der gro&szlig;e Hund &uuml;ber M&uuml;nchen", "le ch&acirc;teau 1 < 2 de la for&#xEA;t"]
    df = spark.createDataFrame([(k, None, f"<p>{t}</p>") for k, t in enumerate(coded)], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in language_id.identify(df, model).collect()} == {0: "ru", 1: "de", 2: "fr"}
    assert all((language_id.trigrams(language_id.visible(c)) == language_id.trigrams(t)).all() for c, t in zip(coded[:2], texts))


def test_languages_without_labels_and_with_many(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 300} " * 9, f"l{k % 300}", "s") for k in range(900)] + [(None, "x y", "l1", "s"), (5, None, "l1", "s")], DOCS)
    model = language_id.train(docs, per_lang=2)
    assert model.langs == sorted(f"l{k}" for k in range(300))
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang=de>x"), (2, None, None)], "page_id long, url string, html string")
    got = language_id.identify(pages, language_id.train(docs.limit(0))).collect()
    assert [(r.page_id, r.lang, r.probability, r.declared, r.host, r.suffix) for r in got] == [(1, None, 0.0, "de", "a.de", "de"), (2, None, 0.0, "", "", "")]
    assert language_id.identify(pages, model).columns == language_id.identify(pages, language_id.train(docs.limit(0))).columns
    monkeypatch.setattr(language_id, "MOST_LANGS", 100)
    with pytest.raises(ValueError, match="languages"):
        language_id.train(docs)


def test_language_of_the_pages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    got = language_id.identify(pages, language_id.train(docs)).collect()
    agree = sum(r.lang == r.declared for r in got) / len(got)
    print("language", agree, sum(r.text_lang == r.declared for r in got) / len(got))
    assert len(got) == pages.count() and agree > 0.9
