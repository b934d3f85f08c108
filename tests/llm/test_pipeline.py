"""The pipeline against the same stages done plainly in Python."""

import hashlib
import re

from test_dedup_and_join import brute_join
from test_tokens_and_chat import reference_encoding

import __spark_entry__
import corpus_pipeline
from contractlog.llm import catalog, mixing, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    order = sorted(rows)
    good = [i for i, s in zip(order, model.score([rows[i].text for i in order])) if s >= 0.7]
    seen, single = set(), []
    for i in good:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or "")
        if norm not in seen:
            seen.add(norm)
            single.append(i)
    near = brute_join({i: rows[i].text for i in single})
    left = [i for i in single if near[i][1] == i]
    kept = docs.where(docs.doc_id.isin(left))
    mixed = sorted(r.doc_id for r in mixing.occurrences(kept, mixing.plan(kept)).collect())
    ref = reference_encoding()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == mixed
    for r in got:
        text = rows[r.doc_id].text or ""
        assert r.ids == ref.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 2:
            continue  # covered by the run above
        out = stage(spark, docs, SF)
        assert k == 4 or (out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema])


def test_entry_holds_all_queries():
    names = __spark_entry__.queries()
    assert {*catalog.queries(), "pipeline"} <= set(names)
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
