from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontam import TOKEN, brute_tiles
from test_ngram_join import brute, groups

from quern.llm import decontam, mixing, pii, quality


def test_stages_against_brute_force(spark, sf):
    """Every stage by plain loops over what the stage before it kept, but for the sample of the
    first and the rates of the last, which have brute force tests of their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    now = {r.doc_id for r in quality.sample(docs, labels).collect()}
    root = groups(brute({i: held[i] for i in now}))
    now = {i for i in now if root.get(i, i) == i}
    items = {r.item_id: TOKEN.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    runs = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in items.values()]
    for i in list(now):
        doc = TOKEN.findall(held[i].lower())
        own = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for t, r in zip(items.values(), runs):
            if len(own & r) * 5 >= decontam.COVERAGE * len(t) and sum(x[2] for x in brute_tiles(t, doc, 5)) >= decontam.COVERAGE * len(t):
                now.discard(i)
                break
    key = pii._key(spark, None)
    want = {i: pii.replace(held[i], key, {})[0] for i in now}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.cut(stage(spark, step, sf))
        assert step.schema == docs.schema, name
    assert {r.doc_id: r.text for r in step.collect()} == want
    assert all(r.n_chars == len(r.text) for r in step.collect())
    rates = {r.doc_id: r.copies for r in mixing.copies(step).collect()}
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in rates.items() if n})
    assert got.columns == [*docs.columns, "copy"]


def test_an_empty_table(spark, sf):
    step = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.cut(stage(spark, step, sf))
    assert step.count() == 0


def test_stages_take_documents_with_more_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").withColumn("_gone", F.lit(1)).withColumn("key", F.lit("k"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
