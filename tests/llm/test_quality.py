import math
import random

import messy
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm._bytes import Powers


def corpus(spark):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(60)], [f"spam{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = bad if i % 4 == 0 else good
        rows.append((i, " ".join(rng.choice(words if rng.random() < 0.8 else good + bad) for _ in range(rng.choice([20, 40, 200])))))
    labels = [(i, int(i % 4 != 0), int(i % 50 == 1)) for i in range(0, 600) if i % 3]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_model_against_brute_force(spark):
    """Weights and keys worked out with dictionaries over the same buckets."""
    docs, labels = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality and not r.toxic}
    powers, buckets = Powers(), {}
    for i, t in texts.items():
        (_, b, _), = quality.features(pa.array([t]), powers)
        assert len(b) == 2 * len(t.split())
        buckets[i] = b.tolist()
    raw, target, n_docs, n_target = {}, {}, {}, {}
    for i, bs in buckets.items():
        for b in bs:
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i in good)
        for b in set(bs):
            n_docs[b] = n_docs.get(b, 0) + 1
            n_target[b] = n_target.get(b, 0) + (i in good)
    share, share_docs = sum(target.values()) / sum(raw.values()), len(good) / len(texts)
    weight = {}
    for b in raw:
        e = n_docs[b] * share_docs
        differs = abs(n_target[b] - e) >= quality.SIGNIFICANCE * math.sqrt(e + 1)
        weight[b] = math.log((target[b] + quality.SMOOTHING) / (raw[b] * share + quality.SMOOTHING)) if differs else 0.0
    got = {r.doc_id: r for r in quality.sample(docs, labels, share=1.0).collect()}
    assert set(got) == set(texts) and any(weight.values())
    for i, bs in buckets.items():
        assert got[i].n_grams == len(bs) and abs(got[i].log_weight - sum(weight[b] for b in bs)) < 1e-3


def test_cut_by_labels(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in quality.sample(docs, labels).collect()}
    clean, spam = [i for i in range(600) if i % 4], [i for i in range(600) if i % 4 == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in spam) <= 0.2 * len(spam)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = quality.sample(docs, labels.where("doc_id % 5 <> 0")).select("doc_id", F.lit(1).alias("kept"))
    held = labels.where("doc_id % 5 = 0").join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    r = held.agg(*[F.avg(F.when(F.expr(c), F.col("kept"))).alias(n) for n, c in (("clean", "quality = 1 and toxic = 0"), ("low", "quality = 0"), ("toxic", "toxic = 1"))]).first()
    assert r.clean >= 0.98 and r.low <= 0.3 and r.toxic <= 0.3


def test_least_key():
    keys, good = np.array([5.0, 4, 3, 2, 1]), np.array([True, True, False, True, False])
    assert quality.least_key(keys, good) == 2.0 and quality.least_key(keys, good, lost=0.5) == 4.0
    assert quality.least_key(keys, np.ones(5, bool)) == -np.inf


def test_top_k_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1, 1, 2, 3.5, 7, 7]))) for i in range(300)] + [(i, rng.gauss(0, 9)) for i in range(300, 500)]
    d = spark.createDataFrame(rows, "doc_id long, key double")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 57, 120, 499, 500, 900):
        assert sorted(r.doc_id for r in quality.top_k(d, k).collect()) == sorted(i for i, _ in want[:k])
    assert quality.top_k(d.limit(0), 3).count() == 0


def test_sampling_follows_the_weights(spark):
    """Without signal every document is as likely: the Gumbel keys of halves of the ids look alike."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = [r.doc_id for r in quality.sample(d, labels, share=0.5).collect()]
    assert len(half) == 2000 and 900 < sum(i < 2000 for i in half) < 1100


def test_messy(spark):
    d = messy.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (7, 0, 0, "x"), (2, 1, None, "x"), (2, 0, 0, "x"), (None, 1, 0, "x"), (8, None, 0, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    kept = {r.doc_id for r in quality.sample(d, labels).collect()}
    assert 1 in kept and not kept & {None, 3, 4, 5}
    left = quality.keep_sampled(d, labels)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == kept | {None}
    assert {r.doc_id for r in quality.sample(d, labels.limit(0)).collect()} == {1, 2, 6, 7, 8, 9}
    assert quality.sample(d.limit(0), labels).count() == quality.keep_sampled(d.limit(0), labels).count() == 0


def test_k_and_ids_of_any_type(spark):
    docs, labels = corpus(spark)
    docs, labels = (x.withColumn("doc_id", F.concat(F.lit("d-"), "doc_id")) for x in (docs, labels))
    every = sorted(((r.key, r.doc_id) for r in quality.sample(docs, labels, share=1.0).collect()), reverse=True)
    assert len(every) == 600 and {r.doc_id for r in quality.sample(docs, labels, k=100).collect()} == {i for _, i in every[:100]}
    kept = {int(r.doc_id[2:]) for r in quality.keep_sampled(docs, labels).collect()}
    assert sum(i % 4 != 0 for i in kept) >= 0.97 * 450 and sum(i % 4 == 0 for i in kept) <= 0.2 * 150


def test_op8_query(spark):
    """The registered query keeps what its own key says, and of the labels that set the cut most good ones and few others."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in quality.op8(spark, d).collect()}
    every = {r.doc_id for r in docs.where("trim(text) <> ''").collect()}
    assert set(rows) <= every and len(rows) > 0.5 * len(every)
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = [i for i in good if i in every]
    assert np.mean([i in rows for i in held if good[i]]) >= 0.95 and np.mean([i in rows for i in held if not good[i]]) <= 0.5


def test_a_labelled_document_is_judged_by_a_model_without_it(spark):
    """Its key is that of a fit in which its label is missing."""
    docs, labels = corpus(spark)
    slim, labelled = docs, quality.chosen(labels)
    model = quality.fit(slim, labelled)
    good = [r.doc_id for r in labelled.where("good").orderBy("doc_id").limit(3).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in good:
        without = quality.fit(slim, labelled.where(F.col("doc_id") != i))
        (_, b, _), = quality.features(pa.array([texts[i]]), Powers())
        at, n = np.unique(b, return_counts=True)
        assert np.allclose(model.weights(at, n), without.weights(at)) and not np.allclose(model.weights(at), without.weights(at))
