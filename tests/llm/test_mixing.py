import math
import random
from collections import Counter, defaultdict

import messy
import numpy as np
from pyspark.sql import functions as F

from quern.llm import mixing, token_counts



def corpus(spark, n=900):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        s = rng.choice(["web", "web", "web", "books", "code"])
        rows.append((i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice(["en", "de"]) if s != "code" else "en", s))
    return spark.createDataFrame(rows, messy.SCHEMA), rows


def solve(tokens, source, lang, target):
    """The dual solved over single documents by plain Newton steps with dense matrices."""
    sources, langs = sorted(target), sorted(set(lang))
    z = np.log1p(tokens)
    mean = (tokens * z).sum() / tokens.sum()
    x = np.column_stack([np.array(source)[:, None] == sources, np.array(lang)[:, None] == langs, z - mean]).astype(float)
    budget = sum(target.values())
    share = [tokens[np.array(lang) == k].sum() / tokens.sum() * budget for k in langs]
    goal = np.array([target[s] for s in sources] + share + [0.0])
    ridge = np.array([0.0] * len(sources) + [mixing.SOFT * budget] * (len(langs) + 1))
    t = np.zeros(len(goal))

    def value(t):
        return (tokens * np.exp(x @ t)).sum() - t @ goal + 0.5 * (ridge * t * t).sum()

    for _ in range(200):
        w = tokens * np.exp(x @ t)
        step = np.linalg.lstsq((x * w[:, None]).T @ x + np.diag(ridge), goal - x.T @ w - ridge * t, rcond=None)[0]
        size = 1.0
        while value(t + size * step) > value(t) + 1e-12 and size > 1e-9:
            size /= 2
        t = t + size * step
    return np.exp(x @ t)


def test_rates_against_a_dense_solver(spark):
    d, rows = corpus(spark)
    weights = {"web": 1.0, "books": 2.0, "code": 1.0}
    got = {r.doc_id: r for r in mixing.copies(d, weights).collect()}
    tokens = np.array([len(r[1].split()) for r in rows], float)
    whole = tokens.sum()
    want = solve(tokens, [r[3] for r in rows], [r[2] for r in rows], {s: w / 4 * whole for s, w in weights.items()})
    assert max(abs(got[i].rate / want[i] - 1) for i in range(len(rows))) < 1e-5
    by = defaultdict(float)
    for r in got.values():
        by[r.source] += r.rate * r.tokens
    assert all(abs(by[s] - w / 4 * whole) < 1e-6 * whole for s, w in weights.items())


def test_copies_keep_the_totals_of_their_class(spark):
    d, rows = corpus(spark)
    got = mixing.copies(d, {"web": 0.5, "books": 3.0, "code": 1.0}, budget=50_000).collect()
    rate, n = defaultdict(float), Counter()
    for r in got:
        k = (r.source, r.lang, int(math.log2(r.tokens + 1)))
        rate[k] += r.rate
        n[k] += r.copies
        assert math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1
    assert all(abs(rate[k] - n[k]) < 1 for k in rate)
    mixed = mixing.mix(d, {"web": 0.5, "books": 3.0, "code": 1.0}, budget=50_000).collect()
    seen = Counter(r.doc_id for r in mixed)
    assert seen == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert all({r.copy for r in mixed if r.doc_id == i} == set(range(1, c + 1)) for i, c in list(seen.items())[:50])


def test_sources_without_weight_get_nothing(spark):
    d, _ = corpus(spark, 200)
    got = mixing.copies(d, {"web": 1.0, "nowhere": 5.0}).collect()
    assert all((r.rate == 0 and r.copies == 0) == (r.source != "web") for r in got)
    assert all(r.rate == 0 for r in mixing.copies(d, {}).collect())


def test_query_meets_its_targets(spark, sf):
    rows = mixing.op1(spark, sf).collect()
    counted = {r.doc_id: r.n_tokens for r in token_counts.op3(spark, sf).collect()}
    tokens, tilted = Counter(), Counter()
    for r in rows:
        tokens[r.source] += r.tokens
        tilted[r.source] += r.tokens * r.rate
    assert {r.doc_id: r.tokens for r in rows} == counted
    raw = {s: t**mixing.TEMPERATURE for s, t in tokens.items() if t}
    assert all(abs(tilted[s] / sum(tokens.values()) - raw[s] / sum(raw.values())) < 1e-6 for s in raw)


def test_messy(spark):
    d = messy.docs(spark)
    rows = {r.doc_id: r for r in mixing.copies(d).collect()}
    assert sorted(rows) == list(range(1, 10)) and [rows[i].tokens for i in (3, 4, 5)] == [0, 0, 0] and rows[6].source == ""
    out = mixing.mix(d)
    assert out.columns == [c for c in d.columns if c != "copy"] + ["copy"] and out.where("doc_id is null").count() == 0
    assert mixing.copies(d.limit(0)).count() == mixing.mix(d.limit(0)).count() == 0
    blank = d.withColumn("text", F.lit(""))
    assert {r.rate for r in mixing.copies(blank).collect()} == {0.0} and mixing.mix(blank).count() == 0


def test_many_sources_and_ids_of_any_type(spark):
    """Every source meets its target, with one language and with two, whatever their number."""
    rng = random.Random(3)
    rows = [(f"d-{i}", " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["en", "de"]), f"host{i % 400}", 2 * i + 1) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, size int")
    got = mixing.copies(d, tokens="size").collect()
    assert {r.doc_id: r.tokens for r in got} == {r[0]: r[4] for r in rows}
    total, tilted = Counter(), Counter()
    for r in got:
        total[r.source] += r.tokens
        tilted[r.source] += r.tokens * r.rate
    raw = {s: t**mixing.TEMPERATURE for s, t in total.items()}
    assert all(abs(tilted[s] / sum(total.values()) - raw[s] / sum(raw.values())) < 1e-9 for s in raw)
    want = solve(np.array([r[4] for r in rows], float), [r[3] for r in rows], [r[2] for r in rows], {s: raw[s] / sum(raw.values()) * sum(total.values()) for s in raw})
    rate = {r.doc_id: r.rate for r in got}
    assert max(abs(rate[r[0]] / w - 1) for r, w in zip(rows, want)) < 1e-5
