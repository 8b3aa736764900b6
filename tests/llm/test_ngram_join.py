import random
import re
from collections import defaultdict
from importlib import import_module

import messy
import pytest

from quern.llm import ngram_join


def grams(text, n=3):
    words = re.findall(r"[0-9a-z_\u0080-\u009f\u00aa\u00b5\u00ba\u00c0-\u1fff\u2070-\u2fff\u3005-\u3007\u3040-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, threshold=0.6):
    sets = {i: g for i, t in texts.items() if (g := grams(t))}
    by_gram = defaultdict(set)
    for i, g in sets.items():
        for x in g:
            by_gram[x].add(i)
    pairs = {(a, b) for ids in by_gram.values() for a in ids for b in ids if a > b}
    out = {}
    for a, b in pairs:
        s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if s >= threshold:
            out[a, b] = s
    return out


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 200]))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            new = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 20, len(base) // 10])):
                new[rng.randrange(len(new))] = f"v{rng.randrange(400)}"
            texts.append(new)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    texts = random_texts(seed)
    want = brute(texts)
    got = {(r.a, r.b): r.jaccard for r in ngram_join.jaccard_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(want) > 20


def test_frequent_ngrams_and_blocks(spark, monkeypatch):
    """The same with n-grams that don't travel, small parts and groups in several blocks."""
    texts = {**random_texts(5), **{500 + i: f"one and the same text of ten words or so x{i % 40}" for i in range(60)}, **{600 + i: f"but a short one {i}" for i in range(30)}}
    want = brute(texts)
    for name, value in (("FREQUENT", 0), ("FREQUENT_LEAST", 5), ("LOAD", 300), ("BLOCK", 16), ("HELD", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {(r.a, r.b): r.jaccard for r in ngram_join.jaccard_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("b-c", "the same short text"), ("a-b", "the same short text"), ("c", "another"), (None, "the same short text")], "doc_id string, text string")
    assert sorted(map(tuple, ngram_join.jaccard_groups(d).collect())) == [("a-b", "a-b", 2, 0), ("b-c", "a-b", 2, 0)]
    assert sorted(r.doc_id or "" for r in ngram_join.keep_one(d).collect()) == ["", "a-b", "c"]


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pairs = brute(texts)
    want = groups(pairs)
    rows = ngram_join.op9(spark, sf).collect()
    sets = {i: frozenset(grams(t)) for i, t in texts.items()}
    links = defaultdict(set)
    for a, b in pairs:
        if sets[a] != sets[b]:
            links[a].add(sets[b])
            links[b].add(sets[a])
    assert all(r.n_links == len(links[r.doc_id]) for r in rows)
    got = {r.doc_id: r.group_id for r in rows}
    assert len(want) > 10 and got == want
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.group_id] += 1
    assert all(r.group_size == sizes[r.group_id] for r in rows)


def test_a_chain_is_one_group_and_many_copies_are_cheap(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[: 60 - k] + [f"x{k}-{j}" for j in range(k)]) for k in range(0, 36, 6)]
    texts = chain + ["the same text of many copies that are all alike here"] * 3000
    d = messy.table(spark, *texts)
    rows = {r.doc_id: r for r in ngram_join.jaccard_groups(d).collect()}
    want = groups(brute(dict(enumerate(chain))))
    assert {k: r.group_id for k, r in rows.items() if k < len(chain)} == want
    assert {rows[k].group_id for k in range(len(chain), len(texts))} == {len(chain)} and rows[len(texts) - 1].group_size == 3000
    assert ngram_join.keep_one(d).count() == len(texts) - len(rows) + len({r.group_id for r in rows.values()})


def test_messy(spark):
    d = messy.docs(spark)
    assert [tuple(r) for r in ngram_join.jaccard_groups(d).orderBy("doc_id").collect()] == [(1, 1, 2, 0), (2, 1, 2, 0)]
    left = ngram_join.keep_one(d)
    assert left.columns == d.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 8, 9]
    none = d.limit(0)
    assert ngram_join.jaccard_groups(none).count() == ngram_join.jaccard_pairs(none).count() == ngram_join.keep_one(none).count() == 0


def test_query_of_pairs(spark, sf):
    """Every pair is right, and with the documents of equal sets all pairs follow from them."""
    held = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(held)
    found = import_module("__spark_entry__").queries()["op9_jaccard_pairs"](spark, sf)
    assert found.columns == ["a", "b", "jaccard"]
    got = {(r.a, r.b): r.jaccard for r in found.collect()}
    least = {}
    for i, g in sorted((i, g) for i, t in held.items() if (g := grams(t))):
        least.setdefault(frozenset(g), i)
    rep = {i: least[frozenset(g)] for i, t in held.items() if (g := grams(t))}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert all(got[i, r] == 1 for i, r in rep.items() if i != r)
    follow = {(a, b) for a, b in want if rep[a] == rep[b] or (max(rep[a], rep[b]), min(rep[a], rep[b])) in got}
    assert len(follow) == len(want) > 10 and all(rep[a] == b or rep[a] == a and rep[b] == b for a, b in got)
