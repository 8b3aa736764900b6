import random
import re

import messy

from quern.llm import decontam, ngram_join, quality

TOKEN = re.compile(r"[0-9a-z_\u0080-\u009f\u00aa\u00b5\u00ba\u00c0-\u1fff\u2070-\u2fff\u3005-\u3007\u3040-\U0010ffff]+")


def brute_tiles(item, doc, m):
    """Greedy string tiling as the textbook has it: all longest unmarked common runs, over and over."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= m and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return sorted(tiles)
        n, i, d = best
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
        tiles.append((i, d, n))


def brute(docs, items, m=decontam.MIN_MATCH, coverage=decontam.COVERAGE):
    out = {}
    for a, x in docs.items():
        for b, y in items.items():
            doc, item = TOKEN.findall((x or "").lower()), TOKEN.findall((y or "").lower())
            tiles = brute_tiles(item, doc, m)
            n = sum(t[2] for t in tiles)
            if n and n >= coverage * len(item):
                out[a, b] = (len(item), n, tiles)
    return out


def result(df):
    return {(r.doc_id, r.item_id): (r.item_tokens, r.covered_tokens, [tuple(t) for t in r.tiles]) for r in df.collect()}


def cases():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = {i: [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 30]))] for i in range(8)}
    docs = {}
    for k in range(30):
        item = items[rng.randrange(8)]
        parts = [item[i : i + 7] for i in range(0, len(item), 7)]
        rng.shuffle(parts)
        body = [w for p in parts for w in [*p, *([rng.choice(words)] if rng.random() < 0.4 else [])]]
        docs[k] = [rng.choice(words) for _ in range(rng.randrange(20))] + (body if rng.random() < 0.8 else []) + [rng.choice(words) for _ in range(10)]
    return {k: " ".join(v) for k, v in docs.items()}, {k: ", ".join(v).upper() for k, v in items.items()}


def frames(spark, docs, items):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")


def test_against_brute_force_both_ways(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 10 and any(len(t[2]) > 1 for t in want.values())
    d, b = frames(spark, docs, items)
    assert result(decontam.contamination(d, b)) == want
    assert result(decontam.contamination(d, b, broadcast_chars=0)) == want


def test_reordered_passages_are_caught(spark):
    item = [f"q{i}" for i in range(40)]
    moved = item[20:40] + ["and"] + item[:20]
    d, b = frames(spark, {1: " ".join(moved), 2: " ".join(item[:15])}, {9: " ".join(item)})
    assert [(r.doc_id, r.covered_tokens, r.n_tiles) for r in decontam.contamination(d, b).collect()] == [(1, 40, 2)]
    assert [r.doc_id for r in decontam.drop_contaminated(d, b).collect()] == [2]


def test_query_against_brute_force_of_its_items(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = result(decontam.op10(spark, sf))
    rng, some = random.Random(1), set(got)
    near = set()
    for a, x in docs.items():
        doc = TOKEN.findall((x or "").lower())
        runs = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        near |= {(a, b) for b, y in items.items() if any(tuple(t[i : i + 5]) in runs for t in [TOKEN.findall(y.lower())] for i in range(len(t) - 4))}
    assert some <= near and some
    for a, b in sorted(near, key=lambda p: (len(docs[p[0]]), p))[:40]:
        want = brute({a: docs[a]}, {b: items[b]})
        assert got.get((a, b)) == want.get((a, b))


def test_messy(spark):
    d = messy.docs(spark)
    items = spark.createDataFrame([(1, "fox jumps over the lazy dog near the river", "x"), (1, "zzz", "x"), (2, None, "x"), (3, "", "x"), (None, "quick brown fox jumps over", "x"), (4, "over the lazy", "x"), (5, "FOX jumps, over the lazy dog near the river!", "x")], "item_id long, text string, doc_id string")
    got = result(decontam.contamination(d, items))
    assert sorted(got) == [(1, 1), (1, 5), (2, 1), (2, 5)]
    left = decontam.drop_contaminated(d, items)
    assert left.columns == d.columns and messy.kept(left) == sorted(x for x in messy.kept(d) if not x.startswith(("(1,", "(2,")))
    assert decontam.contamination(d.limit(0), items).count() == decontam.contamination(d, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(d, items.limit(0)).count() == d.count()


def test_every_text_of_a_repeated_id_is_judged(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, None), (1, f"zz {item}"), (2, "a plain text"), (2, f"b {item}"), (2, "b one two three four five"), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    for chars in (decontam.BROADCAST_CHARS, 0):
        assert sorted((r.doc_id, r.item_id, r.covered_tokens) for r in decontam.contamination(d, b, broadcast_chars=chars).collect()) == [(1, 7, 10), (2, 7, 10)]
    assert [r.doc_id for r in decontam.drop_contaminated(d, b).collect()] == [3]


def test_a_null_row_does_not_stand_for_its_document(spark):
    text = "a long and clean text of some words that are all its own"
    d = spark.createDataFrame([(1, None), (1, text), (2, ""), (2, text + " indeed")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in quality.keep_sampled(d, labels).collect()) == [1, 1, 2, 2]
    assert [(r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()] == [(1, text)]


def test_signs_of_typography_are_no_words(spark):
    item = "he said that it was not the end of it all"
    d, b = frames(spark, {1: "“he said”—that\u00a0it was… «not the end» of it all’", 2: "„he said that it was“, then"}, {9: item})
    assert [(r.doc_id, r.covered_tokens) for r in decontam.contamination(d, b).collect()] == [(1, 11)]
    assert [(r.a, r.b) for r in ngram_join.jaccard_pairs(messy.table(spark, item, "“he said”—that\u00a0it was… «not the end» of it all’")).collect()] == [(1, 0)]


def test_ids_of_any_type(spark):
    item = "one two three four five six seven eight"
    d = spark.createDataFrame([("a-b", f"x {item}"), ("c", "clean"), (None, item)], "doc_id string, text string")
    b = spark.createDataFrame([("q/1", item), (None, item)], "item_id string, text string")
    for chars in (decontam.BROADCAST_CHARS, 0):
        assert [(r.doc_id, r.item_id, r.coverage) for r in decontam.contamination(d, b, broadcast_chars=chars).collect()] == [("a-b", "q/1", 1.0)]
    assert sorted(r.doc_id or "" for r in decontam.drop_contaminated(d, b).collect()) == ["", "c"]
