"""Token counts and language identification: both walk segmentation lattices."""

import math
import random
import time

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, lattice, token_counts

SMALL = lattice.vocabulary(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "é", "aé", "bab", "abab"])


def segmentations(word, vocab, longest=8):
    """All ways to cut a word in pieces, or in the bytes of a character that is no piece."""
    if not word:
        yield []
    for k in range(1, min(longest, len(word)) + 1):
        if word[:k] in vocab:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], vocab))
        elif k == 1:
            n = len(word[0].encode())
            yield from ([None] * n + rest for rest in segmentations(word[1:], vocab))


def some_words():
    rng = random.Random(4)
    out = {"▁" + "".join(rng.choice("abéx東") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    return sorted(out | {"▁a", "▁abababab"})


def test_best_and_sum_against_all_segmentations():
    words, vocab = some_words(), {t: i for i, t in enumerate(SMALL.texts)}
    score = lattice.zipf(SMALL.size)
    byte = score.min() - lattice.BYTE_PENALTY
    logp = np.append(score, byte)[:, None]
    total, n = lattice.viterbi(words, SMALL, score)
    alone = lattice.viterbi(words, SMALL, score, share=False)
    sums = lattice.forward(words, SMALL, logp)[:, 0]
    assert np.array_equal(total, alone[0]) and np.array_equal(n, alone[1])
    uses = np.zeros(SMALL.size + 1)
    for i, w in enumerate(words):
        each = [(sum(score[vocab[p]] if p else byte for p in s), len(s), s) for s in segmentations(w, vocab)]
        best = max(e[0] for e in each)
        assert abs(total[i] - best) < 1e-9 and n[i] == min(e[1] for e in each if abs(e[0] - best) < 1e-9)
        whole = math.log(sum(math.exp(e[0] - best) for e in each)) + best
        assert abs(sums[i] - whole) < 1e-9
        for s, _, parts in each:
            for p in parts:
                uses[vocab[p] if p else -1] += math.exp(s - whole)
    got = lattice.expected(words, np.ones((len(words), 1)), SMALL, logp)[:, 0]
    assert np.allclose(got, uses)


def best(word, vocab, score, byte, longest):
    """Score and pieces of the best segmentation, character by character."""
    known = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        each = [(known[d - k][0] + score[i], -known[d - k][1] - 1) for k in range(1, min(d, longest) + 1) if (i := vocab.get(word[d - k : d])) is not None]
        if word[d - 1] not in vocab:
            n = len(word[d - 1].encode())
            each.append((known[d - 1][0] + n * byte, -known[d - 1][1] - n))
        s, n = max(each)
        known.append((s, -n))
    return known[-1]


def whole_sum(word, vocab, logp, longest):
    known = [0.0]
    for d in range(1, len(word) + 1):
        each = [known[d - k] + logp[i] for k in range(1, min(d, longest) + 1) if (i := vocab.get(word[d - k : d])) is not None]
        if word[d - 1] not in vocab:
            each.append(known[d - 1] + len(word[d - 1].encode()) * logp[-1])
        known.append(max(each) + math.log(sum(math.exp(x - max(each)) for x in each)))
    return known[-1]


@pytest.mark.parametrize("ahead", [1, 7, 1 << 16])
def test_words_of_any_length(ahead, monkeypatch):
    monkeypatch.setattr(lattice, "AHEAD", ahead)
    rng = random.Random(8)
    stem = "▁" + "".join(rng.choice("abéx東\U0001f600") for _ in range(500))
    words = sorted({*some_words(), stem, stem + "ab", stem[:300], stem[:300] + "b" * 90, "▁" + "ab" * 700, "▁" + "東" * 65})
    vocab, score = {t: i for i, t in enumerate(SMALL.texts)}, lattice.zipf(SMALL.size)
    logp = np.append(score, score.min() - lattice.BYTE_PENALTY)
    total, n = lattice.viterbi(words, SMALL, score)
    alone = lattice.viterbi(words, SMALL, score, share=False)
    sums = lattice.forward(words, SMALL, logp[:, None])[:, 0]
    assert np.allclose(sums, lattice.forward(words, SMALL, logp[:, None], share=False)[:, 0])
    for i, w in enumerate(words):
        s, k = best(w, vocab, score, logp[-1], SMALL.longest)
        assert abs(total[i] - s) < 1e-9 * max(1, len(w)) and n[i] == k == alone[1][i]
        assert abs(sums[i] - whole_sum(w, vocab, logp, SMALL.longest)) < 1e-8 * len(w)


def test_a_prefix_is_worked_out_once():
    rng = random.Random(2)
    stem = "▁" + "".join(rng.choice("ab") for _ in range(300))
    words = sorted(stem + x for x in ("", "a", "ab", "b", "bb"))
    nodes = [sum(len(s.word) for s in lattice.stretches(words, SMALL, lattice.Powers(), share)) for share in (True, False)]
    assert nodes == [len(stem) + 4, sum(map(len, words))]


def test_a_very_long_word_in_time():
    word, vocab = "▁" + "qwertzuiopasdfgh" * 6_250, lattice.load()
    logp = np.repeat(np.append(lattice.zipf(vocab.size), -30.0)[:, None], 4, axis=1)
    began = time.monotonic()
    lattice.viterbi([word], vocab, lattice.zipf(vocab.size))
    lattice.forward([word], vocab, logp)
    used = lattice.expected([word], np.ones((1, 4)), vocab, logp)
    assert time.monotonic() - began < 60
    assert np.allclose(np.array([len(t) for t in vocab.texts] + [1]) @ used, len(word))


def test_languages_without_spaces(spark):
    rng = random.Random(5)
    signs = {"zh": "的一是不了在人有我他这中大来上国", "ja": "のにはをたがでてとしれさあるいも"}
    rows = [(i, "".join(rng.choice(signs[x]) for _ in range(300)), x) for i, x in enumerate(["zh", "ja"] * 20)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang for r in found.collect()} == {i: x for i, _, x in rows}


def test_op7_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op7(spark, sf).join(docs.withColumnRenamed("lang", "told"), "doc_id").where("n_chars >= 100").collect()
    assert len(rows) > 50 and np.mean([r.lang == r.told for r in rows]) >= 0.97


def test_token_counts_against_brute_force(spark, sf):
    vocab = lattice.load()
    index = {t: i for i, t in enumerate(vocab.texts)}
    score = lattice.zipf(vocab.size)
    byte, known = float(score.min()) - lattice.BYTE_PENALTY, {}
    got = {r.doc_id: r for r in token_counts.op3(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in sorted(docs, key=lambda r: len(r.text or ""))[:150]:
        words = ["▁" + w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") for w in w.split() if w]
        for w in words:
            if w not in known:
                known[w] = best(w, index, score, byte, vocab.longest)
        g = got[r.doc_id]
        assert (g.n_words, g.n_tokens) == (len(words), sum(known[w][1] for w in words))
        assert abs(g.log_prob - sum(known[w][0] for w in words)) < 1e-6 * max(1, abs(g.log_prob))


def test_token_counts_messy(spark):
    rows = {r.doc_id: r for r in token_counts.count_tokens(messy.docs(spark)).collect()}
    assert sorted(rows) == list(range(1, 10))
    assert [rows[i].n_tokens for i in (3, 4, 5)] == [0, 0, 0] and rows[6].n_words == 40_000
    assert token_counts.count_tokens(messy.docs(spark).limit(0)).count() == 0
    assert token_counts.count_tokens(messy.docs(spark, [messy.UNSPACED])).first().n_words == 1


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), max_labelled=60)
    right = found.withColumnRenamed("lang", "got").join(docs, "doc_id").where("n_chars >= 100").agg(F.avg((F.col("got") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.97


def test_language_scores_against_brute_force(spark):
    d = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "the the", None)], "doc_id long, text string, lang string")
    held = spark.sparkContext.broadcast(lattice.load().parts())
    languages, logp = langid.fit(d, held)
    vocab = lattice.load()
    index = {t: i for i, t in enumerate(vocab.texts)}
    for r in langid.identify(d).collect():
        text = {1: "the cat and the dog", 2: "der Hund und die Katze", 3: "the the"}[r.doc_id]
        each = [sum(math.log(sum(math.exp(sum(logp[index[p] if p else -1, m] for p in s)) for s in segmentations("▁" + w, index))) for w in text.split()) for m in range(2)]
        assert r.lang == languages[int(np.argmax(each))] and abs(r.log_prob - max(each)) < 1e-6
        assert abs(r.posterior - 1 / sum(math.exp(x - max(each)) for x in each)) < 1e-9


def test_languages_messy(spark):
    d = messy.docs(spark)
    rows = {r.doc_id: r for r in langid.identify(d).collect()}
    assert sorted(rows) == list(range(1, 10)) and all(tuple(rows[i])[1:] == (None, None, None) for i in (3, 4, 5))
    assert {rows[i].lang for i in (1, 2, 6, 7, 8, 9)} <= {"en", "de"}
    assert langid.identify(d.limit(0)).count() == 0
    assert {r.doc_id: r.lang for r in langid.identify(messy.docs(spark, [*messy.ROWS[:3], messy.UNSPACED])).collect()}[10] == "de"
    assert {r.lang for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def test_long_words_count_in_the_fit():
    words = [*some_words(), "▁" + "abébx" * 20]
    counts = np.ones((len(words), 2))
    logp = np.repeat(np.append(lattice.zipf(SMALL.size), -9.0)[:, None], 2, axis=1)
    whole = lattice.expected(words, counts, SMALL, logp)
    size = np.array([len(t) for t in SMALL.texts] + [0])
    alone = lattice.expected(words[-1:], counts[:1], SMALL, logp)
    assert np.allclose(size @ alone + alone[-1], len(words[-1]))
    assert np.allclose(whole - lattice.expected(words[:-1], counts[:-1], SMALL, logp), alone)


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("a-b", "the cat and the dog", "en"), ("c", "der Hund und die Katze", "de")], "doc_id string, text string, lang string")
    assert {r.doc_id: r.n_words for r in token_counts.count_tokens(d).collect()} == {"a-b": 5, "c": 5}
    assert {r.doc_id: r.lang for r in langid.identify(d).collect()} == {"a-b": "en", "c": "de"}
