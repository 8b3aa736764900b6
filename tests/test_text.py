import unicodedata
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import embed

VOCAB = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "un", "##aff", "##able", "a", "b", "##b", "[", "]", "cls", "!", "."])}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_controls_go_before_white_space_is_squeezed(spark):
    assert one(spark, "a\x0bb\x0cc\x85d", text.strip_control) == "abcd"
    assert one(spark, " \xa0a\t\n b ﻿", text.squeeze_space) == "a b"
    assert one(spark, "e\x00́ x", text.clean) == "é x"
    assert one(spark, "\xe9", text.nfd) == unicodedata.normalize("NFD", "\xe9")


def test_pretokens(spark):
    assert one(spark, "don't [CLS] a—b. «c»", text.pretokens) == ["don", "'", "t", "[", "CLS", "]", "a—b", ".", "«c»"]
    assert one(spark, "", text.pretokens) == []


@pytest.mark.parametrize("token,want", [("unaffable", ["un", "##aff", "##able"]), ("unaffx", ["[UNK]"]), ("", []), ("a" * 201, ["[UNK]"]), ("ab", ["a", "##b"])])
def test_pieces(token, want):
    assert text.pieces_of(token, VOCAB) == want


def test_longest_word_counts_utf16():
    assert text.pieces_of("\U0001d4d0" * 101, {"\U0001d4d0": 1, "##\U0001d4d0": 2}) == ["[UNK]"]


def test_special_ids():
    assert text.special_ids({}) == {"[CLS]": 101, "[SEP]": 102, "[UNK]": 100}
    with pytest.raises(ValueError):
        text.special_ids({"[CLS]": "x"})


def windows(n):
    return [(0, n)] if n <= 510 else [(i, min(i + 509, n)) for i in range(0, n, 459)]


@pytest.mark.parametrize("n", [0, 1, 509, 510, 511, 918, 919, 968, 969, 1000])
def test_windows(spark, n):
    d = spark.range(1).select(F.expr(f"CASE WHEN {n} = 0 THEN CAST(array() AS array<bigint>) ELSE sequence(0L, {n}L - 1) END").alias("c"))
    got = d.select(text.windows(F.col("c")).alias("w")).first().w
    assert [list(w) for w in got] == [list(range(a, z)) for a, z in windows(n)]


def test_token_chunks(spark):
    d = spark.createDataFrame([(1, "The [CLS] unaffable!"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: (r.tokens, r.ids) for r in text.token_chunks(d, "t", VOCAB).collect()}
    assert got[1] == (["[CLS]", "the", "[", "cls", "]", "un", "##aff", "##able", "!", "[SEP]"], [2, 4, 11, 13, 12, 5, 6, 7, 14, 3])
    assert got[2] == got[3] == (["[CLS]", "[SEP]"], [2, 3])


def test_embedding(spark):
    d = spark.createDataFrame([(1, "the a b"), (2, "the a b"), (3, ""), (4, None), (5, "a " * 1200), (6, "b un")], "id int, t string")
    got = {r.id: r.embedding for r in embed.embed(d, "t", VOCAB, embed.hash_model(16)).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[6]
    assert all(len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-3 for v in got.values())
    assert embed.embed_one(spark, "the a b", VOCAB, embed.hash_model(16)) == got[1]


def test_self_healing():
    calls = []

    def run():
        calls.append("run")
        if len(calls) == 1:
            raise OSError("broken")
        return 7

    assert embed.self_healing(run, lambda: calls.append("reload")) == 7 and calls == ["run", "reload", "run"]
    calls.clear()
    with pytest.raises(OSError):
        embed.self_healing(run, lambda: calls.append("reload"), offline=True)


def test_wordpiece_runs_once_under_a_filter(spark):
    d = spark.createDataFrame([(1, "the unaffable"), (2, ""), (3, None), (4, "ab!")], "id int, t string").select("id", text.pretokens(F.col("t")).alias("pre"))
    cut = text.wordpiece(d, "pre", VOCAB).where(F.size("pieces") > 0).select("id", "pieces", "ids")
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.id: (r.pieces, r.ids) for r in cut.collect()} == {1: (["the", "un", "##aff", "##able"], [4, 5, 6, 7]), 4: (["a", "##b", "!"], [8, 10, 14])}


@pytest.mark.parametrize("tokens,pieces,keep", [(50, 40, 3), (1, 1, 0), (1 << 18, 1 << 18, 1 << 18)])
def test_wordpiece_slices(tokens, pieces, keep):
    """A batch comes back in parts of at most so many pieces, or of one row."""
    words = ["unaffable", "the", "ab", "xyz"]
    rows = [[words[k % 4] for k in range(i % 23)] for i in range(300)] + [["unaffable"] * 99, None, []]
    run = text._pieces(SimpleNamespace(value=VOCAB), 1, "[UNK]", 200, tokens, pieces, keep)
    parts = list(run(iter([pa.array(rows[:200], pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))[200:]])))
    want = [[p for t in r or [] for p in text.pieces_of(t, VOCAB)] for r in rows]
    assert [r for p in parts for r in p.to_pylist()] == [{"pieces": w, "ids": [VOCAB[x] for x in w]} for w in want]
    assert all(len(p) == 1 or len(p.field("pieces").flatten()) <= pieces for p in parts)
