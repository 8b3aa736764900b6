import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import fuzzy
from quern.operators import search


def table_distance(a, b):
    """Edit distance from the textbook table: half for one more or one less, one for another."""
    row = [j / 2 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i / 2]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 0.5, new[-1] + 0.5, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def score(a, b):
    a, b = a.lower(), b.lower()
    n = max(len(a), len(b))
    return 1.0 if n == 0 else 1 - table_distance(a, b) / n


WORDS = ["", "a", "Books", "books", "AdminService.Books", "CatalogService.Books", "é", "straße", "x" * 70, "my.Authors", "ab" * 40]


def test_columns_and_literals(spark):
    pairs = spark.createDataFrame([(a, b) for a in WORDS for b in WORDS], "a string, b string")
    for r in pairs.withColumn("s", fuzzy.score(F.col("a"), F.col("b"))).collect():
        assert r.s == score(r.a, r.b), r
    for a in WORDS:
        for r in pairs.select("b").distinct().withColumn("s", fuzzy.score(a, F.col("b"))).collect():
            assert r.s == score(a, r.b), (a, r)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abcXé .", max_size=25), st.text("abcXé .", max_size=25)), min_size=1, max_size=30))
def test_random_pairs(spark, pairs):
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("s", fuzzy.score(F.col("a"), F.col("b"))).withColumn("t", fuzzy.score(pairs[0][0], F.col("b"))).collect()
    assert [(r.s, r.t) for r in got] == [(score(a, b), score(pairs[0][0], b)) for a, b in pairs]


def test_nulls(spark):
    d = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r.s for r in d.select(fuzzy.score(F.col("a"), F.col("b")).alias("s")).collect()] == [None, None]
    assert [r.s for r in d.select(fuzzy.score("x", F.col("b")).alias("s")).collect()] == [0.5 * 0, None]


def test_known_scores(spark):
    names = ["AdminService.Books", "CatalogService.Books", "org.sample.bookshop.Books"]
    d = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    got = search.fuzzy_top_n(d, "Books").collect()
    assert [(r.name, round(r.score, 4)) for r in got] == [(names[0], 0.6389), (names[1], 0.625), (names[2], 0.6)]


def test_empty_term_keeps_the_order_of_declaration(spark):
    d = spark.createDataFrame([(2, "b"), (0, "zz"), (1, "")], "ord long, name string")
    assert [(r.name, r.score) for r in search.fuzzy_top_n(d, "").collect()] == [("", 1.0), ("zz", 0.5), ("b", 0.5)]


@pytest.mark.parametrize("n,want", [(None, 5), (0, 0), (-2, 3), (-9, 0), ("2", 2), (1.9, 1), (float("nan"), 0), ("x", 0), (99, 5), (float("inf"), 5)])
def test_number_of_results(spark, n, want):
    d = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "ord long, name string")
    assert [r.ord for r in search.first_n(d, [F.asc("ord")], n).collect()] == list(range(want))


def test_smallest_score_zero_is_none(spark):
    d = spark.createDataFrame([(0, "abc"), (1, "xyz")], "ord long, name string")
    assert search.fuzzy_top_n(d, "abc", least=0).count() == 2
    assert search.fuzzy_top_n(d, "abc", least=0.9).count() == 1


def test_kind(spark):
    d = spark.createDataFrame([(0, "a", "entity"), (1, "b", "Entity"), (2, "c", None)], "ord long, name string, kind string")
    assert [search.of_kind(d, k).count() for k in (None, "", "entity", "x")] == [3, 3, 1, 0]
