import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import search


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.s for r in d.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert abs(got[0] - 1) < 1e-12 and math.isnan(got[1]) and math.isnan(got[2]) and abs(got[3] - 1 / math.sqrt(2)) < 1e-12


def test_normalised_and_finite(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("inf"), 1.0],), ([float("nan")],), ([None, 1.0],)], "v array<float>")
    got = d.select(vectors.normalised(F.col("v")).alias("n"), vectors.all_finite(F.col("v")).alias("f")).collect()
    assert [round(x, 6) for x in got[0].n] == [0.6, 0.8] and all(math.isnan(x) for x in got[1].n)
    assert [r.f for r in got] == [True, True, False, False, False]


def test_means_count_windows_alike(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "id int, v array<float>")
    assert {r.id: r.v for r in vectors.mean_by(d, ["id"], "v").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def test_flatten_and_back(spark):
    d = spark.createDataFrame([(2, [5.0, 6.0]), (1, [1.0, 2.0])], "o int, v array<float>")
    flat = vectors.flatten(d, "o", "v")
    assert flat.first().flat == [1.0, 2.0, 5.0, 6.0]
    assert [(r.ord, r.vector) for r in vectors.unflatten(flat, "flat", 2).collect()] == [(0, [1.0, 2.0]), (1, [5.0, 6.0])]
    assert vectors.unflatten(vectors.flatten(d.limit(0), "o", "v"), "flat", 2).count() == 0


def test_order_of_equals_and_nan(spark):
    d = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (0, [0.0, 1.0])], "ord int, embedding array<float>")
    assert [r.ord for r in search.search_vectors(d, [1.0, 0.0]).collect()] == [1, 3, 0, 2]
    assert [r.ord for r in search.search_vectors(d, [1.0, 0.0], 2).collect()] == [1, 3]


def test_batch_both_ways(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, v array<float>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:7]], "query_id string, query array<float>")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else math.nan

    want = {}
    for i, a in rows[:7]:
        best = sorted(((-round(s, 12) if not math.isnan(s := cosine(a, b)) else math.inf, j) for j, b in rows))[:4]
        want[f"q{i}"] = [(j, None if s == math.inf else -s) for s, j in best]
    for values, block in ((1 << 20, 1 << 20), (6, 1 << 20), (1 << 20, 2048), (6, 1)):
        got = {}
        for r in search.nearest_batch(d, q, 4, "id", "v", pass_values=values, block_values=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, None if math.isnan(r.similarity) else round(r.similarity, 12)))
        assert {k: sorted(s is not None and s for _, s in v) for k, v in got.items()} == {k: sorted(s is not None and s for _, s in v) for k, v in want.items()}
    assert search.nearest_batch(d, q.limit(0), 4, "id", "v").count() == 0
    assert search.nearest_batch(d.limit(0), q, 4, "id", "v").count() == 0


def test_batch_with_copies_and_no_direction(spark):
    """Copies tie exactly and come by their keys; zero and NaN vectors come last; keys may be texts;
    more rows than queries and the other way round; missing values are NaN."""
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(40)] + [[0.0] * 7, [math.nan] + [1.0] * 6, [None] + [1.0] * 6, [math.inf] * 7]
    rows = [(f"{i * 37 % 1000:03}", some[i % 44] if i % 3 else some[0]) for i in range(300)]
    asked = [(f"q{i:03}", v) for i, (_, v) in enumerate(rows)]

    def cosine(a, b):
        if not all(x is not None and math.isfinite(x) for x in a + b) or not any(a) or not any(b):
            return None
        return 1.0 if a == b else round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)

    d = spark.createDataFrame(rows, "id string, v array<double>").repartition(7)
    for own in (asked, asked[:50], asked * 2):
        q = spark.createDataFrame([(f"{x}-{n}", v) for n, (x, v) in enumerate(own)], "query_id string, query array<double>").repartition(3)
        want = {f"{x}-{n}": [(i, s) for _, i, s in sorted((-c if c is not None else 9, i, c) for i, v in rows for c in [cosine(a, v)])[:6]] for n, (x, a) in enumerate(own)}
        for values in (1 << 20, 500):
            got = {}
            for r in search.nearest_batch(d, q, 6, "id", "v", pass_values=values).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.id, None if math.isnan(r.similarity) else round(r.similarity, 9)))
            assert got == want


def test_batch_sorts_candidates_alone(monkeypatch):
    """All rows used to be sorted for each query; now those alone that may be among the nearest."""
    rng, worked = np.random.default_rng(6), []
    m, real = rng.normal(size=(20_000, 16)).astype(np.float32), search._products
    monkeypatch.setattr(search, "_products", lambda a, b: worked.append(len(a)) or real(a, b))
    run = search._by_rows(SimpleNamespace(value=(pa.array(range(20_000)), m)), 5, ["q", "id", "s"], 1 << 20)
    given = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(list(m[:300]))], names=["q", "v"])
    got = pa.Table.from_batches(run(iter([given]))).to_pandas().sort_values(["q", "s", "id"], ascending=[True, False, True])
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    assert (got.id.to_numpy().reshape(300, 5) == np.argsort(-(x[:300] @ x.T), axis=1)[:, :5]).all()
    assert sum(worked) - 20_300 < 0.01 * 300 * 20_000


def test_batch_of_one_vector_many_times():
    ids, m = search._fewest(pa.array([*range(500, 0, -1), 501]), np.array([[1.0, 2.0]] * 500 + [[2.0, 1.0]]), 3)
    assert ids.to_pylist() == [3, 2, 1, 501] and m.tolist() == [[1.0, 2.0]] * 3 + [[2.0, 1.0]]


@pytest.mark.parametrize("rows", [[[1.0], None], [[1.0], [1.0, 2.0]]])
def test_batch_wants_vectors_of_one_length(rows):
    with pytest.raises(ValueError):
        search._matrix(pa.array(rows, pa.list_(pa.float32())))


def test_joined_text(spark):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "r int, content string")
    assert search.joined_text(d, [F.asc("r")]).first().text == "a\n---\nb"
    assert search.joined_text(d.limit(0), [F.asc("r")]).first().text == ""
