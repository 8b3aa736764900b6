"""The two searches: names by fuzzy score and vectors by cosine, with exact and stable order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fuzzy, vectors

#: Values of the side that is sent to all tasks in a pass, and in a block that is multiplied at once.
PASS_VALUES = 16 << 20
BLOCK_VALUES = 1 << 20
#: Pairs of a query and a row that a task compares in a pass, where queries stream by.
TASK_PAIRS = 1 << 28


def normalise_n(n: object = None) -> int | None:
    """A number of results as ECMAScript's slice(0, n) takes it: None is all, strings are read as
    numbers, fractions lose their part, what is no number is 0, and a negative one counts from the end."""
    if n is None:
        return None
    try:
        x = float(n.strip() or 0) if isinstance(n, str) else float(n)
    except (TypeError, ValueError):
        return 0
    if math.isnan(x):
        return 0
    return None if x == math.inf else -(1 << 62) if x == -math.inf else math.trunc(x)


def first_n(df: DataFrame, order: Sequence[Column], n: object = None) -> DataFrame:
    """df in order and cut as slice(0, n) does. With a limit Spark keeps the best of each partition
    and never sorts as a whole; a negative n needs a count first."""
    n, ranked = normalise_n(n), df.orderBy(*order)
    if n is None:
        return ranked
    return ranked.limit(min(n if n >= 0 else max(0, df.count() + n), (1 << 31) - 1))


def of_kind(definitions: DataFrame, kind: str | None) -> DataFrame:
    """Those of exactly this kind; all if it isn't given or empty."""
    return definitions.where(F.col("kind") == kind) if kind else definitions


def fuzzy_top_n(df: DataFrame, term: str, n: object = None, least: float | None = None, item: str = "name", order: str = "ord") -> DataFrame:
    """df with the score of a column against a term, best first and equals in the order of order.
    least: smallest score to keep; 0 and None keep all."""
    scored = df.withColumn("score", fuzzy.score(term, F.col(item)))
    if least:
        scored = scored.where(F.col("score") >= least)
    return first_n(scored, [F.desc("score"), F.asc(order)], n)


def fuzzy_join(terms: DataFrame, names: DataFrame, term: str, item: str) -> DataFrame:
    """Every term against every name, with the score. The product is the result; Spark broadcasts
    a side only by its own size limit."""
    return terms.crossJoin(names).withColumn("score", fuzzy.score(F.col(term), F.col(item)))


def similarity_order(order: str, similarity: str = "similarity") -> list[Column]:
    """Most similar first, NaN last, equals in the order of order."""
    return [F.isnan(similarity).asc(), F.desc(similarity), F.asc(order)]


def with_similarity(df: DataFrame, query: Sequence[float], vec: str = "embedding", norm: str | None = None) -> DataFrame:
    """df with the cosine similarity of a vector column to the query; norm: a column that has the vectors' norms."""
    q = vectors.vector(query)
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    return df.withColumn("similarity", vectors.cosine(q, F.col(vec), F.lit(size), F.col(norm) if norm else None))


def search_vectors(df: DataFrame, query: Sequence[float], n: object = None, vec: str = "embedding", order: str = "ord", norm: str | None = None) -> DataFrame:
    """All rows by similarity to the query, or the first n."""
    return first_n(with_similarity(df, query, vec, norm), similarity_order(order), n)


def nearest_batch(df: DataFrame, queries: DataFrame, k: int, key: str, vec: str, query_key: str = "query_id", query_vec: str = "query", pass_values: int = PASS_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_key, key, similarity, rank) of the k nearest rows to each query, exactly; vectors of one length.

    The side with fewer values is sent to all tasks, and the other one streams by. It is sent in
    passes, by the hash of its key, of about pass_values values each: what a task gets is bounded.
    Each task multiplies blocks of both and keeps k rows a query, so that k rows a query and pass
    are shuffled (a task, where the queries are sent) and not the product. The work stays the product."""
    w = Window.partitionBy(query_key).orderBy(*similarity_order(key))
    rows, asked = (d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(v).cast("long")), F.lit(0)).alias("size")).first() for d, v in ((df, vec), (queries, query_vec)))
    sent, name, values, stream = (df, key, vec, queries.select(query_key, query_vec)) if rows.size <= asked.size else (queries, query_key, query_vec, df.select(key, vec))
    passes = -(-min(rows.size, asked.size) // pass_values)
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, similarity double"
    best = df.sparkSession.createDataFrame([], schema)
    if passes and sent is df and (tasks := min(1024, rows.n * asked.n // (passes * TASK_PAIRS))) > 1:
        stream = stream.repartition(tasks)
    for n in range(passes):
        part = sent.select(name, values) if passes == 1 else sent.where(F.pmod(F.xxhash64(name), F.lit(passes)) == n).select(name, values)
        held = part.toArrow()
        if held.num_rows:
            side = held[name].combine_chunks(), _matrix(held[values])
            if sent is df:
                side = _fewest(*side, k)
            run = (_by_rows if sent is df else _by_queries)(df.sparkSession.sparkContext.broadcast(side), k, [query_key, key, "similarity"], block_values)
            own = stream.mapInArrow(run, schema)
            best = own if passes == 1 else best.union(own)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row a vector, in 32 bits if it is stored so; a missing value is NaN."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = pc.min_max(pc.list_value_length(col)).as_py()
    if col.null_count or size["min"] != size["max"]:
        raise ValueError("a vector is missing or has another length")
    flat = col.flatten()
    return (flat if flat.type == pa.float32() else flat.cast(pa.float64())).to_numpy(zero_copy_only=False).reshape(len(col), size["max"])


def _keys(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False)


def _fewest(ids: pa.Array, m: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """Of rows with the same vector the k with the least keys: no query takes others."""
    bits = np.ascontiguousarray(m).view(np.uint32)
    by = np.random.default_rng(0).integers(1, 1 << 63, bits.shape[1], np.uint64)
    h = np.concatenate([(bits[lo : lo + 4096] * by).sum(axis=1) for lo in range(0, len(bits), 4096)])
    order = np.lexsort((_keys(ids), h))
    more = np.flatnonzero(h[order[k:]] == h[order[: max(0, len(order) - k)]]) + k
    for back in range(1, k + 1):
        more = more[(bits[order[more]] == bits[order[more - back]]).all(axis=1)]
    if not len(more):
        return ids, m
    left = np.sort(np.delete(order, more))
    return ids.take(pa.array(left)), m[left]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed alike wherever a row stands: copies have the same."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1)


class _Vectors:
    """Vectors with their norms and, to find candidates, in 32 bits and of unit length. Those without
    a direction, zero or not finite, are 0 there: all their similarities are NaN."""

    def __init__(self, ids: pa.Array, m: np.ndarray) -> None:
        self.ids, self.keys, self.m = ids, _keys(ids), m
        self.norm, self.unit = np.empty(len(m)), np.empty(m.shape, np.float32)
        with np.errstate(all="ignore"):
            for lo in range(0, len(m), 4096):
                at = slice(lo, lo + 4096)
                self.norm[at] = np.sqrt(_products(m[at], m[at]))
                self.unit[at] = m[at] / self.norm[at, None]
        self.bad = ~((self.norm > 0) & (self.norm < math.inf))
        self.unit[self.bad] = 0

    def part(self, lo: int, hi: int) -> _Vectors:
        some = object.__new__(_Vectors)
        some.__dict__ = {name: x[lo:hi] for name, x in self.__dict__.items()}
        return some


class _Best:
    """The k nearest rows so far to each of some queries.

    Products in 32 bits find the candidates: rows whose similarity, with the error that it may have,
    reaches that of the k-th row so far. Only they are worked out in 64 bits and sorted."""

    def __init__(self, queries: _Vectors, k: int) -> None:
        self.q, self.k = queries, k
        self.error = (queries.m.shape[1] + 8) * 2.0**-23
        self.least = np.full(len(queries.keys), -math.inf)
        self.keys, self.s, self.there = None, np.full((len(self.least), k), -math.inf), np.zeros((len(self.least), k), bool)

    def add(self, rows: _Vectors) -> None:
        if self.keys is None:
            self.keys = np.full(self.s.shape, rows.keys[:1], rows.keys.dtype)
        k, good, few = self.k, ~self.q.bad, ~np.isfinite(self.least)
        near = self.q.unit @ rows.unit.T
        near[:, rows.bad] = -math.inf
        floor = self.least - self.error
        if few.any() and near.shape[1] > k:
            floor[few] = np.partition(near[few], near.shape[1] - k, axis=1)[:, -k] - 2 * self.error
        # A float below, so that rounding leaves no candidate out; finite, so that bad rows are none.
        floor = np.nextafter(np.maximum(floor, -2.0).astype(np.float32), np.float32(-math.inf))
        some = np.flatnonzero((near.max(axis=1) >= floor) & good)
        of, row = np.nonzero(near[some] >= floor[some, None])
        self._take(rows, some[of], row)
        for which, own in ((good & few, rows.bad), (self.q.bad, np.ones(len(rows.bad), bool))):
            if which.any() and own.any():
                at = np.flatnonzero(own)
                at = at[np.lexsort((rows.keys[at],))[:k]]
                self._take(rows, np.repeat(np.flatnonzero(which), len(at)), np.tile(at, which.sum()))

    def _take(self, rows: _Vectors, of: np.ndarray, row: np.ndarray, most: int = 1 << 15) -> None:
        """Takes pairs of a query and a row, so many at once."""
        for lo in range(0, len(of), most):
            q, r = of[lo : lo + most], row[lo : lo + most]
            with np.errstate(all="ignore"):
                s = _products(self.q.m[q], rows.m[r]) / (self.q.norm[q] * rows.norm[r])
            asked = np.unique(q)
            of_all, keys = np.r_[np.repeat(asked, self.k), q], np.r_[self.keys[asked].ravel(), rows.keys[r]]
            s, there = np.r_[self.s[asked].ravel(), s], np.r_[self.there[asked].ravel(), np.ones(len(q), bool)]
            o = np.lexsort((keys, -np.where(np.isnan(s), -math.inf, s), ~there, of_all))
            first = np.searchsorted(of_all[o], asked)
            o = o[first[:, None] + np.arange(self.k)]
            self.keys[asked], self.s[asked], self.there[asked] = keys[o], s[o], there[o]
            self.least[asked] = np.where(np.isnan(s[o[:, -1]]), -math.inf, s[o[:, -1]])

    def batch(self, key: pa.DataType, names: list[str]) -> pa.RecordBatch:
        of = np.nonzero(self.there)[0]
        keys = pa.array([] if self.keys is None else self.keys[self.there], key)
        return pa.RecordBatch.from_arrays([self.q.ids.take(pa.array(of)), keys, pa.array(self.s[self.there])], names=names)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            some = b.slice(lo, rows)
            yield some.column(0), _matrix(some.column(1))


def _by_rows(held: Broadcast, k: int, names: list[str], block_values: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for ids, m in _parts(batches, max(1, block_values // max(1024, held.value[1].shape[1]))):
            rows = rows or _Vectors(*held.value)
            best = _Best(_Vectors(ids, m), k)
            for lo in range(0, len(rows.keys), 1024):
                best.add(rows.part(lo, lo + 1024))
            yield best.batch(rows.ids.type, names)

    return run


def _by_queries(held: Broadcast, k: int, names: list[str], block_values: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, kind = [], None
        for ids, m in _parts(batches, 1024):
            if not blocks:
                q, size = _Vectors(*held.value), max(1, block_values // max(1024, m.shape[1]))
                blocks, kind = [_Best(q.part(lo, lo + size), k) for lo in range(0, len(q.keys), size)], ids.type
            rows = _Vectors(*_fewest(ids, m, k))
            for best in blocks:
                best.add(rows)
        for best in blocks:
            yield best.batch(kind, names)

    return run


def joined_text(ranked: DataFrame, order: Sequence[Column], text: str = "content", mark: str = "\n---\n") -> DataFrame:
    """One row: the texts in rank order with a mark between; '' for no rows."""
    r = ranked.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return r.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(text).alias("t")))), lambda s: s["t"]), mark), F.lit("")).alias("text"))
