"""Benchmark decontamination by greedy string tiling.

A document is compared with each benchmark item that it shares a seed with: a run of MIN_MATCH
tokens, found by the running Karp-Rabin hashes of both. From the seeds come all longest common
runs; the longest that overlaps no earlier tile becomes a tile, again and again, until none of
MIN_MATCH tokens is left. The item's share of tokens under tiles is its coverage. Since tiles may
come in any order, passages that were cut up and moved count in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._bytes import Powers, U, hashes, mix, pieces, spans, trimmed
from quern.llm._io import cut, id_and_text, id_and_texts, id_type, repeats_ids, table, without

MIN_MATCH = 5
COVERAGE = 0.5
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
#: Characters of the benchmark up to which every task gets all of it; beyond, seeds are joined.
BROADCAST_CHARS = 32 << 20
RESULT = "doc_id {}, item_id {}, item_tokens int, covered_tokens int, coverage double, n_tiles int, tiles array<struct<item_start:int,doc_start:int,length:int>>"
TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def running(h: np.ndarray, first: np.ndarray, m: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of m tokens that lie within one row, and their first tokens."""
    n = len(h)
    if n < m:
        return np.zeros(0, U), np.zeros(0, np.int64)
    powers.grow(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(h * powers.up[:n], out=total[1:])
    w = mix((total[m:] - total[:-m]) * powers.down[: n - m + 1])
    ok = np.ones(n - m + 1, bool)
    for edge in first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)]:
        ok[max(0, edge - m + 1) : edge] = False
    at = np.flatnonzero(ok)
    return w[at], at


def tile(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays from the seeds (p[i], t[i]): equal windows of m
    tokens. Longest first; of equals, the first in the item and then in the document."""
    same = np.all(item[p[:, None] + np.arange(m)] == doc[t[:, None] + np.arange(m)], axis=1)
    p, t = p[same], t[same]
    o = np.lexsort((p, t - p))
    p, t = p[o], t[o]
    runs = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(t - p) != 0)]) if len(p) else np.zeros(0, int)
    last = np.r_[runs[1:], len(p)] - 1 if len(p) else runs
    heap = [(-int(p[b] - p[a] + m), int(p[a]), int(t[a])) for a, b in zip(runs, last)]
    heapq.heapify(heap)
    used_i, used_d, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = ~(used_i[i : i + n] | used_d[d : d + n])
        if free.all():
            used_i[i : i + n] = used_d[d : d + n] = True
            tiles.append((i, d, n))
            continue
        edge = np.diff(np.r_[0, free.view(np.int8), 0])
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a >= m:
                heapq.heappush(heap, (-int(b - a), i + int(a), d + int(a)))
    return sorted(tiles)


class Benchmark:
    """The items' tokens, and their windows of m tokens in the order of their hashes."""

    def __init__(self, ids: list, texts: list[str], m: int) -> None:
        self.ids, self.m, self.powers = ids, m, Powers()
        (_, _, data, at), *rest = [*pieces(pa.array(texts, pa.string()), 1 << 40)] or [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        s, e, self.first = spans(data, at, signs=True)
        self.tokens = hashes(data, s, e, self.powers)
        w, at = running(self.tokens, self.first, m, self.powers)
        o = np.argsort(w, kind="stable")
        self.windows, self.at = w[o], at[o]
        self.item = np.searchsorted(self.first, self.at, side="right") - 1

    def item_tokens(self, k: int) -> np.ndarray:
        return self.tokens[self.first[k] : self.first[k + 1]]

    def seeds(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into w and into windows of all equal pairs."""
        lo = np.searchsorted(self.windows, w, side="left")
        hit = np.flatnonzero((lo < len(self.windows)) & (self.windows[np.minimum(lo, len(self.windows) - 1)] == w)) if len(self.windows) else np.zeros(0, np.int64)
        n = np.searchsorted(self.windows, w[hit], side="right") - lo[hit]
        start = np.repeat(lo[hit], n)
        return np.repeat(hit, n), start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)


def _scan(ids: pa.Array, texts: list[str], m: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, powers = Benchmark(list(range(len(ids))), texts, m), Powers()
        for b in batches:
            rows: list[tuple] = []
            for lo, _, data, at in pieces(b.column("text"), PIECE):
                s, e, first = spans(data, at, signs=True)
                h = hashes(data, s, e, powers)
                w, where = running(h, first, m, powers)
                x, y = bench.seeds(w)
                t = where[x]
                doc = np.searchsorted(first, t, side="right") - 1
                pair = doc * len(bench.ids) + bench.item[y]
                o = np.argsort(pair, kind="stable")
                t, y, pair = t[o], y[o], pair[o]
                cuts = np.flatnonzero(np.r_[True, np.diff(pair) != 0]) if len(pair) else np.zeros(0, int)
                for a, z in zip(cuts, np.r_[cuts[1:], len(pair)]):
                    d, k = divmod(int(pair[a]), len(bench.ids))
                    item, tokens = bench.item_tokens(k), h[first[d] : first[d + 1]]
                    p = bench.at[y[a:z]] - bench.first[k]
                    # No more of the item can be covered than its seeds reach.
                    reach = np.zeros(len(item) + 1, np.int64)
                    np.add.at(reach, p, 1)
                    np.add.at(reach, p + m, -1)
                    if (np.cumsum(reach)[:-1] > 0).sum() < least * len(item):
                        continue
                    tiles = tile(item, tokens, p, t[a:z] - first[d], m)
                    if (n := sum(x[2] for x in tiles)) >= least * len(item):
                        rows.append((lo + d, bench.ids[k], len(item), n, n / len(item), len(tiles), [dict(zip(("item_start", "doc_start", "length"), x)) for x in tiles]))
            c = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(c[0], pa.int64())), ids.take(pa.array(c[1], pa.int64())), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.int32()), pa.array(c[6], TILES)], names=["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "n_tiles", "tiles"])

    return trimmed(run)


def _windows(m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for lo, _, data, at in pieces(b.column("text"), PIECE):
                s, e, first = spans(data, at, signs=True)
                w, where = running(hashes(data, s, e, powers), first, m, powers)
                row = lo + np.searchsorted(first, where, side="right") - 1
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(w.view(np.int64))], names=["id", "w"])

    return trimmed(run)


def _pairs(m: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                scan = _scan(b.column("item_id").slice(k, 1), [b.column("item")[k].as_py()], m, least)
                yield from scan(iter([b.slice(k, 1).select(["doc_id", "text"])]))

    return trimmed(run)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, coverage, n_tiles, tiles) of each document
    and item with that coverage or more; tiles count tokens from 0.

    An item with fewer than min_match tokens, a null or empty one too, matches nothing, and so
    does such a document. Items with the same text each give their row. Rows with a null doc_id
    or item_id give none. Of rows that share a doc_id each text is compared, and the one that covers
    most of the item gives the row; items that share an id are one, with the least text. Either
    table may be empty, ids may have any type; other columns don't matter. Signs of typography,
    curly quotes and dashes for two, are no parts of words.
    """
    slim = id_and_texts(docs, F.lower("text"))
    items = id_and_text(benchmark.select(F.col("item_id").alias("doc_id"), "text"), F.lower("text")).withColumnsRenamed({"doc_id": "item_id", "text": "item"})
    result = RESULT.format(id_type(docs), items.schema["item_id"].dataType.simpleString())
    if (items.agg(F.sum(F.length("item"))).first()[0] or 0) <= broadcast_chars:
        held = items.orderBy("item_id").toArrow()
        return _best(docs, slim.mapInArrow(_scan(held["item_id"].combine_chunks(), held["item"].to_pylist(), min_match, coverage), result))
    own = items.select(F.col("item_id").alias("id"), F.col("item").alias("text")).mapInArrow(_windows(min_match), f"id {items.schema['item_id'].dataType.simpleString()}, w long").select(F.col("id").alias("item_id"), "w").distinct()
    theirs = slim.select(F.col("doc_id").alias("id"), "text").mapInArrow(_windows(min_match), f"id {id_type(docs)}, w long").select(F.col("id").alias("doc_id"), "w")
    shared = cut(theirs.join(own, "w").select("doc_id", "item_id").distinct())
    return _best(docs, shared.join(items, "item_id").join(slim, "doc_id").mapInArrow(_pairs(min_match, coverage), result))


def _best(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row a document and item: the one with the most covered tokens, if rows of docs share a doc_id."""
    if not repeats_ids(docs):
        return found
    rest = ["covered_tokens", "n_tiles", "tiles", "item_tokens", "coverage"]
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("most")).select("doc_id", "item_id", "most.*").select(found.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs without those that cover a benchmark item; all rows of a doc_id go if one does, rows
    with a null doc_id stay. All columns stay as they are."""
    return without(docs, cut(contamination(docs, benchmark, min_match, coverage).select("doc_id").distinct()))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
