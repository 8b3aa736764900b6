"""Quality classifier by importance resampling.

Two generative models over hashed token n-grams, one of the target text (labelled as good) and
one of all raw text, give each document the log ratio of its likelihoods: its importance. Gumbel
noise added to it and a cut at the k-th largest sum is a sample of k documents without
replacement in proportion to the importance.

Tokens are runs of letters and digits and runs of other signs, in the case they have; n-grams
have one or two. The raw model counts every document. The target model is fitted on the good ones,
of good quality and not toxic, of at most MAX_LABELLED labelled documents (those with the least
hashes of doc_id): a bound on labels, not on documents.

An n-gram's ratio is (c + S) / (e + S) with c its count in the target text and e the count to
expect there if it were raw. The models differ only where the number of documents that have the
n-gram does, by SIGNIFICANCE standard deviations: else the rare words of a labelled text would
speak for it and those of any other text against it, the more the longer it is.

k, or a share of the documents, may be given. Without one it is the number of documents from the
least key up that separates the labelled documents best, where a good document lost counts as LOST
others kept. So k follows what the corpus holds, and not the share of good ones among the labels.
Each labelled document has its key there from a target model without that document: its own
counts are taken off, which is what leaving it out of the fit gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._bytes import WORD, Powers, U, hashes, mix, pieces, trimmed
from quern.llm._io import as_id, cut, id_and_text, id_type, numbered, table, whole, without

BITS = 20
SMOOTHING = 2.0
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
SIGNIFICANCE = 2.5
LOST = 3
MAX_LABELLED = 50_000
SEED = 0x5851F42D4C957F2D
KIND = np.full(256, 2, np.uint8)
KIND[WORD] = 1
KIND[[*b"\t\n\v\f\r "]] = 0


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of one kind, white space left out, and the tokens before each row."""
    kind = KIND[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[(at > 0) & (at < len(kind))]] = True
    start = np.flatnonzero(new)
    end, real = np.append(start[1:], len(kind)), kind[start] > 0
    return start[real], end[real], np.searchsorted(start[real], at)


def features(col: pa.Array, powers: Powers, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, buckets before each row) of the n-grams of each piece of a text column."""
    for lo, _, data, at in pieces(col, PIECE):
        s, e, first = _tokens(data, at)
        h = hashes(data, s, e, powers)
        after = np.zeros_like(h)
        after[:-1] = h[1:]
        after[first[1:][np.diff(first) > 0] - 1] = U(0)
        b = np.empty((len(h), 2), np.int32)
        b[:, 0], b[:, 1] = h >> U(64 - bits), mix(h * U(3) + after) >> U(64 - bits)
        yield lo, b.ravel(), first * 2


def _counter(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, size = Powers(), 1 << bits
        raw, target, docs, target_docs = np.zeros((4, size), np.int64)
        for b in batches:
            good = np.asarray(b.column("good").to_numpy(zero_copy_only=False), bool)
            for lo, buckets, before in features(b.column("text"), powers, bits):
                row = np.repeat(np.arange(len(before) - 1), np.diff(before))
                once, n = np.unique(row << bits | buckets, return_counts=True)
                own, where = good[lo + (once >> bits)], once & (size - 1)
                np.add.at(raw, where, n)
                np.add.at(docs, where, 1)
                np.add.at(target, where[own], n[own])
                np.add.at(target_docs, where[own], 1)
        k = np.flatnonzero(raw)
        for lo in range(0, len(k), 1 << 17):
            p = k[lo : lo + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), *(pa.array(x[p]) for x in (raw, target, docs, target_docs))], names=["bucket", "raw", "target", "docs", "target_docs"])

    return trimmed(run)


def _gumbel(seed: pa.Array) -> np.ndarray:
    u = ((mix(seed.to_numpy().astype(np.int64).view(U) ^ U(SEED)) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def _scorer(weights: object, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, w = Powers(), weights.value.astype(np.float64)
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, buckets, before in features(b.column("text"), powers, bits):
                rows = len(before) - 1
                n[lo : lo + rows] = np.diff(before)
                total[lo : lo + rows] = np.bincount(np.repeat(np.arange(rows), np.diff(before)), weights=w[buckets], minlength=rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total), pa.array(total + _gumbel(b.column("seed")))], names=["doc_id", "n_grams", "log_weight", "key"])

    return trimmed(run)


def chosen(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good) of at most so many labelled documents. Of several labels of one the worst
    counts; a null quality is no label, a null toxic is 0."""
    one = labels.where("doc_id is not null").groupBy(as_id(labels).alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.col("quality") >= 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return one.where("quality is not null").select("doc_id", good.alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


class Model:
    """Counts by bucket (rows raw, target, docs, target_docs), and how many documents and good ones there are."""

    def __init__(self, counts: np.ndarray, size: tuple[int, int], significance: float, smoothing: float) -> None:
        self.counts, self.size, self.significance, self.smoothing = counts, size, significance, smoothing
        self.total = counts[:2].sum(axis=1, dtype=np.int64)

    def weights(self, at: np.ndarray | slice = slice(None), own: np.ndarray | int = 0) -> np.ndarray:
        """The log ratios of buckets; own: counts there of one good document that is left out."""
        raw, target, docs, target_docs = self.counts[:, at].astype(np.float64)
        left_out, n = isinstance(own, np.ndarray), np.sum(own)
        target, target_docs = target - own, target_docs - left_out
        expected, expected_docs = raw * ((self.total[1] - n) / self.total[0]), docs * ((self.size[1] - left_out) / self.size[0])
        differs = np.abs(target_docs - expected_docs) >= self.significance * np.sqrt(expected_docs + 1)
        return np.where(differs, np.log((target + self.smoothing) / (expected + self.smoothing)), 0.0).astype(np.float32)


def _left_out(held: object, weights: object, bits: int) -> Callable:
    """(key, good) of labelled documents, each good one judged without its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, powers = Model(*held.value), Powers()
        every = weights.value
        for b in batches:
            good, total, some = np.asarray(b.column("good").to_numpy(zero_copy_only=False), bool), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for lo, buckets, before in features(b.column("text"), powers, bits):
                for k, (a, z) in enumerate(zip(before[:-1], before[1:]), lo):
                    at, n = np.unique(buckets[a:z], return_counts=True)
                    some[k] = len(at)
                    total[k] = (model.weights(at, n) if good[k] else every[at]).astype(np.float64) @ n
            yield pa.RecordBatch.from_arrays([pa.array((total + _gumbel(b.column("seed")))[some]), pa.array(good[some])], names=["key", "good"])

    return trimmed(run)


def fit(slim: DataFrame, labelled: DataFrame, smoothing: float = SMOOTHING, bits: int = BITS, significance: float = SIGNIFICANCE) -> Model | None:
    """None if no document is labelled as good."""
    marked = slim.join(F.broadcast(labelled.where("good")), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    names = ["raw", "target", "docs", "target_docs"]
    counted = marked.mapInArrow(_counter(bits), "bucket int, raw long, target long, docs long, target_docs long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    size = marked.agg(F.count_if(F.length("text") > 0), F.count_if((F.length("text") > 0) & F.col("good"))).first()
    held = np.zeros((4, 1 << bits), np.int64)
    for i, c in enumerate(names if counted.num_rows else []):
        held[i, counted["bucket"].to_numpy()] = counted[c].to_numpy()
    return Model(held, tuple(size), significance, smoothing) if held[1].any() else None


def least_key(keys: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """The key from which on documents are kept with the least harm; -inf if all are good."""
    if good.all():
        return -np.inf
    o = np.argsort(-keys, kind="stable")
    harm = np.cumsum(~good[o]) + lost * (good.sum() - np.cumsum(good[o]))
    return float(keys[o][harm.argmin()])


def top_k(scored: DataFrame, k: int, by: str = "key") -> DataFrame:
    """The rows with the k largest values, of equals the least doc_id first. A few passes over
    counts by bin find the k-th value; nothing is sorted as a whole."""
    lo, hi = scored.agg(F.min(by), F.max(by)).first()
    if k <= 0 or lo is None:
        return scored.limit(0)
    inside, need = scored, k
    while lo < hi:
        step = (float(hi) - float(lo)) / 1024
        bin_of = F.least(F.lit(1023), F.floor((F.col(by) - F.lit(lo)) / F.lit(step)).cast("int")) if step > 0 else F.lit(0)
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*"), F.min(by), F.max(by)).collect()}
        for b in sorted(bins, reverse=True):
            n, lo_b, hi_b = bins[b]
            if n >= need:
                break
            need -= n
        else:
            return scored
        if len(bins) == 1 and n > 1 and (lo_b, hi_b) == (lo, hi):
            break
        lo, hi = lo_b, hi_b
        inside = scored.where(F.col(by).between(F.lit(lo), F.lit(hi)))
    above = scored.where(F.col(by) > F.lit(hi))
    ties = scored.where(F.col(by).between(F.lit(lo), F.lit(hi)))
    if by == "doc_id" or ties.count() <= need:
        return above.union(ties)
    return above.union(numbered(ties, lambda t: top_k(t.withColumn("_id", -F.col("doc_id")), need, "_id").drop("_id")))


def sample(docs: DataFrame, labels: DataFrame, share: float | None = None, max_labelled: int = MAX_LABELLED, k: int | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight, key) of the sampled documents.

    k: how many documents to keep, or share: which part of those with any token; None finds k by
    the labelled documents, each left out of the model that judges it. If all of these are good, all
    documents with a token are kept. Ids may have any type, that of labels being docs' own. Null,
    empty and blank texts have no n-grams and are never sampled; rows with a null doc_id aren't
    either, and rows that share one are one document, with the least of their texts that isn't null
    or empty. Without any good label there is no target,
    and all documents with a token are kept with log_weight 0. Ties at the cut go to the least
    doc_id if share is given and are kept otherwise. Other columns don't matter.
    """
    slim = id_and_text(docs, nulls_last=True)
    labelled = cut(chosen(labels, max_labelled))
    model, sc = fit(slim, labelled), docs.sparkSession.sparkContext
    held = sc.broadcast(np.zeros(1 << BITS, np.float32) if model is None else model.weights())
    seed = F.col("doc_id") if whole(docs) else F.xxhash64("doc_id")
    scored = cut(slim.select("*", seed.alias("seed")).mapInArrow(_scorer(held, BITS), f"doc_id {id_type(docs)}, n_grams long, log_weight double, key double").where("n_grams > 0"))
    if model is None:
        return scored
    if share is not None or k is not None:
        return scored if k is None and share >= 1 else top_k(scored, round(share * scored.count()) if k is None else k)
    counts = sc.broadcast((model.counts.astype(np.int32) if model.counts.max() < 1 << 31 else model.counts, model.size, model.significance, model.smoothing))
    known = slim.select("*", seed.alias("seed")).join(F.broadcast(labelled), "doc_id").mapInArrow(_left_out(counts, held, BITS), "key double, good boolean").toArrow()
    return scored.where(F.col("key") >= least_key(known["key"].to_numpy(), known["good"].to_numpy()))


def keep_sampled(docs: DataFrame, labels: DataFrame, share: float | None = None, max_labelled: int = MAX_LABELLED, k: int | None = None) -> DataFrame:
    """docs without those that sample() leaves out. Rows with a null doc_id stay; all columns stay as they are."""
    kept = sample(docs, labels, share, max_labelled, k).select("doc_id")
    every = docs.where("doc_id is not null").select(as_id(docs).alias("doc_id")).distinct()
    return without(docs, cut(every.join(kept, "doc_id", "left_anti")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
