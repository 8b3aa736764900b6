"""Language identification by unigram piece models, summed over all segmentations.

Every language has probabilities for the pieces of one fixed public vocabulary, fitted by
expectation maximisation: the expected uses of each piece over all segmentations of the labelled
text (forward and backward sums), smoothed towards the vocabulary's Zipf probabilities. A text's
score is the sum over its words of the log of the forward sum, so no single segmentation is
picked. Fitting uses at most MAX_LABELLED labelled documents a language, those with the least
hashes of doc_id: a bound on labels, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import lattice
from quern.llm._bytes import Powers, trimmed
from quern.llm._io import as_id, cut, id_and_text, id_type, table

MAX_LABELLED = 500
ROUNDS = 2
SMOOTHING = 200.0


def _start(vocab: lattice.Vocabulary) -> np.ndarray:
    z = lattice.zipf(vocab.size)
    return np.append(z, z.min() - lattice.BYTE_PENALTY)


def _expecter(held: object, languages: list[str], logp: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, powers = lattice.Vocabulary(*held.value), Powers()
        number = {x: i for i, x in enumerate(languages)}
        total = np.zeros_like(logp.value)
        for b in batches:
            texts, word, row = lattice.words(b.column("text"), powers)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            counts = np.bincount(word * len(languages) + lang[row], minlength=len(texts) * len(languages)).reshape(-1, len(languages)).astype(float)
            total += lattice.expected(texts, counts, vocab, logp.value)
        piece, model = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(model.astype(np.int32)), pa.array(total[piece, model])], names=["piece", "model", "n"])

    return trimmed(run)


def fit(docs: DataFrame, held: object, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log probabilities with a row a piece (the last: a byte) and a column a language."""
    spark, vocab = docs.sparkSession, lattice.Vocabulary(*held.value)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = docs.where("doc_id is not null and lang is not null").groupBy(as_id(docs).alias("doc_id")).agg(F.min("lang").alias("lang")).withColumn("rank", rank).where(F.col("rank") <= max_labelled).drop("rank")
    labelled = cut(id_and_text(docs).join(F.broadcast(ids), "doc_id").select("lang", "text"))
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    start = _start(vocab)
    logp = np.repeat(start[:, None], max(1, len(languages)), axis=1)
    for _ in range(rounds if languages else 0):
        found = labelled.mapInArrow(_expecter(held, languages, spark.sparkContext.broadcast(logp)), "piece int, model int, n double").groupBy("piece", "model").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros_like(logp)
        n[found["piece"].to_numpy(), found["model"].to_numpy()] = found["n"].to_numpy()
        prior = np.exp(start) / np.exp(start).sum()
        logp = np.log((n + smoothing * prior[:, None]) / (n.sum(axis=0) + smoothing))
    return languages, logp


def _scorer(held: object, languages: list[str], logp: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, powers = lattice.Vocabulary(*held.value), Powers()
        for b in batches:
            texts, word, row = lattice.words(b.column("text"), powers)
            each = lattice.forward(texts, vocab, logp.value)
            size = b.num_rows
            total = np.stack([np.bincount(row, weights=each[word, m], minlength=size) for m in range(len(languages))], axis=1)
            some = np.bincount(row, minlength=size) > 0
            top = total.argmax(axis=1)
            best = total[np.arange(size), top]
            share = 1 / np.exp(np.minimum(total - best[:, None], 0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(languages, object)[top], pa.string(), mask=~some), pa.array(best, mask=~some), pa.array(share, mask=~some)], names=["doc_id", "lang", "log_prob", "posterior"])

    return trimmed(run)


def identify(docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, vocabulary: str = lattice.VOCABULARY) -> DataFrame:
    """(doc_id, lang, log_prob, posterior) a document; posterior is lang's share under equal priors.

    labelled: doc_id, text and lang to fit on, docs itself if None; rows with a null lang there
    aren't used. Null, empty and blank texts get null in all three columns, and so does everything
    if no language is labelled. Of equal languages the first by name counts. Rows with a null
    doc_id are left out, rows that share one are one document with the least text and the least
    lang. Text without white space is one word of any length, in the fit as well. Ids may have any
    type. Other columns don't matter.
    """
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(lattice.load(vocabulary).parts())
    languages, logp = fit(docs if labelled is None else labelled, held, max_labelled)
    if not languages:
        return id_and_text(docs).select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("posterior"))
    return id_and_text(docs).mapInArrow(_scorer(held, languages, sc.broadcast(logp)), f"doc_id {id_type(docs)}, lang string, log_prob double, posterior double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
