"""Token counts under a unigram model, by dynamic programming along a trie of pre-tokens.

Each task collects the distinct pre-tokens of its documents, puts them in a trie and works out
the best score and its number of pieces once for each prefix (see lattice); the counts at the
ends of words are then added up by document. Documents never leave their partition, so the work
needs no shuffle and grows in proportion to the text. The vocabulary is public and isn't trained;
its pieces have Zipf's probabilities by rank. Of segmentations with equal scores the one with the
fewest pieces counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.llm import lattice
from quern.llm._bytes import Powers, trimmed
from quern.llm._io import id_and_text, id_type, table


def _counter(held: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, powers = lattice.Vocabulary(*held.value), Powers()
        score = lattice.zipf(vocab.size)
        for b in batches:
            texts, word, row = lattice.words(b.column("text"), powers)
            logp, n = lattice.viterbi(texts, vocab, score)
            size = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(row, minlength=size)), pa.array(np.bincount(row, weights=n[word], minlength=size).astype(np.int64)), pa.array(np.bincount(row, weights=logp[word], minlength=size))], names=["doc_id", "n_words", "n_tokens", "log_prob"])

    return trimmed(run)


def added(df: DataFrame, name: str, vocabulary: str = lattice.VOCABULARY) -> DataFrame:
    """df with the number of tokens of its column text, which is no null, row by row."""
    held = df.sparkSession.sparkContext.broadcast(lattice.load(vocabulary).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, powers = lattice.Vocabulary(*held.value), Powers()
        score = lattice.zipf(vocab.size)
        for b in batches:
            texts, word, row = lattice.words(b.column("text"), powers)
            n = np.bincount(row, weights=lattice.viterbi(texts, vocab, score)[1][word], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int64))], names=[*b.schema.names, name])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def count_tokens(docs: DataFrame, vocabulary: str = lattice.VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob) a document; log_prob is that of the best segmentation.

    Null, empty and blank texts have 0 tokens. Rows with a null doc_id are left out, rows that
    share one are one document with the least text. White space is ASCII's, and text
    without any is one word of any length. Ids may have any type. Other columns don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(lattice.load(vocabulary).parts())
    return id_and_text(docs).mapInArrow(_counter(held), f"doc_id {id_type(docs)}, n_words long, n_tokens long, log_prob double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
