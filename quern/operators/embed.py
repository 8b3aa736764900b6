"""Text to vectors: windows of tokens through a model, mean-pooled, averaged and of unit length."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.sources import vecstore

#: From the ids of one window to the model's output, a row a token.
Model = Callable[[np.ndarray], np.ndarray]


def hash_model(dim: int = 384) -> Callable[[], Model]:
    """A stand-in without weights: every token id has fixed pseudo-random values. For tests."""

    def start() -> Model:
        known: dict[int, np.ndarray] = {}

        def run(ids: np.ndarray) -> np.ndarray:
            for i in set(ids.tolist()) - known.keys():
                raw = b"".join(hashlib.blake2b(f"{i}.{k}".encode()).digest() for k in range(-(-dim // 16)))
                known[i] = (np.frombuffer(raw, "<u4")[:dim] / 2**31 - 1).astype(np.float32)
            return np.stack([known[i] for i in ids.tolist()])

        return run

    return start


def onnx_model(path: str, spark: SparkSession | None = None) -> Callable[[], Model]:
    """A model file with the inputs input_ids, attention_mask and token_type_ids, loaded once a
    task. With a session the file is sent to the executors; else all of them have it at path."""
    if spark is not None:
        spark.sparkContext.addFile(path)
    sent, name = spark is not None, os.path.basename(path)

    def start() -> Model:
        import onnxruntime

        session = onnxruntime.InferenceSession(SparkFiles.get(name) if sent else path, providers=["CPUExecutionProvider"])

        def run(ids: np.ndarray) -> np.ndarray:
            x = ids.astype(np.int64)[None, :]
            return session.run(None, {"input_ids": x, "attention_mask": np.ones_like(x), "token_type_ids": np.zeros_like(x)})[0][0]

        return run

    return start


def pool(windows: list[np.ndarray], model: Model) -> np.ndarray:
    """The unit vector of a text: mean over the tokens of each window, marks among them, then over
    the windows with equal weights, each rounded to 32 bits; NaN throughout for a zero vector."""
    means = [model(w).mean(axis=0, dtype=np.float64).astype(np.float32) for w in windows]
    v = means[0] if len(means) == 1 else np.mean(np.stack(means), axis=0, dtype=np.float64).astype(np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (v.astype(np.float64) / np.sqrt((v.astype(np.float64) ** 2).sum())).astype(np.float32)


def embed(df: DataFrame, text: str, vocab: dict[str, int], start: Callable[[], Model], out: str = "embedding") -> DataFrame:
    """df with the vector of a text column. Empty and null texts are embedded as the two marks alone."""
    ids = tx.special_ids(vocab)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = start()
        for s in it:
            yield pd.Series([pool([np.array(w, np.int64) for w in ws], model) for ws in s])

    d = df.withColumn("_pre", tx.pretokens(tx.clean(F.coalesce(F.col(text), F.lit("")))))
    d = tx.wordpiece(d, "_pre", vocab, "_pieces", "_ids")
    marked = F.transform(tx.windows_of(F.col("_ids")), lambda w: tx.with_marks(w, ids["[CLS]"], ids["[SEP]"]).cast("array<bigint>"))
    checked = F.when(F.forall(marked, tx.ids_are_numbers), marked).otherwise(F.raise_error(F.lit("a token has no numeric id")))
    return d.withColumn(out, F.pandas_udf(run, "array<float>")(checked)).drop("_pre", "_pieces", "_ids")


def embed_one(spark: SparkSession, text: str, vocab: dict[str, int], start: Callable[[], Model]) -> list[float]:
    return embed(spark.createDataFrame([(text,)], "text string"), "text", vocab, start).first()["embedding"]


def create_embeddings(df: DataFrame, vocab: dict[str, int], start: Callable[[], Model], path: str) -> None:
    """Embeds the contents of (ord, content) in parallel and writes the store as Parquet."""
    vecstore.write_store(embed(df, "content", vocab, start), path)


def self_healing(run: Callable[[], object], reload: Callable[[], object], offline: bool = False) -> object:
    """run(), and once more after reload() if it fails; offline the failure is final."""
    try:
        return run()
    except Exception:
        if offline:
            raise
        reload()
        return run()
