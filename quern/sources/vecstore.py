"""The vector store: text chunks and their vectors, as Parquet and as the exchange pair of files.

The pair is <id>.json, {"dim", "count", "chunks"}, and <id>.bin, all vectors one after another as
little-endian 32-bit floats. It is validated as a whole, on the driver, before any row comes out;
tasks then read their vectors alone. It is for exchange: at scale the store is Parquet.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord int, content string, embedding array<float>"
PART = 4096


class EmbeddingsCorrupted(ValueError):
    """The pair of files breaks a rule of the format."""

    code = "EMBEDDINGS_CORRUPTED"


def paths(id: str, folder: str) -> tuple[str, str, str]:
    return tuple(os.path.join(folder, f"{id}.{end}") for end in ("json", "bin", "etag"))


def read_pair(id: str, folder: str) -> tuple[list[str], np.ndarray]:
    """Texts and vectors of a pair. FileNotFoundError if a file is missing, EmbeddingsCorrupted if
    a rule is broken: JSON, dim and chunks, count, and then length, texts and finite values."""
    meta, data, _ = paths(id, folder)
    with open(meta, encoding="utf-8") as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError as e:
        raise EmbeddingsCorrupted(f"{meta} is no JSON: {e}") from e
    if found is None:
        raise TypeError(f"{meta} holds null")
    found = found if isinstance(found, dict) else {}
    dim, count, chunks = found.get("dim"), found.get("count"), found.get("chunks")
    if isinstance(dim, bool) or not isinstance(dim, (int, float)) or dim != int(dim) or dim <= 0 or not isinstance(chunks, list):
        raise EmbeddingsCorrupted(f"{meta} lacks dim or chunks")
    dim = int(dim)
    if count is not None and count != len(chunks):
        raise EmbeddingsCorrupted(f"{meta} counts {count} chunks and has {len(chunks)}")
    size = os.path.getsize(data)
    if size != len(chunks) * dim * 4:
        raise EmbeddingsCorrupted(f"{data} has {size} bytes, not {len(chunks) * dim * 4}")
    if any(not isinstance(c, str) for c in chunks):
        raise EmbeddingsCorrupted(f"{meta} has a chunk that is no text")
    vectors = np.memmap(data, "<f4", "r", shape=(len(chunks), dim)) if chunks else np.zeros((0, dim), "<f4")
    if not all(np.isfinite(vectors[lo : lo + PART]).all() for lo in range(0, len(chunks), PART)):
        raise EmbeddingsCorrupted(f"{data} has a value that is not finite")
    return chunks, vectors


def load(id: str, folder: str) -> tuple[list[str], np.ndarray]:
    """As read_pair; a corrupted pair is removed with its etag before the error goes on."""
    try:
        return read_pair(id, folder)
    except EmbeddingsCorrupted:
        for p in paths(id, folder):
            try:
                os.remove(p)
            except OSError:
                pass
        raise


def write_pair(id: str, texts: Sequence[str], vectors: Sequence[np.ndarray], folder: str) -> None:
    """The pair of files, in place of an old one. ValueError for no texts, no vectors, other
    numbers of them, vectors that aren't 32-bit floats or of different lengths."""
    if not len(texts):
        raise ValueError("no chunks")
    if not len(vectors):
        raise ValueError("no embeddings")
    if len(texts) != len(vectors):
        raise ValueError(f"{len(texts)} chunks and {len(vectors)} embeddings")
    if any(not isinstance(v, np.ndarray) or v.dtype != np.float32 for v in vectors):
        raise ValueError("an embedding is no array of 32-bit floats")
    dim = len(vectors[0])
    if any(len(v) != dim for v in vectors):
        raise ValueError("embeddings of different dimensions")
    os.makedirs(folder, exist_ok=True)
    meta, data, _ = paths(id, folder)
    for p in (meta, data):
        if os.path.exists(p):
            os.remove(p)
    with open(data, "wb") as f:
        f.write(np.stack(vectors).astype("<f4").tobytes())
    with open(meta, "w", encoding="utf-8") as f:
        json.dump({"dim": dim, "count": len(texts), "chunks": list(texts)}, f, indent=2, ensure_ascii=False)


def export_pair(df: DataFrame, id: str, folder: str) -> None:
    """A store's rows as a pair, in the order of ord. The pair is one file and so comes to the driver."""
    t = df.orderBy("ord").select("content", "embedding").toArrow()
    write_pair(id, t["content"].to_pylist(), [np.array(v, np.float32) for v in t["embedding"].to_pylist()], folder)


class _Rows(InputPartition):
    """PART rows: their texts, and where their vectors are in the file."""

    def __init__(self, lo: int, texts: list[str], dim: int) -> None:
        self.lo, self.texts, self.dim = lo, texts, dim


class _Reader(DataSourceReader):
    def __init__(self, id: str, folder: str) -> None:
        self.id, self.folder = id, folder

    def partitions(self) -> Sequence[InputPartition]:
        texts, vectors = read_pair(self.id, self.folder)
        return [_Rows(lo, texts[lo : lo + PART], vectors.shape[1]) for lo in range(0, len(texts), PART)] or [_Rows(0, [], 1)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        n, dim, texts = len(partition.texts), partition.dim, partition.texts
        flat = np.fromfile(paths(self.id, self.folder)[1], "<f4", n * dim, offset=partition.lo * dim * 4)
        vectors = pa.ListArray.from_arrays(np.arange(0, (n + 1) * dim, dim, dtype=np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.lo, partition.lo + n, dtype=np.int32)), pa.array(texts, pa.string()), vectors], names=["ord", "content", "embedding"])


class VecstoreSource(DataSource):
    """spark.read.format("vecstore").option("id", …).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "vecstore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["id"], self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecstoreSource)


def chunks(spark: SparkSession, id: str, folder: str) -> DataFrame:
    """(ord, content, embedding) of a pair, validated first; a corrupted pair is removed."""
    load(id, folder)
    register(spark)
    return spark.read.format("vecstore").option("id", id).load(folder)


def write_store(df: DataFrame, path: str) -> None:
    """Rows (ord, content, embedding) as Parquet with their norms, which searches then needn't work out."""
    from quern.functions.vectors import norm

    df.select("ord", "content", "embedding").withColumn("norm", norm(F.col("embedding"))).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, norm double").parquet(path)
