"""What the operators of this package share on the Spark side."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches; a temporary one only in
    local mode, where that setting is usually missing."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (own := spark.conf.get("spark.quern.scratch", None)) is None:
        own = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.quern.scratch", own)
    return own


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many bytes, for the rest of this session and what else runs in
    it, unless it has a setting of its own. Spark's default is 64 MB, and a session that runs many
    stages keeps buffers for the largest in every executor and worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again. A lost executor then costs one
    stage at most, and what follows doesn't run what came before again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*paths: str) -> None:
    for spark, path in [w for w in _written if not paths or w[1] in paths]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass
        _written.remove((spark, path))


atexit.register(discard)


def broadcast_if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df, a written table of a few numbers a row, with a broadcast hint if it has at most so many
    rows. Beyond that Spark shuffles both sides of the join."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids, a written table of one column; rows with a null doc_id stay."""
    name = fresh(docs, "_gone")
    return docs.join(broadcast_if_small(ids.toDF(name)), docs["doc_id"] == F.col(name), "left_anti")


def whole(df: DataFrame, name: str = "doc_id") -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """The type in which operators give the ids of a column: BIGINT for whole numbers, else its own."""
    return "bigint" if whole(df, name) else df.schema[name].dataType.simpleString()


def as_id(df: DataFrame, name: str = "doc_id") -> Column:
    return F.col(name).cast("long") if whole(df, name) else F.col(name)


def numbered(docs: DataFrame, run: Callable[[DataFrame], DataFrame], out: Iterable[str] = ("doc_id",), key: str = "doc_id") -> DataFrame:
    """run(docs), which needs whole numbers in key. Other ids, texts for one, get numbers in their
    order first, and the columns out of the result get the ids again."""
    if whole(docs, key):
        return run(docs)
    own, number = fresh(docs, "_own"), fresh(docs, "_number")
    ids = cut(docs.where(F.col(key).isNotNull()).select(F.col(key).alias(own)).distinct().orderBy(own).withColumn(number, F.monotonically_increasing_id()))
    found = run(docs.join(ids, docs[key] == ids[own], "left").withColumn(key, F.col(number)).select(*docs.columns))
    columns = found.columns
    for c in out:
        found = found.join(ids.select(F.col(own).alias("_out"), F.col(number).alias("_in")), found[c] == F.col("_in"), "left").drop(c, "_in").withColumnRenamed("_out", c)
    return found.select(*columns)


def _slim(docs: DataFrame, text: Column | str) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(as_id(docs).alias("doc_id"), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string").alias("text"))


def id_and_text(docs: DataFrame, text: Column | str = "text", nulls_last: bool = False) -> DataFrame:
    """doc_id and text alone, text null as ''. Rows without a doc_id go. Rows that share a doc_id
    count as one document, with the least of their texts; nulls_last: of those that aren't null or
    empty, if there are any."""
    slim = _slim(docs, text)
    least = F.coalesce(F.min(F.nullif("text", F.lit(""))), F.lit("")) if nulls_last else F.min("text")
    return slim.groupBy("doc_id").agg(least.alias("text")) if repeats_ids(docs) else slim


def id_and_texts(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """As id_and_text, but with a row for each different text of the rows that share a doc_id."""
    slim = _slim(docs, text)
    return slim.distinct() if repeats_ids(docs) else slim


def repeats_ids(docs: DataFrame) -> bool:
    return not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()


def schema(fields: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
