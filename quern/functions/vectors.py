"""Vector arithmetic over ARRAY<FLOAT> columns, always in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan")).cast("double")


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the length of a, from left to right; NaN if b is shorter."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    products = F.zip_with(a, F.slice(b, 1, F.size(a)), lambda x, y: x * y)
    return F.when(F.size(b) < F.size(a), nan()).otherwise(_sum(products))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; NaN where a norm is 0 or b is shorter than a. A longer b's further
    dimensions count in its norm alone. Norms known beforehand may be given."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, nan()).otherwise(dot(a, b) / size)


def normalised(a: Column) -> Column:
    """a divided by its norm, rounded to FLOAT; NaN throughout for a zero vector."""
    size = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(size == 0, nan()).otherwise(x / size)).cast("array<float>")


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mean_by(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Mean vector of each group, dimension by dimension with equal weights, rounded to FLOAT:
    keys and the column vec. Pools token vectors to a chunk's and chunk vectors to a text's."""
    flat = df.select(*keys, F.posexplode(vec).alias("_dim", "_x")).groupBy(*keys, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_x"))), lambda s: s["_x"].cast("float")).alias(vec))


def flatten(df: DataFrame, order: str, vec: str) -> DataFrame:
    """All vectors in one, in the order of a column: one row with the column flat."""
    return df.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(vec)))), lambda s: s[vec])).alias("flat"))


def unflatten(df: DataFrame, flat: str, dim: int) -> DataFrame:
    """(ord, vector): the slices of dim values of a flat vector."""
    n = F.floor(F.size(flat) / dim).cast("int")
    return df.select(F.posexplode(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(F.col(flat), i * dim + 1, dim))).alias("ord", "vector"))
