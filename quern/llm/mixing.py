"""Mixing sources to target token weights by entropy balancing.

Among all document rates r with the wanted token totals, the ones nearest to 1 are taken: they
minimise the sum of tokens * (r log r - r + 1). The convex dual has a multiplier for each
constraint, and its solution tilts every document exponentially:

    r = exp(lambda[source] + mu[lang] + nu * z),   z = log(1 + tokens) less its mean

The sources' totals are met exactly. The languages' shares and the mean length are held where they
are, softly (a ridge of SOFT on their multipliers), so that mixing sources doesn't tilt the rest
and a solution exists even where a language has one source. Newton steps with halving solve the
dual: every step is one distributed sum over the documents by source and language of the tilted
tokens, their z and z squared, which hold the whole gradient and Hessian. Tokens are pieces of a
public vocabulary, counted by the trie of op3.

Rates become copies by systematic rounding: along a hashed order within one source, language and
length class the running sum of the rates is rounded down, from a hashed start, and a document
gets as many copies as the sum rises. So every class has its total within one copy, and a document
its rate on average. Large classes are split in hashed parts of about PART documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import token_counts
from quern.llm._io import as_id, broadcast_if_small, cut, fresh, repeats_ids, table

#: Shares without given weights: in proportion to the sources' tokens to this power.
TEMPERATURE = 0.7
SOFT = 1e-3
TOLERANCE = 1e-9
PART = 100_000


def measured(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens) of each document; a written table. tokens: a column of docs
    that counts them; None counts the pieces of the public vocabulary, as op3 does."""
    slim = docs.where("doc_id is not null").select(as_id(docs).alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), (F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else F.lit(None).cast("long")).alias("tokens"))
    if repeats_ids(docs):
        slim = slim.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("source", "lang", "text", "tokens")))
    return cut(slim.drop("text") if tokens else token_counts.added(slim.drop("tokens"), "tokens").drop("text"))


def targets(some: DataFrame, weights: dict[str, float] | None, budget: float | None) -> DataFrame:
    """(source, target) of each source with a weight; a written table."""
    totals = some.groupBy("source").agg(F.sum("tokens").cast("double").alias("t"))
    if weights is None:
        raw = totals.withColumn("raw", F.pow("t", F.lit(TEMPERATURE)))
    else:
        given = some.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()] or [("", 0.0)], "source string, raw double")
        raw = totals.join(given, "source")
    raw = cut(raw.where("raw > 0"))
    whole, every = raw.agg(F.sum("raw")).first()[0], some.agg(F.sum("tokens")).first()[0]
    return raw.select("source", (F.col("raw") / F.lit(whole or 1.0) * F.lit(float(every or 0) if budget is None else float(budget))).alias("target"))


class Dual:
    """The dual in the languages' and the length's multipliers. Those of the sources follow from
    them, whatever their number: exp(lambda[source]) = target / tilted tokens. So what comes to the
    driver has a row for each pair of languages that a source has."""

    def __init__(self, some: DataFrame, sources: DataFrame, langs: list[str], mean: float, by_lang: np.ndarray) -> None:
        self.some, self.sources, self.langs, self.mean, self.by_lang = some, sources, langs, mean, by_lang
        self.ridge = SOFT * by_lang.sum()

    def tilted(self, mu: np.ndarray, nu: float) -> DataFrame:
        """(source, lang, k, a, b, c): tilted tokens, their z and z squared, by source and language."""
        z = F.log1p(F.col("tokens").cast("double")) - F.lit(self.mean)
        tilt = F.col("tokens") * F.exp(F.lit(float(nu)) * z)
        cells = self.some.groupBy("source", "lang").agg(F.sum(tilt).alias("a"), F.sum(tilt * z).alias("b"), F.sum(tilt * z * z).alias("c"))
        own = self.some.sparkSession.createDataFrame([(x, k, float(np.exp(m))) for k, (x, m) in enumerate(zip(self.langs, mu))], "lang string, k int, w double")
        return cells.join(F.broadcast(own), "lang").select("source", "lang", "k", *((F.col(c) * F.col("w")).alias(c) for c in "abc"))

    def look(self, mu: np.ndarray, nu: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value, gradient and Hessian, as one distributed sum."""
        cells = self.tilted(mu, nu).join(broadcast_if_small(self.sources), "source")
        each = cells.groupBy("source").agg(F.first("target").alias("t"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.collect_list(F.struct("k", "a", "b")).alias("own"))
        last = len(self.langs)

        def term(k: object, l: object, v: object) -> object:
            return F.struct((F.lit(k) if isinstance(k, int) else k).cast("int").alias("k"), (F.lit(l) if isinstance(l, int) else l).cast("int").alias("l"), v.alias("v"))

        share = lambda x, c: x[c] / F.col("a")
        t, q = F.col("t"), F.col("b") / F.col("a")
        terms = F.concat(
            F.array(term(-1, -1, t * F.log("a")), term(-1, last, t * q), term(last, last, t * (F.col("c") / F.col("a") - q * q))),
            F.transform("own", lambda x: term(-1, x["k"], t * share(x, "a"))),
            F.transform("own", lambda x: term(x["k"], last, t * (share(x, "b") - share(x, "a") * q))),
            F.transform("own", lambda x: term(x["k"], x["k"], t * share(x, "a"))),
            F.flatten(F.transform("own", lambda x: F.transform("own", lambda y: term(x["k"], y["k"], -t * share(x, "a") * share(y, "a"))))),
        )
        value, g, h = 0.0, np.zeros(last + 1), np.zeros((last + 1, last + 1))
        for r in each.select(F.explode(terms).alias("x")).select("x.*").groupBy("k", "l").agg(F.sum("v").alias("v")).collect():
            if r.k < 0:
                value, g[r.l] = (r.v, g[r.l]) if r.l < 0 else (value, r.v)
            else:
                h[r.k, r.l] = r.v
                if r.l == last and r.k < last:
                    h[last, r.k] = r.v
        x = np.append(mu, nu)
        return float(value - mu @ self.by_lang + 0.5 * self.ridge * (x @ x)), g - np.append(self.by_lang, 0.0) + self.ridge * x, h + self.ridge * np.eye(last + 1)


def balance(sizes: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None) -> tuple[DataFrame, DataFrame, float, float]:
    """(source, base), (lang, w), nu and mean: rate = base * w * exp(nu * (log(1 + tokens) - mean))."""
    spark = sizes.sparkSession
    some = sizes.where("tokens > 0")
    sources = cut(targets(some, weights, budget))
    # Languages by their tokens in sources with a weight; their names come to the driver.
    z = F.log1p(F.col("tokens").cast("double"))
    known = some.join(broadcast_if_small(sources), "source")
    cells = known.groupBy("lang").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * z).alias("tz")).orderBy("lang").collect()
    if not cells:
        return spark.createDataFrame([], "source string, base double"), spark.createDataFrame([], "lang string, w double"), 0.0, 0.0
    by_lang = np.array([float(r.t) for r in cells])
    mean = sum(r.tz for r in cells) / by_lang.sum()
    dual = Dual(some, sources, [r.lang for r in cells], mean, by_lang / by_lang.sum() * sources.agg(F.sum("target")).first()[0])
    x = np.zeros(len(cells) + 1)
    value, g, h = dual.look(x[:-1], x[-1])
    for _ in range(50):
        if np.abs(g).max() < TOLERANCE * dual.by_lang.sum():
            break
        step, t = np.linalg.solve(h, -g), 1.0
        while True:
            new = x + t * step
            then = dual.look(new[:-1], new[-1])
            if then[0] <= value + 1e-12 * abs(value) or t < 1e-6:
                break
            t /= 2
        x, (value, g, h) = new, then
    total = dual.tilted(x[:-1], x[-1]).groupBy("source").agg(F.sum("a").alias("a"))
    base = cut(sources.join(total, "source").select("source", (F.col("target") / F.col("a")).alias("base")))
    return base, spark.createDataFrame([(n, float(np.exp(m))) for n, m in zip(dual.langs, x)], "lang string, w double"), float(x[-1]), float(mean)


def copies(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, tokens: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies) of each document.

    weights: token weight of each source, in any unit; a source without one gets rate 0, one
    without tokens is left out of the target. None: see TEMPERATURE. budget: tokens of the
    mixture; None: as many as there are. tokens: see measured; a null there is 0. There may be any
    number of sources; the languages' names fit the driver. Null source and lang count as ''; null and empty texts
    have no tokens and change no total, but get the rate of their cell, as short texts do. Rows
    with a null doc_id are left out, rows that share one are one document with the least of each
    column. If nothing can be balanced, all rates are 0. Ids may have any type. Other columns don't
    matter.
    """
    sizes = measured(docs, tokens)
    base, langs, nu, mean = balance(sizes, weights, budget)
    tilt = F.exp(F.lit(nu) * (F.log1p(F.col("tokens").cast("double")) - F.lit(mean)))
    rated = sizes.join(broadcast_if_small(base), "source", "left").join(F.broadcast(langs), "lang", "left")
    rated = rated.select("doc_id", "source", "lang", "tokens", F.coalesce(F.col("base") * F.col("w") * tilt, F.lit(0.0)).alias("rate"), F.floor(F.log2(F.col("tokens") + 1.0)).cast("int").alias("class"))
    parts = cut(rated.groupBy("source", "lang", "class").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts")))
    split = rated.join(broadcast_if_small(parts), ["source", "lang", "class"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")))
    order = Window.partitionBy("source", "lang", "class", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    start = (F.pmod(F.xxhash64("source", "lang", "class", "part"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    rise = F.floor(F.sum("rate").over(upto) + start) - F.floor(F.coalesce(F.sum("rate").over(before), F.lit(0.0)) + start)
    return split.withColumn("copies", rise.cast("long")).select("doc_id", "source", "lang", "tokens", "rate", "copies")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, tokens: str | None = None) -> DataFrame:
    """docs with each row as often as it has copies, numbered from 1 in the column copy (which
    replaces one of that name). Rows without copies, those with a null doc_id among them, go."""
    docs = docs.drop("copy")
    key, times = fresh(docs, "_id"), fresh(docs, "_times")
    n = cut(copies(docs, weights, budget, tokens).where("copies > 0").select("doc_id", "copies")).toDF(key, times)
    joined = docs.join(broadcast_if_small(n), docs["doc_id"] == F.col(key))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop(key, times)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))
