"""Named queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fuzzy, text, vectors
from quern.operators import catalog, embed, search
from quern.sources import schema_json, vecstore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TERM = "almond steel"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SOURCES = (("region", "r_regionkey", "r_name", "service"), ("nation", "n_nationkey", "n_name", "entity"), ("supplier", "s_suppkey", "s_name", "type"), ("customer", "c_custkey", "c_name", "action"), ("part", "p_partkey", "p_name", "event"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """A catalog (ord, name, kind) made of the tables' names."""
    out = None
    for i, (t, key, name, kind) in enumerate(SOURCES):
        own = table(spark, d, t).select((F.lit(i * 10**12) + F.col(key)).cast("bigint").alias("ord"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
        out = own if out is None else out.union(own)
    return out


NAMES = " UNION ALL ".join(f"SELECT ({i * 10**12} + {key})::BIGINT AS ord, {name} AS name, '{kind}' AS kind FROM {t}" for i, (t, key, name, kind) in enumerate(SOURCES))


def score_sql(pairs: str) -> str:
    """CTEs that score distinct (term, content) pairs with the textbook table of edit costs, row by row."""
    return f"""RECURSIVE p AS (SELECT DISTINCT lower(term) AS a, lower(content) AS b FROM ({pairs})),
    dp AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: j * 0.5::DOUBLE) AS row FROM p
        UNION ALL
        SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1),
            lambda acc, j: list_append(acc, least(acc[j] + 0.5, row[j + 1] + 0.5, row[j] + CASE WHEN substr(a, (i + 1)::INTEGER, 1) = substr(b, j::INTEGER, 1) THEN 0 ELSE 1 END)::DOUBLE), [((i + 1) * 0.5)::DOUBLE])
        FROM dp WHERE i < length(a)),
    scores AS (SELECT a, b, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - row[length(b) + 1] / greatest(length(a), length(b)) END AS score FROM dp WHERE i = length(a))"""


def named_scores(term: str) -> str:
    return f"WITH {score_sql(f"SELECT '{term}' AS term, name AS content FROM ({NAMES})")}, scored AS (SELECT n.*, round(s.score, 9) AS score FROM ({NAMES}) n JOIN scores s ON s.b = lower(n.name))"


def round_to(c: Column, digits: int) -> Column:
    """Rounded in binary, halves away from zero, as DuckDB rounds a DOUBLE; Spark's own goes by way of decimals."""
    return F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits


def rounded(df: DataFrame, column: str = "score", digits: int = 9) -> DataFrame:
    return df.withColumn(column, round_to(F.col(column), digits))


@query(f"WITH {score_sql(f"SELECT '{TERM}' AS term, p_name AS content FROM part")} SELECT p_partkey, p_name, round(score, 9) AS score FROM part JOIN scores ON b = lower(p_name)")
def fuzzy_score_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "part").select("p_partkey", "p_name", fuzzy.score(TERM, F.col("p_name")).alias("score")))


@query(f"WITH {score_sql(f"SELECT '{TERM * 6}' AS term, p_name AS content FROM part")} SELECT p_partkey, round(score, 9) AS score FROM part JOIN scores ON b = lower(p_name)")
def fuzzy_long_term(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "part").select("p_partkey", fuzzy.score(TERM * 6, F.col("p_name")).alias("score")))


@query(f"{named_scores(TERM)} SELECT name AS item, score FROM scored ORDER BY score DESC, ord LIMIT 25")
def fuzzy_topn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.fuzzy_top_n(names(spark, d), TERM, 25)).select(F.col("name").alias("item"), "score")


@query(f"{named_scores('CHINA')} SELECT ord, name, score FROM scored WHERE kind = 'entity' ORDER BY score DESC, ord LIMIT 5")
def fuzzy_kind_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.fuzzy_top_n(search.of_kind(names(spark, d), "entity"), "CHINA", "5")).select("ord", "name", "score")


@query(f"{named_scores('Customer#000000007')} SELECT ord, name, score FROM scored WHERE score >= 0.8")
def fuzzy_min_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.fuzzy_top_n(names(spark, d), "Customer#000000007", least=0.8)).select("ord", "name", "score")


@query("SELECT n_name AS item, 0.5::DOUBLE AS score, (row_number() OVER (ORDER BY n_nationkey))::INTEGER AS place FROM nation")
def fuzzy_empty_term(spark: SparkSession, d: str) -> DataFrame:
    found = search.fuzzy_top_n(table(spark, d, "nation"), "", item="n_name", order="n_nationkey")
    return found.select(F.col("n_name").alias("item"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "n_nationkey")).alias("place"))


@query(f"{named_scores('steel')} SELECT name FROM scored ORDER BY score DESC, ord LIMIT 100")
def names_only(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_top_n(names(spark, d), "steel", 100).select("name")


@query(f"{named_scores('supplier')} SELECT t.name, t.score, s_nationkey, s_acctbal FROM (SELECT * FROM scored WHERE kind = 'type' ORDER BY score DESC, ord LIMIT 10) t JOIN supplier ON s_name = t.name")
def full_definition(spark: SparkSession, d: str) -> DataFrame:
    best = rounded(search.fuzzy_top_n(search.of_kind(names(spark, d), "type"), "supplier", 10))
    return best.join(table(spark, d, "supplier"), F.col("s_name") == F.col("name")).select("name", "score", "s_nationkey", "s_acctbal")


@query(f"WITH {score_sql('SELECT r_name AS term, n_name AS content FROM region, nation')} SELECT r_name, n_name, round(score, 9) AS score FROM region, nation JOIN scores ON b = lower(n_name) AND a = lower(r_name)")
def fuzzy_join_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.fuzzy_join(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), "r_name", "n_name"))


def _nations(spark: SparkSession, d: str, n: object) -> DataFrame:
    return search.first_n(table(spark, d, "nation").select("n_nationkey", "n_name"), [F.asc("n_name")], n)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT (SELECT count(*) - 4 FROM nation)")
def negative_n(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d, -4)


@query("SELECT n_nationkey, n_name FROM nation LIMIT 0")
def zero_n(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d, 0)


@query("SELECT n_nationkey, n_name FROM nation")
def all_n(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d, None)


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


def _nearest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors that have a document, and their texts: ids are joined first, texts for the ten alone."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "vec_id")
    held = table(spark, d, "embeddings").join(docs.select("vec_id"), "vec_id", "left_semi")
    best = search.search_vectors(held, _first_vector(spark, d), 10, order="vec_id").select("vec_id", "similarity")
    return search.first_n(docs.select("vec_id", "text").join(F.broadcast(best), "vec_id"), search.similarity_order("vec_id"))


RANKED = f"SELECT e.vec_id, d.text, round(list_cosine_similarity({Q0}, e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"


@query(f"SELECT vec_id, round(list_cosine_similarity({Q0}, embedding::DOUBLE[]), 6) AS similarity FROM embeddings")
def cosine_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.search_vectors(table(spark, d, "embeddings"), _first_vector(spark, d), order="vec_id"), "similarity", 6).select("vec_id", "similarity")


@query(f"{RANKED} ORDER BY list_cosine_similarity({Q0}, e.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def docs_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest_documents(spark, d), "similarity", 6).select("vec_id", "text", "similarity")


@query(f"SELECT coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY s DESC, vec_id), '') AS text FROM (SELECT e.vec_id, d.text, list_cosine_similarity({Q0}, e.embedding::DOUBLE[]) AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id ORDER BY s DESC, e.vec_id LIMIT 10)")
def docs_topk_text(spark: SparkSession, d: str) -> DataFrame:
    return search.joined_text(_nearest_documents(spark, d), search.similarity_order("vec_id"), "text")


@query("SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e)) WHERE rank <= 5")
def docs_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(search.nearest_batch(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5, "vec_id", "embedding"), "similarity", 6)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", round_to(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT vec_id, round(list_inner_product({Q0}, embedding::DOUBLE[]), 6) AS dot FROM embeddings")
def dot_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", round_to(vectors.dot(vectors.vector(_first_vector(spark, d)), F.col("embedding")), 6).alias("dot"))


@query("SELECT vec_id, i::INTEGER AS dim, round((embedding[i + 1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE, 5) AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)")
def normalize_vec(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalised(F.col("embedding"))).alias("dim", "x"))
    return rounded(flat.withColumn("x", F.col("x").cast("double")), "x", 5)


MEANS = "SELECT {key}, (i - 1)::INTEGER AS dim, round(avg(x::DOUBLE)::FLOAT::DOUBLE, 5) AS x FROM (SELECT {key}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY {key}, i"


@query(MEANS.format(key="label"))
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    means = vectors.mean_by(table(spark, d, "embeddings"), ["label"], "embedding")
    return rounded(means.select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double")), "x", 5)


@query("SELECT (vec_id // 3)::BIGINT AS text_id, (i - 1)::INTEGER AS dim, round(avg(x::DOUBLE)::FLOAT::DOUBLE, 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def chunk_average(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "embeddings").withColumn("text_id", F.floor(F.col("vec_id") / 3).cast("bigint"))
    means = vectors.mean_by(chunks, ["text_id"], "embedding")
    return rounded(means.select("text_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double")), "x", 5)


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AS finite, len(embedding)::INTEGER AS dim, len(embedding) = 64 AS dim_ok FROM embeddings")
def finite_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.all_finite(F.col("embedding")).alias("finite"), F.size("embedding").alias("dim"), (F.size("embedding") == 64).alias("dim_ok"))


@query("SELECT count(*) AS chunks, sum(len(embedding))::BIGINT AS n_values, (sum(len(embedding)) = count(*) * max(len(embedding))) AS size_ok FROM embeddings")
def size_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.count("*").alias("chunks"), F.sum(F.size("embedding")).alias("n_values"), (F.sum(F.size("embedding")) == F.count("*") * F.max(F.size("embedding"))).alias("size_ok"))


WS = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PUNCT = r"!-/:-@\[-`{-~"
NOCONTROL = r"regexp_replace({}, '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', '', 'g')"
SQUEEZED = r"trim(regexp_replace({}, '[" + WS.replace("{", "{{").replace("}", "}}") + r"]+', ' ', 'g'), ' ')"
PRE = f"regexp_extract_all({{}}, '[{PUNCT.replace('{', '{{').replace('}', '}}')}]|[^{(PUNCT + WS).replace('{', '{{').replace('}', '}}')}]+')"


@query(f"SELECT doc_id, {NOCONTROL.format('chr(7) || text || chr(11) || chr(127) || text')} AS text FROM documents")
def control_strip(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("\x07"), "text", F.lit("\x0b\x7f"), "text")
    return table(spark, d, "documents").select("doc_id", text.strip_control(dirty).alias("text"))


@query(f"SELECT doc_id, {SQUEEZED.format("chr(160) || chr(9) || text || chr(8195) || ' ' || text || chr(10)")} AS text FROM documents")
def squeeze_ws(spark: SparkSession, d: str) -> DataFrame:
    loose = F.concat(F.lit("\xa0\t"), "text", F.lit("  "), "text", F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", text.squeeze_space(loose).alias("text"))


@query(f"SELECT doc_id, len(t)::INTEGER AS n, array_to_string(t, chr(1)) AS tokens FROM (SELECT doc_id, {PRE.format('text')} AS t FROM documents)")
def pretokenize(spark: SparkSession, d: str) -> DataFrame:
    t = text.pretokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, "\x01").alias("tokens"))


@query(f"SELECT DISTINCT c, regexp_matches(c, '^[{PUNCT}]') AS punctuation FROM (SELECT unnest(string_split(text || '—’«。[]{{}}~`', '')) AS c FROM documents) WHERE c <> ''")
def punctuation_class(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.explode(F.split(F.concat("text", F.lit("—’«。[]{}~`")), "")).alias("c")).where("c <> ''").distinct()
    return c.select("c", text.is_punctuation(F.col("c")).alias("punctuation"))


ACCENTED = {c: __import__("unicodedata").normalize("NFD", c) for c in "éóèñçüêäöíáúàâîôûëïùÉÓÈÑÇÜÊÄÖÍÁÚÀÂÎÔÛËÏÙ"}
NFD_SQL = "text"
for _c, _n in ACCENTED.items():
    NFD_SQL = f"replace({NFD_SQL}, '{_c}', '{_n}')"


@query(f"SELECT doc_id, {NFD_SQL} AS text, length({NFD_SQL}) AS n FROM documents")
def nfd_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfd("text").alias("text")).withColumn("n", F.length("text").cast("bigint"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
STOP = ("the", "of", "##tion", "##ing", "##er", "##ent", "##und", "##os", "de", "la", "le", "##eau", "th", "##th", "an", "##an", "ciudad", "##heit", "[", "]", "!", ",", ".", "|", "#", "##ll")
VOCAB = {t: i for i, t in enumerate(("[PAD]", "[UNK]", "[CLS]", "[SEP]", *LETTERS, *(f"##{c}" for c in LETTERS if c != "q"), *STOP))}
VOCAB_SQL = "(VALUES " + ", ".join(f"('{t}', {i}::BIGINT)" for t, i in VOCAB.items()) + ") AS v(token, id)"
WORDPIECE_SQL = f"""
WITH RECURSIVE tok AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {PRE.format('text')} AS t FROM documents)),
w AS (SELECT DISTINCT word FROM tok),
v AS (SELECT * FROM {VOCAB_SQL}),
r AS (SELECT word, lower(word) AS rest, []::VARCHAR[] AS pieces, true AS ok FROM w
    UNION ALL
    SELECT r.word, CASE WHEN b.t IS NULL THEN '' ELSE substr(r.rest, length(b.t) + 1) END, list_append(r.pieces, CASE WHEN len(r.pieces) > 0 THEN '##' ELSE '' END || b.t), b.t IS NOT NULL
    FROM r CROSS JOIN LATERAL (SELECT max_by(t, length(t)) AS t FROM (SELECT CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE token END AS t, starts_with(token, '##') AS inner_piece FROM v) x
        WHERE starts_with(r.rest, x.t) AND x.t <> '' AND x.inner_piece = (len(r.pieces) > 0)) b
    WHERE r.rest <> '' AND r.ok),
done AS (SELECT word, CASE WHEN bool_and(ok) AND max(length(word)) <= 200 THEN max_by(pieces, len(pieces)) FILTER (WHERE rest = '') ELSE ['[UNK]'] END AS pieces FROM r GROUP BY word),
flat AS (SELECT doc_id, pos, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM tok JOIN done USING (word))
SELECT doc_id, string_agg(piece, ' ' ORDER BY pos, k) AS pieces, string_agg(id::VARCHAR, ' ' ORDER BY pos, k) AS ids FROM flat JOIN v ON token = piece GROUP BY doc_id
"""


@query(WORDPIECE_SQL)
def wordpiece(spark: SparkSession, d: str) -> DataFrame:
    pre = table(spark, d, "documents").select("doc_id", text.pretokens(F.col("text")).alias("pre"))
    cut = text.wordpiece(pre, "pre", VOCAB)
    return cut.where(F.size("pieces") > 0).select("doc_id", F.array_join("pieces", " ").alias("pieces"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"SELECT doc_id, (i // 459)::INTEGER AS chunk_no, least(len(t) - i, CASE WHEN len(t) <= 510 THEN 510 ELSE 509 END)::INTEGER AS n, md5(array_to_string(CASE WHEN len(t) <= 510 THEN t ELSE t[i + 1:i + 509] END, ' ')) AS digest FROM (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 510 THEN [0] ELSE range(0, len(t), 459) END) AS i FROM (SELECT doc_id, {PRE.format('text')} AS t FROM documents))")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.posexplode(text.windows(text.pretokens(F.col("text")))).alias("chunk_no", "w"))
    return w.select("doc_id", "chunk_no", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def _services(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/v4/"), F.lower("r_name"), F.lit("/"))
    ends = F.array(F.struct(F.lit("odata").alias("kind"), path.alias("path")), F.struct(F.lit("rest").alias("kind"), F.concat(F.lit("/rest"), path).alias("path")))
    return table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("service"), ends.alias("endpoints"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    entity = F.when(F.col("n_nationkey") % 7 == 3, F.concat("n_name", F.lit(".texts"))).when(F.col("n_nationkey") % 11 == 5, F.concat("n_name", F.lit(".DraftAdministrativeData"))).otherwise(F.concat(F.lit("a.b."), "n_name"))
    n = table(spark, d, "nation").withColumn("entity", entity).withColumn("autoexposed", F.col("n_nationkey") % 3 == 0).withColumn("autoexpose", F.when(F.col("n_nationkey") % 2 == 0, True))
    return n.join(_services(spark, d), F.col("n_regionkey") == F.col("r_regionkey")).select("service", "entity", F.concat("service", F.lit("."), "entity").alias("name"), "autoexposed", "autoexpose", "endpoints")


ENTITIES = """SELECT r_name AS service, CASE WHEN n_nationkey % 7 = 3 THEN n_name || '.texts' WHEN n_nationkey % 11 = 5 THEN n_name || '.DraftAdministrativeData' ELSE 'a.b.' || n_name END AS entity,
    n_nationkey % 3 = 0 AS auto1, n_nationkey % 2 = 0 AS auto2 FROM nation JOIN region ON n_regionkey = r_regionkey"""
SHOWN = f"SELECT * FROM ({ENTITIES}) WHERE NOT (auto1 AND NOT auto2) AND NOT regexp_matches(entity, 'DraftAdministrativeData$') AND NOT regexp_matches(entity, '[._]texts$')"


@query(f"SELECT service, entity, service || '.' || entity AS name FROM ({SHOWN}) WHERE service || '.' || entity NOT LIKE 'ASIA%'")
def exposed_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    return catalog.exposed_entities(e, e.where("service = 'ASIA'")).select("service", "entity", "name")


@query(f"SELECT service || '.' || entity AS name, 'odata:/v4/' || lower(service) || '/' || replace(entity, '.', '_') || ',rest:/rest/v4/' || lower(service) || '/' || replace(entity, '.', '_') AS endpoints FROM ({SHOWN})")
def endpoint_paths(spark: SparkSession, d: str) -> DataFrame:
    made = catalog.entity_endpoints(_services(spark, d), catalog.exposed_entities(_entities(spark, d)))
    return made.select("name", F.array_join(F.transform("endpoints", lambda e: F.concat_ws(":", e["kind"], e["path"])), ",").alias("endpoints"))


@query("SELECT n_name AS name, CASE WHEN s_n IS NULL THEN 'none' ELSE 'info' END AS origin, coalesce(s_n, n_nationkey)::BIGINT AS value FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS s_n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def serviceinfo_merge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    info = table(spark, d, "supplier").where("s_suppkey % 2 = 0").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("value")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.lit("info").alias("origin"), "value")
    defs = n.select(F.col("n_name").alias("name"), F.lit("none").alias("origin"), F.col("n_nationkey").cast("bigint").alias("value"))
    return catalog.merge_services(defs, info, ["origin", "value"]).select("name", "origin", "value")


@query("SELECT coalesce(o.k, n.k) AS path, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 1) o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 2 THEN o_totalprice + 1 WHEN o_orderkey % 13 <> 3 THEN o_totalprice END AS v FROM orders WHERE o_orderkey % 10 <> 5) n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v IS DISTINCT FROM n.v")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"))
    new = F.when(F.col("path") % 7 == 2, F.col("mtime") + 1).when(F.col("path") % 13 != 3, F.col("mtime"))
    return catalog.changes(o.where("path % 10 <> 1"), o.where("path % 10 <> 5").withColumn("mtime", new))


@query("SELECT vec_id, (i - 1)::INTEGER AS place, (e[i])::DOUBLE AS x, (l[i])::INTEGER AS label FROM (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: label) AS l, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("labels", F.expr("transform(embedding, x -> label)"))
    return e.select("vec_id", F.posexplode(F.arrays_zip("embedding", "labels")).alias("place", "z")).select("vec_id", "place", F.col("z.embedding").cast("double").alias("x"), F.col("z.labels").alias("label"))


@query("SELECT (row_number() OVER (ORDER BY vec_id, i) - 1)::BIGINT AS place, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def flatten_vectors(spark: SparkSession, d: str) -> DataFrame:
    flat = vectors.flatten(table(spark, d, "embeddings"), "vec_id", "embedding")
    return flat.select(F.posexplode("flat").alias("place", "x")).select(F.col("place").cast("bigint").alias("place"), F.col("x").cast("double").alias("x"))


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS ord, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_slices(spark: SparkSession, d: str) -> DataFrame:
    flat = vectors.flatten(table(spark, d, "embeddings"), "vec_id", "embedding")
    return vectors.unflatten(flat, "flat", 64).select("ord", round_to(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT page_id, url || chr(10) || 'html, page' || chr(10) || substr(html, 1, 40) || chr(10) || chr(10) || '```html' || chr(10) || html || chr(10) || '```' || chr(10) AS chunk FROM pages")
def chunk_template(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array_join(F.array(F.lit("html"), F.lit("page")), ", ")
    return table(spark, d, "pages").select("page_id", snippet(F.col("url"), labels, F.substring("html", 1, 40), F.lit("html"), F.col("html")).alias("chunk"))


def snippet(source: Column, labels: Column, summary: Column, kind: Column, code: Column) -> Column:
    """A code snippet's text for embedding."""
    return F.concat(source, F.lit("\n"), labels, F.lit("\n"), summary, F.lit("\n\n```"), kind, F.lit("\n"), code, F.lit("\n```\n"))


TREE = "SELECT r_regionkey AS id, NULL::INTEGER AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation UNION ALL SELECT (1000 + s_suppkey)::INTEGER, 100 + s_nationkey, s_name FROM supplier"


@query(f"WITH RECURSIVE t AS ({TREE}), h AS (SELECT id, name, 0 AS level, name AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.name, h.level + 1, h.path || '/' || t.name FROM t JOIN h ON t.parent = h.id) SELECT * FROM h")
def recursive_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    for t in ("region", "nation", "supplier"):
        table(spark, d, t).createOrReplaceTempView(f"tree_{t}")
    return spark.sql("""WITH RECURSIVE t AS (SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent, r_name AS name FROM tree_region
            UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM tree_nation UNION ALL SELECT CAST(1000 + s_suppkey AS INT), 100 + s_nationkey, s_name FROM tree_supplier),
        h AS (SELECT id, name, 0 AS level, name AS path FROM t WHERE parent IS NULL
            UNION ALL SELECT t.id, t.name, h.level + 1, concat(h.path, '/', t.name) FROM t JOIN h ON t.parent = h.id)
        SELECT id, name, level, path FROM h""")


@query("SELECT o_orderkey, CASE WHEN l_n IS NULL THEN 'not found' WHEN o_totalprice < 1000 THEN 'too small' WHEN l_n < 3 THEN 'sold out' ELSE 'ok' END AS outcome, CASE WHEN l_n > 3 THEN o_orderpriority || ' -- 11% discount!' ELSE o_orderpriority END AS title FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS l_n FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey")
def order_outcomes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, d, "orders").join(n, "o_orderkey", "left")
    outcome = F.when(F.col("n").isNull(), "not found").when(F.col("o_totalprice") < 1000, "too small").when(F.col("n") < 3, "sold out").otherwise("ok")
    return joined.select("o_orderkey", outcome.alias("outcome"), F.when(F.col("n") > 3, F.concat("o_orderpriority", F.lit(" -- 11% discount!"))).otherwise(F.col("o_orderpriority")).alias("title"))


@query("SELECT (greatest(coalesce((SELECT max(o_orderkey) FROM orders), 0), coalesce((SELECT max(l_orderkey) FROM lineitem), 0)) + 1)::BIGINT AS next_id, (SELECT count(*) FROM orders) AS n_orders")
def next_id(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").agg(F.max("o_orderkey").alias("a"), F.count("*").alias("n_orders"))
    return a.crossJoin(table(spark, d, "lineitem").agg(F.max("l_orderkey").alias("b"))).select((F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) + 1).alias("next_id"), "n_orders")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, c_name AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def projection_with_path(spark: SparkSession, d: str) -> DataFrame:
    """Orders without some columns and with their customer's name."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"))
    return table(spark, d, "orders").drop("o_orderdate", "o_orderpriority").join(names, "o_custkey", "left").drop("o_custkey")


@query("SELECT s_suppkey, s_name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def value_texts(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("s_suppkey", "s_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'de ' || upper(p_name) ELSE p_name END AS name, p_brand AS brand FROM part")
def localised_names(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    own = [base.where(F.col("id") % k == 0).select("id", F.lit(x).alias("locale"), F.concat(F.lit(f"{x} "), F.upper("name")).alias("name")) for k, x in ((3, "de"), (2, "fr"))]
    return schema_json.localised(base, own[0].union(own[1]), "de", "id", ["name"])


@query("SELECT n_name AS def_name, elem_name, key, type FROM nation, (VALUES ('IsActiveEntity', true, 'Boolean'), ('HasActiveEntity', false, 'Boolean'), ('HasDraftEntity', false, 'Boolean')) AS v(elem_name, key, type) WHERE n_nationkey % 2 = 0")
def draft_elements(spark: SparkSession, d: str) -> DataFrame:
    return catalog.draft_elements(table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("draft_enabled")))


@query(f"WITH tok AS (SELECT unnest({PRE.format('text')}) AS word FROM documents), v AS (SELECT * FROM {VOCAB_SQL}) SELECT coalesce(id, {VOCAB['[UNK]']})::BIGINT AS id, count(*) AS n FROM tok LEFT JOIN v ON token = lower(word) GROUP BY 1")
def vocabulary_lookup(spark: SparkSession, d: str) -> DataFrame:
    vocab = spark.createDataFrame(list(VOCAB.items()), "word string, id bigint")
    words = table(spark, d, "documents").select(F.explode(text.pretokens(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    return words.join(F.broadcast(vocab), "word", "left").groupBy(F.coalesce("id", F.lit(VOCAB["[UNK]"]).cast("bigint")).alias("id")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, (i // 459)::INTEGER AS chunk_no, md5('[CLS] ' || array_to_string(list_append(w, '[SEP]'), ' ')) AS digest FROM (SELECT doc_id, i, CASE WHEN len(t) <= 510 THEN t ELSE t[i + 1:i + 509] END AS w FROM (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 510 THEN [0] ELSE range(0, len(t), 459) END) AS i FROM (SELECT doc_id, {PRE.format('text')} AS t FROM documents)))")
def marked_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.posexplode(text.windows(text.pretokens(F.col("text")))).alias("chunk_no", "w"))
    return w.select("doc_id", "chunk_no", F.md5(F.array_join(text.with_marks(F.col("w"), "[CLS]", "[SEP]"), " ")).alias("digest"))


@query("SELECT kind, count(*) AS n, min(name) AS least FROM (" + NAMES + ") GROUP BY kind")
def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("least"))


def scratch(spark: SparkSession) -> str:
    """A folder for queries that write and read files of their own: the shared one on a cluster."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        shared = shared.removeprefix("file://")
        if "://" in shared or not os.path.isdir(shared):
            raise ValueError("these queries write plain files; spark.checkpoint.dir is to be a mounted folder")
        return tempfile.mkdtemp(dir=shared)
    return tempfile.mkdtemp(prefix="quern-")


@query("SELECT vec_id::INTEGER AS ord, 'chunk ' || vec_id AS content, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vecstore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a pair of files, read again."""
    folder = scratch(spark)
    e = table(spark, d, "embeddings")
    vecstore.export_pair(e.select(F.col("vec_id").cast("int").alias("ord"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("content"), "embedding"), "all", folder)
    back = vecstore.chunks(spark, "all", folder)
    e = F.col("embedding").cast("array<double>")
    return back.select("ord", "content", F.size("embedding").alias("n"), e[0].alias("first"), F.element_at(e, -1).alias("last"), round_to(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items embedded by the stand-in model."""
    return embed.embed(table(spark, d, "benchmark").select("item_id", "text"), "text", VOCAB, embed.hash_model(32)).select("item_id", "embedding")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT r_name, min(k) AS k, count(*) AS n FROM n GROUP BY r_name),
each AS (SELECT k * 2 - 1 AS spot, r_name AS name, 'service' AS kind, '/' || replace(lower(r_name), ' ', '-') || '/' AS path, n AS n_exposed FROM s
    UNION ALL SELECT k * 2, r_name || '.' || n_name, 'entity', '/' || replace(lower(r_name), ' ', '-') || '/' || n_name, 0 FROM n)
SELECT (row_number() OVER (ORDER BY spot) - 1)::BIGINT AS ord, name, kind, path, n_exposed::INTEGER AS n_exposed FROM each""")
def schema_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of all nations as entities of their regions, through schema JSON."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select("r_name", "n_name").orderBy("n_nationkey").collect()
    defs: dict = {}
    for r in rows:
        defs.setdefault(r.r_name, {"kind": "service", "endpoints": [{"kind": "odata", "path": f"/{r.r_name.lower().replace(' ', '-')}/"}]})
        defs[f"{r.r_name}.{r.n_name}"] = {"kind": "entity", "elements": {"ID": {"key": True, "type": "Integer"}, "name": {"type": "String"}}}
    built = schema_json.build(schema_json.definitions(spark.createDataFrame([(json.dumps({"definitions": defs}),)], "value string")))
    place = F.col("ord").bitwiseAND(F.lit((1 << 24) - 1)).alias("ord")  # there is one document
    return built.select(place, "name", "kind", F.col("endpoints")[0]["path"].alias("path"), F.coalesce(F.size("exposed_entities"), F.lit(0)).alias("n_exposed"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 1000)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One order by its key, and of its columns one; the filter reaches the scan."""
    orders = table(spark, d, "orders")
    key = orders.where("o_orderkey <= 1000").agg(F.max("o_orderkey")).first()[0]
    return catalog.lookup(orders, "o_orderkey", key, ["o_totalprice"])


WANTED = "SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS book, l_quantity AS quantity FROM lineitem"


@query(f"""WITH w AS ({WANTED}), p AS (SELECT p_partkey AS id, 1000::DOUBLE AS stock FROM part),
r AS (SELECT w.*, stock, sum(CASE WHEN quantity >= 1 THEN quantity ELSE 0 END) OVER (PARTITION BY book ORDER BY order_id, line ROWS UNBOUNDED PRECEDING) AS upto FROM w LEFT JOIN p ON id = book)
SELECT p.id, p.stock - coalesce(max(r.upto) FILTER (WHERE r.upto <= p.stock), 0) AS stock FROM p LEFT JOIN r ON book = id GROUP BY p.id, p.stock""")
def stock_update(spark: SparkSession, d: str) -> DataFrame:
    """The stock of each part after the orders that it could meet, in their order."""
    return catalog.take_orders(_stock(spark, d), _wanted(spark, d))[0]


@query(f"""WITH w AS ({WANTED}), r AS (SELECT w.*, sum(CASE WHEN quantity >= 1 THEN quantity ELSE 0 END) OVER (PARTITION BY book ORDER BY order_id, line ROWS UNBOUNDED PRECEDING) AS upto FROM w JOIN part ON p_partkey = book)
SELECT order_id, line, book, quantity FROM r WHERE quantity >= 1 AND upto <= 1000""")
def order_events(spark: SparkSession, d: str) -> DataFrame:
    """An event for each order that was met."""
    return catalog.take_orders(_stock(spark, d), _wanted(spark, d))[1].select("order_id", "line", "book", "quantity")


def _stock(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1000.0).alias("stock"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("book"), F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber").alias("at"))
