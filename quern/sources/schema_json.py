"""Catalogs from compiled schema JSON, and the small files around them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import catalog


def schema_files(spark: SparkSession, root: str, suffix: str = "cds") -> DataFrame:
    """(path, mtime) of all files with a suffix under root, but not below any node_modules. The
    contents aren't read; a folder without such files gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    return files.where(~F.col("path").contains("/node_modules/")).select("path", F.col("modificationTime").alias("mtime"))


def declared_order(keys: Column) -> Column:
    """Array of object keys in the order an ECMAScript object lists them: whole numbers first, by size."""
    def number(k: Column) -> Column:
        return k.rlike("^(0|[1-9][0-9]{0,8}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[01][0-9]{2}|42949672[0-8][0-9]|429496729[0-4])$")

    numbers = F.transform(F.array_sort(F.transform(F.filter(keys, number), lambda k: k.cast("bigint"))), lambda n: n.cast("string"))
    return F.concat(numbers, F.filter(keys, lambda k: ~number(k)))


def definitions(text: DataFrame, column: str = "value", source: str = "the input") -> DataFrame:
    """The catalog (ord, name, kind, body) of documents of compiled schema JSON, one a row.

    FileNotFoundError for no rows, ValueError for JSON that can't be read or has no definitions."""
    if text.isEmpty():
        raise FileNotFoundError(f"no schema in {source}")
    parsed = text.select(F.col(column).alias("_t"), F.try_parse_json(column).alias("_j"))
    if not parsed.where("_j is null or is_variant_null(_j)").isEmpty():
        raise ValueError(f"schema of {source} can't be read")
    defs = F.expr("try_variant_get(_j, '$.definitions', 'map<string,variant>')")
    keys = F.json_object_keys(F.get_json_object("_t", "$.definitions"))
    rows = parsed.withColumn("_file", F.monotonically_increasing_id()).select("_file", defs.alias("_d"), F.posexplode(declared_order(keys)).alias("ord", "name"))
    if rows.isEmpty():
        raise ValueError(f"schema of {source} has no definitions")
    rows = rows.withColumn("body", F.expr("element_at(_d, name)"))
    # Order by input partition, document and place: 19, 20 and 24 bits.
    part, doc = F.shiftright("_file", 33), F.col("_file").bitwiseAND(F.lit((1 << 33) - 1))
    order = F.when((part < 1 << 19) & (doc < 1 << 20), F.shiftleft(part, 44) + F.shiftleft(doc, 24) + F.col("ord")).otherwise(F.raise_error(F.lit("too many documents in the input")).cast("long"))
    return rows.select(order.alias("ord"), "name", F.expr("try_variant_get(body, '$.kind', 'string')").alias("kind"), "body")


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return definitions(spark.read.text(path, wholetext=True), source=path)


def elements(defs: DataFrame) -> DataFrame:
    """(def_name, elem_name, key, type, body) of all elements; draft elements come from add_drafts."""
    each = defs.select(F.col("name").alias("def_name"), F.expr("explode(map_entries(try_variant_get(body, '$.elements', 'map<string,variant>')))").alias("e"))
    return each.select("def_name", F.col("e.key").alias("elem_name"), F.coalesce(F.expr("try_variant_get(e.value, '$.key', 'boolean')"), F.lit(False)).alias("key"), F.expr("try_variant_get(e.value, '$.type', 'string')").alias("type"), F.col("e.value").alias("body"))


def annotated(defs: DataFrame, annotation: str) -> Column:
    return F.coalesce(F.expr(f"try_variant_get(body, '$[\"{annotation}\"]', 'boolean')"), F.lit(False))


def all_elements(defs: DataFrame) -> DataFrame:
    """Own elements and those that drafts add: (def_name, elem_name, key, type)."""
    drafts = catalog.draft_elements(defs.withColumn("draft_enabled", annotated(defs, "@odata.draft.enabled")))
    return elements(defs).drop("body").unionByName(drafts)


def with_drafts(defs: DataFrame) -> DataFrame:
    """defs with the draft elements in the bodies of the entities that have drafts; own elements of their names stay."""
    added = F.create_map(*[x for n, t, k in catalog.DRAFT_ELEMENTS for x in (F.lit(n), F.parse_json(F.lit(json.dumps({"key": k, "type": t} if k else {"type": t}))))])
    own = F.coalesce(F.expr("try_variant_get(body, '$.elements', 'map<string,variant>')"), F.expr("cast(map() as map<string,variant>)"))
    every = F.map_concat(F.map_filter(added, lambda k, v: ~F.map_contains_key(own, k)), own)
    top = F.map_filter(F.expr("try_variant_get(body, '$', 'map<string,variant>')"), lambda k, v: k != "elements")
    whole = F.to_variant_object(F.map_concat(top, F.create_map(F.lit("elements"), F.to_variant_object(every))))
    return defs.withColumn("body", F.when(annotated(defs, "@odata.draft.enabled") & F.coalesce(F.col("kind") == "entity", F.lit(False)), whole).otherwise(F.col("body")))


def build(defs: DataFrame, info: DataFrame | None = None, containment: bool = False) -> DataFrame:
    """The whole catalog: definitions with their draft elements, and with the endpoints and exposed
    entities of their services.

    info: (name, endpoints) of services; None reads the endpoints in the bodies."""
    defs = with_drafts(defs)
    typed = defs.withColumn("endpoints", F.expr(f"try_variant_get(body, '$.endpoints', '{catalog.ENDPOINTS}')"))
    if info is not None:
        typed = catalog.merge_services(typed, info, ["endpoints"])
    services = typed.where("kind = 'service'").select(F.col("name").alias("service"), "endpoints")
    entities = typed.where("kind = 'entity'").select("ord", "name", annotated(defs, "@cds.autoexposed").alias("autoexposed"), annotated(defs, "@cds.autoexpose").alias("autoexpose"))
    within = entities.join(services.select("service"), F.expr("startswith(name, concat(service, '.'))")).withColumn("entity", F.expr("substr(name, length(service) + 2)"))
    within = within.select("ord", "service", "entity", "name", "autoexposed", "autoexpose")
    contained = None
    if containment:
        each = defs.select(F.expr("explode(map_entries(try_variant_get(body, '$.elements', 'map<string,variant>')))").alias("e"))
        contained = each.where(F.expr("try_variant_get(e.value, '$.type', 'string')").endswith("Composition")).select(F.expr("try_variant_get(e.value, '$.target', 'string')").alias("name"))
    shown = catalog.exposed_entities(within, contained)
    lists = shown.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("exposed_entities")).withColumnRenamed("service", "name")
    full = catalog.add_endpoints(typed, catalog.entity_endpoints(services.where("endpoints is not null"), shown))
    none = F.when(F.col("kind") == "service", F.array().cast("array<string>"))
    return full.join(lists, "name", "left").withColumn("exposed_entities", F.coalesce("exposed_entities", none)).select("ord", "name", "kind", "body", "endpoints", "exposed_entities")


def vocabulary(text: str) -> dict[str, int]:
    """The tokens of a tokenizer's JSON with numbers for ids; ValueError if there is no model.vocab."""
    vocab = (json.loads(text).get("model") or {}).get("vocab")
    if not isinstance(vocab, dict):
        raise ValueError("the tokenizer has no model.vocab")
    return {k: v for k, v in vocab.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    return vocabulary(spark.read.text(path, wholetext=True).first()[0])


def properties(text: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of lines key=value; empty lines and those that begin with # are left out."""
    line = F.trim(column)
    at = F.instr(column, "=")
    return text.where((F.length(line) > 0) & ~line.startswith("#") & (at > 0)).select(F.trim(F.expr(f"substr({column}, 1, instr({column}, '=') - 1)")).alias("key"), F.trim(F.expr(f"substr({column}, instr({column}, '=') + 1)")).alias("value"))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with a header and doubled quotes, by a given schema."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def localised(base: DataFrame, texts: DataFrame, locale: str, key: str, columns: Iterable[str]) -> DataFrame:
    """base with the columns in a locale where texts has them."""
    columns = list(columns)
    own = texts.where(F.col("locale") == locale).select(key, *[F.col(c).alias(f"_t_{c}") for c in columns])
    joined = base.join(own, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_t_{c}"), F.col(c)) for c in columns}).drop(*[f"_t_{c}" for c in columns])
