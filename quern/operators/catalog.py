"""The catalog of schema definitions: derived columns, services, endpoints and change detection.

A catalog is a DataFrame (ord, name, kind, body, endpoints, exposed_entities); body holds the open
rest of a definition as VARIANT, ord the order of declaration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDPOINTS = "array<struct<kind:string,path:string>>"
DRAFT_ELEMENTS = (("IsActiveEntity", "Boolean", True), ("HasActiveEntity", "Boolean", False), ("HasDraftEntity", "Boolean", False))


def not_autoexposed(autoexposed: Column, autoexpose: Column) -> Column:
    """False for what a service shows only because something refers to it."""
    return ~(F.coalesce(autoexposed, F.lit(False)) & ~F.coalesce(autoexpose, F.lit(False)))


def not_draft_admin(name: Column) -> Column:
    return ~name.endswith("DraftAdministrativeData")


def not_texts(name: Column) -> Column:
    return ~(name.endswith(".texts") | name.endswith("_texts"))


def exposed_entities(entities: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """The entities (service, entity, name, autoexposed, autoexpose, …) that a service shows.
    contained: names of contained entities, which are left out; None if containment is off."""
    seen = entities.where(not_autoexposed(F.col("autoexposed"), F.col("autoexpose")) & not_draft_admin(F.col("name")) & not_texts(F.col("name")))
    return seen if contained is None else seen.join(contained.select("name").distinct(), "name", "left_anti")


def exposed_name(service: Column, entity: Column) -> Column:
    return F.concat(service, F.lit("."), entity)


def endpoint_path(path: Column, entity: Column) -> Column:
    return F.concat(path, F.replace(entity, F.lit("."), F.lit("_")))


def merge_services(definitions: DataFrame, info: DataFrame, columns: list[str]) -> DataFrame:
    """definitions with the columns of the service records of the same name, which win where they
    have a value. LookupError if a record has no definition."""
    if missing := [r[0] for r in info.join(definitions, "name", "left_anti").select("name").limit(3).collect()]:
        raise LookupError(f"services without a definition: {', '.join(missing)}")
    renamed = info.select("name", *[F.col(c).alias(f"_info_{c}") for c in columns])
    merged = definitions.join(renamed, "name", "left")
    values = {c: F.coalesce(F.col(f"_info_{c}"), F.col(c)) if c in definitions.columns else F.col(f"_info_{c}") for c in columns}
    return merged.withColumns(values).drop(*[f"_info_{c}" for c in columns])


def entity_endpoints(services: DataFrame, exposed: DataFrame) -> DataFrame:
    """(name, endpoints): one endpoint of each exposed entity for each of its service's, in their order.

    services: (service, endpoints); exposed: (service, entity)."""
    each = services.select("service", F.posexplode("endpoints").alias("no", "e")).join(exposed.select("service", "entity"), "service")
    made = each.select(exposed_name(F.col("service"), F.col("entity")).alias("name"), F.struct("no", F.col("e.kind").alias("kind"), endpoint_path(F.col("e.path"), F.col("entity")).alias("path")).alias("s"))
    return made.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["kind"].alias("kind"), s["path"].alias("path"))).alias("endpoints"))


def add_endpoints(definitions: DataFrame, more: DataFrame) -> DataFrame:
    """definitions with the endpoints of more appended to their own."""
    own = F.coalesce(F.col("endpoints"), F.array().cast(ENDPOINTS))
    joined = definitions.join(more.select("name", F.col("endpoints").alias("_more")), "name", "left")
    return joined.withColumn("endpoints", F.when(F.col("_more").isNull(), F.col("endpoints")).otherwise(F.concat(own, F.col("_more")))).drop("_more")


def draft_elements(entities: DataFrame) -> DataFrame:
    """(def_name, elem_name, key, type) of the elements that entities with drafts get besides their own."""
    rows = F.array(*[F.struct(F.lit(n).alias("elem_name"), F.lit(k).alias("key"), F.lit(t).alias("type")) for n, t, k in DRAFT_ELEMENTS])
    return entities.where("draft_enabled").select(F.col("name").alias("def_name"), F.explode(rows).alias("e")).select("def_name", "e.*")


def lookup(df: DataFrame, key: str, value: object, columns: list[str]) -> DataFrame:
    """The row with a key, its key and some columns; no row if there is none."""
    return df.where(F.col(key) == F.lit(value)).select(key, *columns).limit(1)


def take_orders(stock: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stock (id, stock) after orders (book, quantity, at, …), and the orders that were met, as events.

    Orders are taken by at. One below 1, or of a book that isn't there, is refused; of a book's others
    those are met that the stock meets together with all before them. Parquet has no update in place:
    the new stock is a table to put in the old one's place, the events are rows to append to a sink.
    """
    valid = orders.where("quantity >= 1").join(stock.withColumnRenamed("id", "book"), "book")
    upto = F.sum("quantity").over(Window.partitionBy("book").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    met = valid.withColumn("_upto", upto).where(F.col("_upto") <= F.col("stock"))
    sold = met.groupBy(F.col("book").alias("id")).agg(F.max("_upto").alias("_sold"))
    left = stock.join(sold, "id", "left").withColumn("stock", F.col("stock") - F.coalesce("_sold", F.lit(0)))
    return left.drop("_sold"), met.drop("stock", "_upto")


def emit(events: DataFrame, sink: str) -> None:
    """Appends events to a sink; readers see a call's events all at once."""
    events.write.mode("append").parquet(sink)


def changes(old: DataFrame, new: DataFrame, key: str = "path", value: str = "mtime") -> DataFrame:
    """(key, change) of what differs between two snapshots: added, removed or changed."""
    o, n = old.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return o.join(n, key, "full").select(key, kind.alias("change")).where("change is not null")


def changed(old: DataFrame, new: DataFrame, key: str = "path", value: str = "mtime") -> bool:
    return not changes(old, new, key, value).isEmpty()
