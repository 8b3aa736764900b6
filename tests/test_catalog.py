import json

import pytest

from quern.operators import catalog
from quern.sources import schema_json

SHOP = {
    "my.Books": {"kind": "entity", "elements": {"ID": {"key": True, "type": "Integer"}, "title": {"type": "String"}, "author": {"type": "Association", "target": "my.Authors"}}},
    "my.Authors": {"kind": "entity", "elements": {"ID": {"key": True, "type": "Integer"}}},
    "AdminService": {"kind": "service", "endpoints": [{"kind": "odata", "path": "odata/v4/admin/"}]},
    "AdminService.Books": {"kind": "entity", "@odata.draft.enabled": True, "elements": {"ID": {"key": True, "type": "Integer"}, "parts": {"type": "Composition", "target": "AdminService.Parts"}}},
    "AdminService.Books.texts": {"kind": "entity"},
    "AdminService.DraftAdministrativeData": {"kind": "entity"},
    "AdminService.Parts": {"kind": "entity"},
    "AdminService.Hidden": {"kind": "entity", "@cds.autoexposed": True},
    "AdminService.Shown": {"kind": "entity", "@cds.autoexposed": True, "@cds.autoexpose": True},
    "CatalogService": {"kind": "service", "endpoints": [{"kind": "odata", "path": "odata/v4/catalog/"}, {"kind": "rest", "path": "rest/catalog/"}]},
    "CatalogService.Books": {"kind": "entity"},
    "CatalogService.submitOrder": {"kind": "action"},
}


def text(spark, *documents):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string")


@pytest.fixture(scope="module")
def shop(spark):
    return schema_json.definitions(text(spark, {"definitions": SHOP})).cache()


def test_order_of_declaration(spark, shop):
    assert [r.name for r in shop.orderBy("ord").collect()] == list(SHOP)
    keys = {k: {"kind": "x"} for k in ("b", "10", "2", "a", "01", "4294967294", "4294967295")}
    got = schema_json.definitions(text(spark, {"definitions": keys})).orderBy("ord").collect()
    assert [r.name for r in got] == ["2", "10", "4294967294", "b", "a", "01", "4294967295"]


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        schema_json.definitions(text(spark).limit(0))
    for bad in ("{", "null", {"definitions": {}}, {}):
        with pytest.raises(ValueError):
            schema_json.definitions(text(spark, bad))


def test_catalog(shop):
    rows = {r.name: r for r in schema_json.build(shop).collect()}
    assert rows["AdminService"].exposed_entities == ["AdminService.Books", "AdminService.Parts", "AdminService.Shown"]
    assert [tuple(e) for e in rows["AdminService.Books"].endpoints] == [("odata", "odata/v4/admin/Books")]
    assert [tuple(e) for e in rows["CatalogService.Books"].endpoints] == [("odata", "odata/v4/catalog/Books"), ("rest", "rest/catalog/Books")]
    assert rows["my.Books"].endpoints is None and rows["my.Books"].exposed_entities is None
    held = {r.name: r for r in schema_json.build(shop, containment=True).collect()}
    assert held["AdminService"].exposed_entities == ["AdminService.Books", "AdminService.Shown"]


def test_service_records_win_and_need_a_definition(spark, shop):
    info = spark.createDataFrame([("AdminService", [("odata", "/other/")])], f"name string, endpoints {catalog.ENDPOINTS}")
    rows = {r.name: r for r in schema_json.build(shop, info).collect()}
    assert rows["AdminService.Books"].endpoints[0].path == "/other/Books"
    with pytest.raises(LookupError):
        schema_json.build(shop, spark.createDataFrame([("Nobody", None)], f"name string, endpoints {catalog.ENDPOINTS}"))


def test_elements_and_drafts(shop):
    got = {(r.elem_name, r.key) for r in schema_json.all_elements(shop).where("def_name = 'AdminService.Books'").collect()}
    assert {("ID", True), ("IsActiveEntity", True), ("HasActiveEntity", False), ("HasDraftEntity", False)} <= got


def test_order_over_documents_in_several_partitions(spark):
    documents = [{"definitions": {f"D{i}.x": {"kind": "entity"}, f"D{i}.y": {"kind": "entity"}}} for i in range(9)]
    rows = schema_json.definitions(text(spark, *documents).repartition(4)).collect()
    assert len({r.ord for r in rows}) == 18
    order = {r.name: r.ord for r in rows}
    assert all(order[f"D{i}.y"] == order[f"D{i}.x"] + 1 for i in range(9))


def test_orders_take_from_the_stock(spark, tmp_path):
    stock = spark.createDataFrame([(1, 10), (2, 0), (3, 5)], "id int, stock int")
    orders = spark.createDataFrame([(1, 4, 1, "a"), (1, 7, 2, "b"), (1, 0, 3, "c"), (2, 1, 4, "d"), (9, 1, 5, "e"), (3, 5, 6, "f")], "book int, quantity int, at int, buyer string")
    left, events = catalog.take_orders(stock, orders)
    assert {r.id: r.stock for r in left.collect()} == {1: 6, 2: 0, 3: 0}
    for _ in range(2):
        catalog.emit(events, str(tmp_path / "sink"))
    assert sorted((r.book, r.quantity, r.buyer) for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [(1, 4, "a")] * 2 + [(3, 5, "f")] * 2
    assert [tuple(r) for r in catalog.lookup(stock, "id", 3, ["stock"]).collect()] == [(3, 5)] and catalog.lookup(stock, "id", 7, ["stock"]).isEmpty()


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("d", None)], "path string, mtime int")
    assert {tuple(r) for r in catalog.changes(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert not catalog.changed(old, old) and catalog.changed(old.limit(0), old)


def test_files(spark, tmp_path):
    for p in ("a.cds", "x/b.cds", "node_modules/c.cds", "x/node_modules/d.cds", "e.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = schema_json.schema_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.cds", "b.cds"]


def test_vocabulary():
    assert schema_json.vocabulary('{"model": {"vocab": {"a": 1, "b": "2", "c": true, "d": 4}}}') == {"a": 1, "d": 4}
    with pytest.raises(ValueError):
        schema_json.vocabulary("{}")


def test_small_files(spark, tmp_path):
    lines = text(spark, "# note", "", "Books = Bücher", "a=b=c", "none")
    assert {tuple(r) for r in schema_json.properties(lines).collect()} == {("Books", "Bücher"), ("a", "b=c")}
    (tmp_path / "s.csv").write_text('ID,title\n1,"a ""b"", c"\n2,\n')
    seed = schema_json.read_seed(spark, str(tmp_path / "s.csv"), "ID int, title string")
    assert [tuple(r) for r in seed.orderBy("ID").collect()] == [(1, 'a "b", c'), (2, None)]
    texts = spark.createDataFrame([(1, "de", "eins"), (2, "fr", "deux")], "ID int, locale string, title string")
    assert {r.ID: r.title for r in schema_json.localised(seed, texts, "de", "ID", ["title"]).collect()} == {1: "eins", 2: None}
