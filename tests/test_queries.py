import os
import subprocess
import sys

import pytest
from compare import assert_same

from quern.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)


def test_vecstore_roundtrip_gives_the_embeddings(spark, sf):
    got = {r.ord: (r.n, r.first, r.last) for r in queries.QUERIES["vecstore_roundtrip"](spark, sf).collect()}
    assert got == {r.vec_id: (len(r.embedding), r.embedding[0], r.embedding[-1]) for r in queries.table(spark, sf, "embeddings").collect()}


def test_embed_hash_gives_unit_vectors(spark, sf):
    rows = queries.QUERIES["embed_hash"](spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "benchmark").count()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-3 for r in rows)


def test_schema_ingest_counts_nations(spark, sf):
    rows = queries.QUERIES["schema_ingest"](spark, sf).collect()
    assert sum(r.n_exposed for r in rows if r.kind == "service") == 25 == sum(r.kind == "entity" for r in rows)
    assert all(r.path.endswith("/" + r.name.split(".")[1]) for r in rows if r.kind == "entity")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["vec_id", "text", "similarity"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_package(tmp_path):
    """Both folders and corpus_pipeline.py may be removed; any other missing module is an error."""
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in ("quern.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert e.queries() and not [q for q in e.queries() if q.startswith("op")], e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "quern")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, f)) as text:
                    assert "quern.llm" not in text.read(), f
