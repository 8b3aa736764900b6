import json

import numpy as np
import pytest

from quern.sources import vecstore


def write(folder, meta, floats, id="x"):
    (folder / f"{id}.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    (folder / f"{id}.bin").write_bytes(np.array(floats, "<f4").tobytes())
    (folder / f"{id}.etag").write_text("v1")


BAD = {
    "no json": ("invalid json content", [1, 2]),
    "no dim": ({"chunks": ["t"]}, [1]),
    "dim zero": ({"dim": 0, "chunks": ["t"]}, [1]),
    "chunks no list": ({"dim": 1, "chunks": "t"}, [1]),
    "short": ({"dim": 4, "count": 2, "chunks": ["a", "b"]}, [1, 2, 3]),
    "other count": ({"dim": 2, "count": 5, "chunks": ["a", "b"]}, [1, 2, 3, 4]),
    "nan": ({"dim": 2, "count": 1, "chunks": ["a"]}, [float("nan"), 2]),
    "infinity": ({"dim": 2, "count": 1, "chunks": ["a"]}, [float("inf"), 1]),
    "number for text": ({"dim": 2, "count": 1, "chunks": [123]}, [1, 2]),
}


@pytest.mark.parametrize("case", BAD)
def test_corrupted_pairs_are_removed(tmp_path, case):
    write(tmp_path, *BAD[case])
    with pytest.raises(vecstore.EmbeddingsCorrupted) as e:
        vecstore.load("x", str(tmp_path))
    assert e.value.code == "EMBEDDINGS_CORRUPTED" and not list(tmp_path.iterdir())


def test_missing_files_and_null_leave_all_in_place(tmp_path):
    with pytest.raises(FileNotFoundError):
        vecstore.load("x", str(tmp_path))
    write(tmp_path, "null", [1])
    with pytest.raises(TypeError):
        vecstore.load("x", str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 3


def test_valid_pair(spark, tmp_path):
    write(tmp_path, {"dim": 3, "count": 2, "chunks": ["Hello world", "Test content"]}, [1, 2, 3, 4, 5, 6])
    got = vecstore.chunks(spark, "x", str(tmp_path)).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "Hello world", [1.0, 2.0, 3.0]), (1, "Test content", [4.0, 5.0, 6.0])]
    write(tmp_path, {"dim": 3, "count": 0, "chunks": []}, [])
    assert vecstore.chunks(spark, "x", str(tmp_path)).count() == 0


def test_writer(spark, tmp_path):
    v = [np.array([1, 2], np.float32)]
    for texts, vectors in (([], v), (["a"], []), (["a", "b"], v), (["a"], [[1.0, 2.0]]), (["a"], [np.array([1.0])]), (["a", "b"], [*v, np.array([1], np.float32)])):
        with pytest.raises(ValueError):
            vecstore.write_pair("w", texts, vectors, str(tmp_path))
    d = spark.createDataFrame([(1, "b", [3.0, 4.0]), (0, "a", [1.0, 2.0])], vecstore.SCHEMA)
    vecstore.export_pair(d, "w", str(tmp_path))
    assert [tuple(r) for r in vecstore.chunks(spark, "w", str(tmp_path)).orderBy("ord").collect()] == [(0, "a", [1.0, 2.0]), (1, "b", [3.0, 4.0])]


def test_parquet_store_has_norms(spark, tmp_path):
    d = spark.createDataFrame([(0, "a", [3.0, 4.0])], vecstore.SCHEMA)
    vecstore.write_store(d, str(tmp_path / "s"))
    assert vecstore.read_store(spark, str(tmp_path / "s")).first().norm == 5.0
