import json
import time

import numpy as np
import pytest

from quern.sources import vecstore
from quern.streaming import refresh

META = json.dumps({"dim": 1, "count": 1, "chunks": ["a"]}).encode()
DATA = np.array([1], "<f4").tobytes()
ROW = "name string"


def fetcher(first, second=None, log=None):
    def fetch(name, etag):
        if log is not None:
            log.append((name, etag))
        r = first if name.endswith(".json") else second
        if isinstance(r, Exception):
            raise r
        return r

    return fetch


OK = refresh.Response(200, META, "v2"), refresh.Response(200, DATA)
FAILURES = {
    "json 500": (refresh.Response(500), None),
    "bin 404": (refresh.Response(200, META, "v2"), refresh.Response(404)),
    "bin not modified": (refresh.Response(200, META, "v2"), refresh.Response(304)),
    "network": (OSError("down"), None),
}


@pytest.mark.parametrize("case", FAILURES)
def test_failures(tmp_path, case):
    fetch, folder = fetcher(*FAILURES[case]), str(tmp_path)
    with pytest.raises(OSError):
        refresh.download("x", folder, fetch)
    refresh.download("x", folder, fetcher(refresh.Response(200, META, "v1"), refresh.Response(200, DATA)))
    assert refresh.download("x", folder, fetch) == refresh.Download("v1", False)
    assert not list(tmp_path.glob("*.tmp"))


def test_success_and_not_modified(tmp_path):
    folder, log = str(tmp_path), []
    assert refresh.download("x", folder, fetcher(refresh.Response(304))) == refresh.Download(None, False)
    assert refresh.download("x", folder, fetcher(*OK, log)) == refresh.Download("v2", True)
    assert vecstore.load("x", folder)[0] == ["a"] and refresh.stored_etag("x", folder) == "v2"
    assert log == [("x.json", None), ("x.bin", "v2")]
    assert refresh.download("x", folder, fetcher(refresh.Response(304))) == refresh.Download("v2", False)
    assert refresh.download("x", folder, fetcher(refresh.Response(200, b"new", "v2"))) == refresh.Download("v2", False)
    assert refresh.download("x", folder, fetcher(refresh.Response(200, META), refresh.Response(200, DATA))) == refresh.Download(None, True)
    assert refresh.stored_etag("x", folder) == "v2"


def test_retries():
    def broken():
        calls.append("read")
        raise vecstore.EmbeddingsCorrupted("x")

    for offline, want in ((False, ["read", "repair"] * 2 + ["read"]), (True, ["read"])):
        calls = []
        with pytest.raises(vecstore.EmbeddingsCorrupted):
            refresh.with_retry(broken, lambda: calls.append("repair"), offline=offline)
        assert calls == want


def test_interval():
    assert [refresh.interval_ms(*a) for a in ((100,), (5000,), (100, "20"), (100, "x"), (100, ""))] == [20_000, 50_000, 20, 20_000, 20_000]


@pytest.fixture
def state(spark):
    class State:
        files, names, fails, compiled = [("a", 1)], ["one"], False, 0

        def compile(self):
            self.compiled += 1
            if self.fails:
                raise ValueError("bad schema")
            return spark.createDataFrame([(n,) for n in self.names], ROW)

        def listed(self):
            return spark.createDataFrame(self.files, "path string, mtime int").selectExpr("path", "timestamp_seconds(mtime) AS mtime")

        def seen(self, c):
            return [r[0] for r in c.get().collect()]

    return State()


def test_last_good_catalog(spark, state):
    c = refresh.Catalog(spark, state.compile, state.listed)
    assert state.seen(c) == state.seen(c) == ["one"] and state.compiled == 1
    assert not c.look()
    state.files, state.names = [("a", 2)], ["two"]
    assert c.look() and state.seen(c) == ["two"]
    state.files, state.fails = [("a", 2), ("b", 1)], True
    assert not c.look() and state.seen(c) == ["two"]
    state.fails, state.names = False, ["three"]
    assert c.look() and state.seen(c) == ["three"]
    c.reset()
    assert state.seen(c) == ["three"] and state.compiled == 5


def test_first_failure_is_tried_again(spark, state):
    state.fails = True
    c = refresh.Catalog(spark, state.compile, state.listed)
    with pytest.raises(ValueError):
        c.get()
    state.fails = False
    assert state.seen(c) == ["one"]


def test_watch(spark, state):
    c = refresh.Catalog(spark, state.compile, state.listed, setting="20", view="watched")
    c.watch()
    state.names, state.files = ["new"], [("a", 3)]
    for _ in range(100):
        if [r[0] for r in spark.table("watched").collect()] == ["new"]:
            break
        time.sleep(0.1)
    c.stop()
    assert [r[0] for r in spark.table("watched").collect()] == ["new"]


def test_watch_as_a_stream(spark, tmp_path):
    ticks = []
    q = refresh.watch_stream(spark, lambda: ticks.append(1), "100 milliseconds", str(tmp_path / "c"))
    for _ in range(100):
        if ticks:
            break
        time.sleep(0.1)
    q.stop()
    assert ticks
