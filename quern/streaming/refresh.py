"""State that follows its sources: conditional download, change detection, last good catalog."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import catalog
from quern.sources import vecstore

V = TypeVar("V")


@dataclass
class Response:
    status: int
    body: bytes = b""
    etag: str | None = None

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 300


class Fetcher(Protocol):
    """What brings a file; there is no network in the engine itself."""

    def __call__(self, name: str, etag: str | None) -> Response: ...


@dataclass
class Download:
    etag: str | None
    updated: bool


def stored_etag(id: str, folder: str) -> str | None:
    try:
        with open(vecstore.paths(id, folder)[2], encoding="utf-8") as f:
            return f.read()
    except OSError:
        return None


def pair_exists(id: str, folder: str) -> bool:
    return all(os.path.exists(p) for p in vecstore.paths(id, folder)[:2])


def download(id: str, folder: str, fetch: Fetcher) -> Download:
    """Brings a pair up to date. Not modified, or an etag already stored, changes nothing; whatever
    goes wrong changes nothing if both files are there and is raised otherwise. Both files are
    written beside the old ones and then put in their place, the etag last."""
    meta, data, tag = vecstore.paths(id, folder)
    etag = stored_etag(id, folder)
    old = Download(etag, False)
    temporary = (f"{meta}.tmp", f"{data}.tmp")
    try:
        first = fetch(f"{id}.json", etag)
        if first.status == 304:
            return old
        if not first.ok:
            raise OSError(f"{id}.json: status {first.status}")
        if first.etag is not None and etag is not None and first.etag == etag.strip():
            return old
        second = fetch(f"{id}.bin", first.etag)
        if not second.ok:
            raise OSError(f"{id}.bin: status {second.status}")
        os.makedirs(folder, exist_ok=True)
        for p, r in zip(temporary, (first, second)):
            with open(p, "wb") as f:
                f.write(r.body)
        os.replace(temporary[0], meta)
        os.replace(temporary[1], data)
        if first.etag is not None:
            with open(tag, "w", encoding="utf-8") as f:
                f.write(first.etag)
        return Download(first.etag, True)
    except Exception:
        for p in temporary:
            if os.path.exists(p):
                os.remove(p)
        if pair_exists(id, folder):
            return old
        raise


def with_retry(read: Callable[[], V], repair: Callable[[], object], retries: int = 2, offline: bool = False) -> V:
    """read(), and after a corrupted store repair() and read() again, at most so many times.
    Offline, and with any other error, the first failure is final."""
    for k in range(retries + 1):
        try:
            return read()
        except vecstore.EmbeddingsCorrupted:
            if offline or k == retries:
                raise
            repair()
    raise AssertionError


def interval_ms(compile_ms: float, setting: str | None = None) -> int:
    """Milliseconds between two looks: a given number, else ten times what compiling took, 20 s at least."""
    try:
        return int(setting) if setting else max(int(10 * compile_ms), 20_000)
    except ValueError:
        return max(int(10 * compile_ms), 20_000)


@dataclass
class Catalog:
    """A compiled catalog that is kept until its files change. Calls at the same time compile once;
    a failed first compilation is tried again by the next call, a failed later one leaves the last
    good catalog in place and is tried again at the next look."""

    spark: SparkSession
    compile: Callable[[], DataFrame]
    files: Callable[[], DataFrame]
    setting: str | None = None
    view: str | None = None
    compile_ms: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _now: DataFrame | None = None
    _seen: DataFrame | None = None
    _stop: threading.Event = field(default_factory=threading.Event)

    def get(self) -> DataFrame:
        with self._lock:
            if self._now is None:
                self._swap(self._snapshot())
            return self._now

    def _snapshot(self) -> DataFrame:
        return self.spark.createDataFrame(self.files().collect(), "path string, mtime timestamp")

    def _swap(self, seen: DataFrame) -> None:
        began = time.monotonic()
        new = self.compile().cache()
        new.count()
        self.compile_ms = (time.monotonic() - began) * 1000
        old, self._now, self._seen = self._now, new, seen
        if self.view:
            new.createOrReplaceTempView(self.view)
        if old is not None:
            old.unpersist()

    def look(self) -> bool:
        """Compiles again if a file came, went or changed; whether there is a new catalog."""
        with self._lock:
            seen = self._snapshot()
            if self._seen is not None and not catalog.changed(self._seen, seen):
                return False
            try:
                self._swap(seen)
                return True
            except Exception:
                if self._now is None:
                    raise
                return False

    def reset(self) -> None:
        with self._lock:
            if self._now is not None:
                self._now.unpersist()
            self._now = self._seen = None

    def watch(self) -> threading.Thread:
        """Looks from time to time in a thread that doesn't keep the process alive."""

        def run() -> None:
            while not self._stop.wait(interval_ms(self.compile_ms, self.setting) / 1000):
                try:
                    self.look()
                except Exception:
                    continue

        self.get()
        t = threading.Thread(target=run, daemon=True)
        t.start()
        return t

    def stop(self) -> None:
        self._stop.set()


def watch_stream(spark: SparkSession, each: Callable[[], object], every: str, checkpoint: str) -> object:
    """A streaming query that calls each() once an interval, for drivers that watch their queries."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(1).alias("tick"))
    return ticks.writeStream.foreachBatch(lambda df, n: each()).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
