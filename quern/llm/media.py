"""Content-defined chunks of media payloads, each distinct chunk stored once.

Payloads are cut where the low history of a rolling gear hash, the sum of the last 32 bytes' table
values shifted by their age, has LEVEL zero bits, at least LEAST and at most MOST bytes apart. A
cut depends on the 32 bytes before it alone, so equal stretches give equal chunks wherever they
stand. Chunk digests (128 bits) are grouped over all payloads: a chunk belongs to the first
payload, by id and place, that holds it. The ordered chunk list of a payload names digests;
reconstruct() joins the stored chunks back in that order and checks length and SHA-256.

Chunks that no other payload uses never leave their owner's row. Only shared ones travel by
digest, once each to the join and once to every list that borrows them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._bytes import mix, pieces, trimmed
from quern.llm._io import as_id, cut, numbered, table, whole

LEAST, MOST, LEVEL = 256, 8192, 9
#: Shared chunks up to which every task gets their digests (32 bytes each); beyond, they are joined.
BROADCAST_CHUNKS = 1_000_000
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
LISTS = "id long, size long, sha binary, digests array<binary>, lengths array<int>"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling windows of 1, 2, 4, 8 and 16 bytes."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)  # the right side is worked out before h changes
    return h


def cuts(size: int, marks: list[int], least: int, most: int) -> list[int]:
    """Ends of the chunks of size bytes; marks: sorted ends at which the hash would cut."""
    out, at = [], 0
    while size - at > least:
        k = bisect_left(marks, at + least)
        at = min(marks[k] if k < len(marks) else size, at + most, size)
        out.append(at)
    if at < size:
        out.append(size)
    return out


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _chunks(col: pa.Array, least: int, most: int, level: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """(row, payload, ends of its chunks) of a column."""
    for lo, hi, data, at in pieces(col):
        marks = np.flatnonzero(gear(data) >> np.uint32(32 - level) == 0) + 1
        where = np.searchsorted(marks, at)
        held = data.tobytes()
        for k in range(hi - lo):
            a, z = int(at[k]), int(at[k + 1])
            yield lo + k, held[a:z], cuts(z - a, (marks[where[k] : where[k + 1]] - a).tolist(), least, most)


def _lister(least: int, most: int, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, digests, lengths = [], [], [], []
            for _, x, ends in _chunks(b.column("payload"), least, most, level):
                starts = [0, *ends[:-1]]
                size.append(len(x))
                sha.append(hashlib.sha256(x).digest())
                digests.append([_digest(x[a:z]) for a, z in zip(starts, ends)])
                lengths.append([z - a for a, z in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], names=["id", "size", "sha", "digests", "lengths"])

    return trimmed(run)


def payloads(media: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, payload) with bytes for text; null payloads and null ids go, rows that share an id are one, with the least payload."""
    slim = media.select(as_id(media, id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload")).where("id is not null and payload is not null")
    repeated = not slim.groupBy("id").count().where("count > 1").isEmpty()
    return slim.groupBy("id").agg(F.min("payload").alias("payload")) if repeated else slim


def chunk_lists(media: DataFrame, least: int = LEAST, most: int = MOST, level: int = LEVEL) -> DataFrame:
    """The ordered chunk list of each payload: id, size, sha, digests, lengths. Written in the shared folder."""
    return cut(media.mapInArrow(_lister(least, most, level), LISTS))


def references(lists: DataFrame) -> DataFrame:
    """(digest, id, seq, length, owner, owner_seq, uses) of each chunk in each list; the owner is its first holder."""
    flat = lists.select("id", F.posexplode(F.arrays_zip("digests", "lengths")).alias("seq", "c")).select(F.col("c.digests").alias("digest"), "id", "seq", F.col("c.lengths").alias("length"))
    first = flat.groupBy("digest").agg(F.min(F.struct("id", "seq")).alias("first"), F.count("*").alias("uses")).select("digest", F.col("first.id").alias("owner"), F.col("first.seq").alias("owner_seq"), "uses")
    return flat.join(first, "digest")


def _roles(held: object | None) -> Callable[[int, list[bytes]], list[int]]:
    """0: used by nobody else, 1: shared and owned, 2: borrowed, from the broadcast table of shared chunks."""
    head, tail, owner, seq = held.value

    def role(i: int, digests: list[bytes]) -> list[int]:
        d = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
        if not len(head) or not len(d):
            return [0] * len(d)
        k = np.minimum(np.searchsorted(head, d[:, 0]), len(head) - 1)
        hit = (head[k] == d[:, 0]) & (tail[k] == d[:, 1])
        own = (owner[k] == i) & (seq[k] == np.arange(len(d)))
        return np.where(hit, np.where(own, 1, 2), 0).tolist()

    return role


def _dealer(held: object | None, shared: bool, least: int, most: int, level: int) -> Callable:
    """Owned chunks in one run a payload, or the shared ones of them by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role = _roles(held) if held else None
        for b in batches:
            ids, out, room = [], [], 0
            flags = b.column("roles") if not held else None
            for row, x, ends in _chunks(b.column("payload"), least, most, level):
                parts = [x[a:z] for a, z in zip([0, *ends[:-1]], ends)]
                i = b.column("id")[row].as_py()
                digests = [_digest(p) for p in parts]
                kinds = role(i, digests) if role else list(flags[row].as_py() or b"")
                if shared:
                    new = [(d, p) for d, p, k in zip(digests, parts, kinds) if k == 1]
                    ids += [d for d, _ in new]
                    out += [p for _, p in new]
                else:
                    ids.append(i)
                    out.append(pa.compress(b"".join(p for p, k in zip(parts, kinds) if k < 2), "zstd", asbytes=True))
                room += len(x)
                if room > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary() if shared else pa.int64()), pa.array(out, pa.binary())], names=["key", "payload"])
                    ids, out, room = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary() if shared else pa.int64()), pa.array(out, pa.binary())], names=["key", "payload"])

    return trimmed(run)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = ["id", "size", "n_chunks", "n_new", "new_bytes", "payload", "verified"]
        rows = []
        for r in b.to_pylist():
            lent = {x["seq"]: x["payload"] for x in r["lent"] or []}
            own = sum(n for n, k in zip(r["lengths"], r["roles"] or b"") if k < 2)
            run = pa.decompress(r["own"], own, "zstd", asbytes=True) if own else b""
            parts, at = [], 0
            for seq, (n, k) in enumerate(zip(r["lengths"], r["roles"] or b"")):
                if k < 2:
                    parts.append(run[at : at + n])
                    at += n
                else:
                    parts.append(lent.get(seq, b""))
            x = b"".join(parts)
            rows.append((r["id"], r["size"], len(parts), sum(k < 2 for k in r["roles"] or b""), own, x, len(x) == r["size"] and hashlib.sha256(x).digest() == r["sha"]))
        c = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()])], names=names)


def reconstruct(media: DataFrame, least: int = LEAST, most: int = MOST, level: int = LEVEL, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """media, (id, payload), cut, deduplicated and put together again: id, size, n_chunks, n_new and
    new_bytes (the chunks it is the first to hold), payload, verified.

    An empty payload has no chunks and verifies; equal payloads belong to the least id. Null
    payloads and ids are to be removed before, as payloads() does. An empty table gives no rows. Ids
    may have any type that can be ordered.
    """
    if not whole(media, "id"):
        return numbered(media, lambda m: reconstruct(m, least, most, level, broadcast_chunks), ("id",), "id")
    lists = chunk_lists(media, least, most, level)
    refs = references(lists)
    kind = F.when(F.col("uses") == 1, 0).when((F.col("id") == F.col("owner")) & (F.col("seq") == F.col("owner_seq")), 1).otherwise(2)
    refs = cut(refs.withColumn("role", kind))
    roles = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("r")).select("id", F.unhex(F.array_join(F.transform("r", lambda x: F.format_string("%02x", x["role"])), "")).alias("roles"))
    shared = refs.where("role = 1").select("digest", "owner", "owner_seq")
    if shared.count() <= broadcast_chunks:
        t = shared.toArrow()
        d = np.frombuffer(b"".join(t["digest"].to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        o = np.lexsort((d[:, 1], d[:, 0]))
        held = media.sparkSession.sparkContext.broadcast((d[o, 0], d[o, 1], t["owner"].to_numpy()[o], t["owner_seq"].to_numpy()[o]))
        dealt = media
    else:
        held, dealt = None, media.join(roles, "id", "left")
    own = dealt.mapInArrow(_dealer(held, False, least, most, level), "key long, payload binary").withColumnsRenamed({"key": "id", "payload": "own"})
    lent = dealt.mapInArrow(_dealer(held, True, least, most, level), "key binary, payload binary").withColumnRenamed("key", "digest")
    borrowed = refs.where("role = 2").select("digest", "id", "seq").join(lent, "digest").groupBy("id").agg(F.collect_list(F.struct("seq", "payload")).alias("lent"))
    joined = lists.select("id", "size", "sha", "lengths").join(own, "id").join(roles, "id", "left").join(borrowed, "id", "left")
    return joined.select("id", "size", "sha", "lengths", "own", "roles", "lent").mapInArrow(_assemble, "id long, size long, n_chunks int, n_new int, new_bytes long, payload binary, verified boolean")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' HTML as media: sizes, new chunks and whether the payload came back whole."""
    found = reconstruct(payloads(table(spark, sf_dir, "pages"), "page_id", "html"))
    return found.select(F.col("id").alias("page_id"), "size", "n_chunks", "n_new", "new_bytes", "verified")
