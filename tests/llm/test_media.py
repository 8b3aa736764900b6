import random

import messy
import numpy as np
from pyspark.sql import functions as F

from quern.llm import media


def slow_gear(data):
    h, out = 0, []
    for x in data:
        h = (h * 2 + int(media.GEAR[x])) % 2**32
        out.append(h)
    return out


def slow_cuts(data, least=media.LEAST, most=media.MOST, level=media.LEVEL):
    out, at = [], 0
    for i, h in enumerate(slow_gear(data), 1):
        if i - at >= least and (h >> (32 - level) == 0 or i - at == most) and i < len(data):
            out.append(i)
            at = i
    return out + ([len(data)] if data else [])


def blobs():
    rng = random.Random(6)
    some = [rng.randbytes(n) for n in (0, 1, 100, 300, 5000, 60_000, 200_000)]
    return [*some, some[5], b"new head" + some[5][:40_000] + b"!" + some[5][40_000:], some[6][:100_000], b"\x00" * 30_000, some[4] * 3]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(map(bytearray, values))), "id long, payload binary")


def test_chunks_against_a_byte_by_byte_loop(spark):
    held = blobs()
    for x in held[:6]:
        assert media.gear(np.frombuffer(x, np.uint8)).tolist()[31:] == slow_gear(x)[31:]
    got = {r.id: np.cumsum(r.lengths).tolist() for r in media.chunk_lists(frame(spark, held)).collect()}
    assert got == {i: slow_cuts(x) for i, x in enumerate(held)}


def test_round_trip_both_ways(spark):
    held = blobs()
    seen, want = set(), {}
    for i, x in enumerate(held):
        new, at = [], 0
        for z in slow_cuts(x):
            if x[at:z] not in seen:
                new.append(z - at)
            seen.add(x[at:z])
            at = z
        want[i] = (len(slow_cuts(x)), len(new), sum(new))
    for most in (1_000_000, 0):
        rows = media.reconstruct(frame(spark, held), broadcast_chunks=most).collect()
        assert all(r.verified for r in rows) and {r.id: bytes(r.payload) for r in rows} == dict(enumerate(held))
        assert {r.id: (r.n_chunks, r.n_new, r.new_bytes) for r in rows} == want
    assert want[7][1] == 0 and want[8][2] < 0.7 * len(held[8])


def test_query(spark, sf):
    pages = {r.page_id: len((r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = media.op2(spark, sf).collect()
    assert {r.page_id: r.size for r in rows} == pages and all(r.verified for r in rows)


def test_messy(spark):
    d = messy.docs(spark)
    m = media.payloads(d.withColumn("id", F.lit("own")), "doc_id", "text")
    rows = {r.id: r for r in media.reconstruct(m).collect()}
    assert sorted(rows) == [1, 2, 4, 5, 6, 7, 8, 9] and all(r.verified for r in rows.values())
    assert rows[4].n_chunks == 0 and rows[2].n_new == 0 and bytes(rows[9].payload) == b"drei"
    assert media.reconstruct(media.payloads(d.limit(0), "doc_id", "text")).count() == 0


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("p/2", "the same " * 200), ("p/1", "the same " * 200), (None, "x")], "page string, html string")
    rows = {r.id: r for r in media.reconstruct(media.payloads(d, "page", "html")).collect()}
    assert sorted(rows) == ["p/1", "p/2"] and all(r.verified for r in rows.values()) and (rows["p/1"].new_bytes, rows["p/2"].new_bytes) == (1800, 0)
