"""Jaccard join of token n-gram sets, filtered under several global token orders.

Under any one order of all n-grams, two sets of Jaccard similarity t or more share an n-gram
among the first |x| - ceil(t|x|) + 1 of each: their prefixes. A pair has to share one in its
prefixes under three orders before it is verified:

- rarest first: by the number of different sets that have the n-gram, then by its hash. This
  order's prefixes are the join keys. An n-gram that one set alone has is in no join, so a text
  without near duplicates has few keys or none, and what thousands of texts share comes last.
- by a permutation of the hashes, and by the same permutation backwards: heads and tails of the
  sorted sets that are compared; the filters are intersected there, before the whole sets are.

Prefixes are whole, so no pair is missed whatever its sizes. Counting sets by n-gram takes a
shuffle of the n-grams, packed in rows of many, and one back of those that two sets share. Very
frequent n-grams (by a table of 2**SKETCH counts over all documents) don't travel: they come last
in the order, and only a text that has hardly any others takes them as keys.

Groups are connected components. Each key's documents are first compared with the least of them;
only those that no verified pair has connected by then are compared with each other, so a group
of many copies costs as many comparisons as it has members while no candidate is dropped. All
links inside a group come from products of its sets' incidence matrices, in blocks of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._bytes import Powers, U, grams, hashes, mix, pieces, spans, trimmed
from quern.llm._graph import components
from quern.llm._io import broadcast_if_small, cut, fresh, id_and_text, numbered, repeats_ids, table, without

N = 3
THRESHOLD = 0.6
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
SALT = 0xA0761D6478BD642F
#: N-grams that a task counts, and n-grams that a task holds before it sends them on.
LOAD = 1 << 20
HELD = 1 << 18
SKETCH = 18
#: An n-gram comes last if the counts of its place in the table are more than so many times the mean and this number.
FREQUENT, FREQUENT_LEAST = 2, 1000
#: Documents of a group that are compared with so many others at once.
BLOCK = 1024
PACKED = "kind int, part int, docs binary, sizes binary, rooms binary, counts binary, grams binary, uses binary"
NAMES = ["kind", "part", "docs", "sizes", "rooms", "counts", "grams", "uses"]


def prefix(size: np.ndarray | int, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * np.asarray(size) - 1e-9).astype(np.int64) + 1


def _sets(col: pa.Array, n: int, powers: Powers) -> Iterator[np.ndarray]:
    for _, _, data, at in pieces(col, PIECE):
        s, e, first = spans(data, at, signs=True)
        g, before = grams(hashes(data, s, e, powers), first, n)
        for lo, hi in zip(before[:-1], before[1:]):
            yield np.unique(g[lo:hi])


def _signer(n: int) -> Callable:
    """Size and digest of each set; at the end of a task its counts of n-grams by place in the table, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), np.zeros(1 << SKETCH, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["doc_id", "size", "h1", "h2", "slice", "counts"]
        for b in batches:
            size, h1, h2, held, room = [], [], [], [], 0
            for g in _sets(b.column("text"), n, powers):
                m = mix(g)
                size.append(len(g))
                h1.append(int(np.add.reduce(m).astype(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(m)).astype(np.int64)) if len(g) else 0)
                held.append(g)
                room += len(g)
                if room > HELD:
                    table += np.bincount((np.concatenate(held) >> U(64 - SKETCH)).astype(np.int64), minlength=len(table))
                    held, room = [], 0
            if held:
                table += np.bincount((np.concatenate(held) >> U(64 - SKETCH)).astype(np.int64), minlength=len(table))
            none = pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip((size, h1, h2), kinds[1:])), *none], names=names)
        if table.any():
            own = table.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(64, t) for t in kinds[:4]), pa.array(np.arange(64, dtype=np.int32)), pa.array([x.tobytes() for x in own], pa.binary())], names=names)

    return trimmed(run)


@trimmed
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("slice").to_pylist(), b.column("counts")):
            total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def _packed(kind: int, part: np.ndarray, doc: np.ndarray, size: np.ndarray, room: np.ndarray, gram: np.ndarray, uses: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each part, from arrays sorted by part and then by document."""
    new = np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])] if len(part) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    counts = np.diff(np.r_[run, len(part)]).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, np.diff(part[run]) != 0]) if len(run) else run
    ends = np.r_[cuts[1:], len(run)]
    grams_at = np.r_[run, len(part)]

    def rows(x: np.ndarray) -> pa.Array:
        return pa.array([x[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary())

    def all_rows(x: np.ndarray) -> pa.Array:
        return pa.array([x[grams_at[a] : grams_at[z]].tobytes() for a, z in zip(cuts, ends)], pa.binary())

    more = all_rows(uses) if uses is not None else pa.nulls(len(cuts), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), kind, np.int32)), pa.array(part[run][cuts].astype(np.int32)), rows(doc[run]), rows(size[run].astype(np.int32)), rows(room[run].astype(np.int32)), rows(counts), all_rows(gram), more], names=NAMES)


def _unpacked(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """doc, size, room, gram and uses of each n-gram."""

    def read(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(name) if x.is_valid)])

    counts = read("counts", np.int32)
    doc, size, room = (np.repeat(read(n, k), counts) for n, k in (("docs", np.int64), ("sizes", np.int32), ("rooms", np.int32)))
    return doc, size, room, read("grams", U), read("uses", np.int32)


def _scatterer(n: int, threshold: float, parts: int, counts: object, most: float) -> Callable:
    """The n-grams of each set, by part. Frequent ones stay behind; kind 1 has those that are keys all the same."""

    def send(docs: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        size = np.array([len(g) for g in sets])
        doc, g, of = np.repeat(np.array(docs, np.int64), size), np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        often = table[(g >> U(64 - SKETCH)).astype(np.int64)]
        late = often > most
        light = size - np.bincount(of[late], minlength=len(sets))
        room = prefix(size, threshold) - light
        keep = np.flatnonzero(~late)
        part = (mix(g[keep]) % U(parts)).astype(np.int64)
        o = keep[np.argsort(part, kind="stable")]
        yield _packed(0, np.sort(part, kind="stable"), doc[o], size[of[o]], room[of[o]], g[o])
        if (room > 0).any():
            late = np.flatnonzero(late & (room[of] > 0))
            late = late[np.lexsort((mix(g[late]), often[late], of[late]))]
            own = of[late]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            late = late[place < room[own]]
            part = np.full(len(late), int(doc[late[0]] % parts) if len(late) else 0, np.int64)
            yield _packed(1, part, doc[late], size[of[late]], room[of[late]], g[late])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, docs, sets, held = Powers(), [], [], 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, g in zip(ids, _sets(b.column("text"), n, powers)):
                if len(g):
                    docs.append(i)
                    sets.append(g)
                    held += len(g)
                if held > HELD:
                    yield from send(docs, sets)
                    docs, sets, held = [], [], 0
        if sets:
            yield from send(docs, sets)

    return trimmed(run)


def _by_kind(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    own = []
    for b in batches:
        kind = b.column("kind").to_numpy()
        own.append(b.filter(pa.array(kind == 0)))
        if kind.any():
            passed.append(b.filter(pa.array(kind == 1)))
    return own


def _frequencies(parts: int) -> Callable:
    """Counts the sets of each n-gram of a part and sends those of two or more back to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        doc, size, room, g, _ = _unpacked(_by_kind(batches, passed))
        yield from passed
        o = np.argsort(g, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(g[o]) != 0]) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(g)])
        uses = np.repeat(n, n)
        o, uses = o[uses > 1], uses[uses > 1].astype(np.int32)
        part = (mix(doc[o].view(U) ^ U(SALT)) % U(parts)).astype(np.int64)
        order = np.lexsort((doc[o], part))
        o, uses, part = o[order], uses[order], part[order]
        # Rows of bounded size whatever a part holds.
        for lo in range(0, len(o), HELD):
            p = o[lo : lo + HELD]
            yield _packed(0, part[lo : lo + HELD], doc[p], size[p], room[p], g[p], uses[lo : lo + HELD])

    return trimmed(run)


@trimmed
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, size) of the rarest n-grams of each document, as far as its prefix goes."""
    passed: list[pa.RecordBatch] = []
    doc, size, room, g, uses = _unpacked(_by_kind(batches, passed))
    o = np.lexsort((mix(g), uses, doc))
    doc, size, room, g = doc[o], size[o], room[o], g[o]
    begin = np.searchsorted(doc, doc)
    n = np.searchsorted(doc, doc, side="right") - begin
    # room: the prefix less all its n-grams that travelled; those that one set alone has come before.
    keep = np.arange(len(doc)) - begin < room + n
    found = [(g[keep], doc[keep], size[keep])]
    if passed:
        doc, size, _, g, _ = _unpacked(passed)
        found.append((g, doc, size))
    for g, doc, size in found:
        for lo in range(0, len(g), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 17)]) for x in (g.view(np.int64), doc, size)], names=["key", "doc_id", "size"])


def _packer(n: int, names: list[str]) -> Callable:
    """The set of each text as sorted 64-bit numbers, with other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            held, start, room = [], 0, 0

            def rows(stop: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(b.column(c)[start:stop] for c in names), pa.array(held, pa.binary())], names=[*names, "grams"])

            for k, g in enumerate(_sets(b.column("text"), n, powers)):
                held.append(np.sort(mix(g ^ U(SALT))).tobytes())
                room += len(held[-1])
                if room > 1 << 21:
                    yield rows(k + 1)
                    held, start, room = [], k + 1, 0
            if held:
                yield rows(b.num_rows)

    return trimmed(run)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(x) else 0


def _measurer(threshold: float) -> Callable:
    """Jaccard similarity of the pairs that share an n-gram in both heads and in both tails; 0 of others."""

    def jaccard(x: np.ndarray, y: np.ndarray) -> float:
        p, q = int(prefix(len(x), threshold)), int(prefix(len(y), threshold))
        if not _shared(x[:p], y[:q]) or not _shared(x[-p:], y[-q:]):
            return 0.0
        shared = _shared(x, y)
        return shared / (len(x) + len(y) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [jaccard(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    return trimmed(run)


def _products(threshold: float) -> Callable:
    """(a, b, jaccard) of all links in each run of rows of one (root, i, j): inside a block, or between two."""

    def links(docs: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in sets], np.float64)
        every = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        o = np.argsort(every, kind="stable")
        new = np.r_[True, np.diff(every[o]) != 0]
        n = np.diff(np.r_[np.flatnonzero(new), len(o)])
        column, some = np.cumsum(new) - 1, np.repeat(n, n) > 1
        row, column = row[o][some], column[some]
        column = np.cumsum(np.r_[True, np.diff(column) != 0]) - 1 if len(column) else column
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, z = np.searchsorted(column, (lo, lo + 2048))
            held = np.zeros((len(sets), int(column[z - 1]) - lo + 1), np.float32)
            held[row[a:z], column[a:z] - lo] = 1
            shared += held @ held.T
        ids, side = np.array(docs, np.int64), np.array(sides)
        at = np.arange(len(sets))
        for lo in range(0, len(sets), 256):
            s = shared[lo : lo + 256].astype(np.float64)
            j = s / (size[lo : lo + 256, None] + size - s)
            wanted = (j >= threshold - 1e-12) & (ids[lo : lo + 256, None] > ids)
            if side.any():
                wanted &= side[lo : lo + 256, None] != side
            p, q = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + p]), pa.array(ids[at[q]]), pa.array(j[p, q])], names=["a", "b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sides, sets = None, [], [], []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "doc_id", "side", "grams"))):
                if r[:3] != now:
                    if len(docs) > 1:
                        yield from links(docs, sides, sets)
                    now, docs, sides, sets = r[:3], [], [], []
                docs.append(r[3])
                sides.append(r[4])
                sets.append(np.frombuffer(r[5], U))
        if len(docs) > 1:
            yield from links(docs, sides, sets)

    return trimmed(run)


class Join:
    """The join's steps over docs, whose ids are whole numbers."""

    def __init__(self, docs: DataFrame, n: int, threshold: float) -> None:
        self.slim, self.n, self.threshold = id_and_text(docs, F.lower("text"), nulls_last=True), n, threshold
        signed = cut(self.slim.mapInArrow(_signer(n), "doc_id long, size int, h1 long, h2 long, slice int, counts binary"))
        some = signed.where("doc_id is not null and size > 0").drop("slice", "counts")
        same = some.groupBy("size", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
        # A row a document with any token: doc_id, size and rep, the least doc_id with the same set.
        self.members = cut(some.join(broadcast_if_small(same), ["size", "h1", "h2"], "left").select("doc_id", "size", F.coalesce("rep", "doc_id").alias("rep")))
        self.sketch = signed.where("slice is not null").select("slice", "counts")
        self.reps = self.members.where("doc_id = rep").select("doc_id", "size")

    def keys(self) -> DataFrame:
        """(key, doc_id, size): the prefixes of all different sets, but for n-grams that one set alone has."""
        spark, (total,) = self.slim.sparkSession, self.reps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
        parts = max(1, -(-total // LOAD))
        counts = np.zeros((64, 1 << SKETCH >> 6), np.int64)
        for r in self.sketch.repartition(8, "slice").mapInArrow(_add_up, "slice int, counts binary").collect():
            counts[r.slice] = np.frombuffer(r.counts, np.int64)
        most = max(FREQUENT_LEAST, FREQUENT * counts.mean())
        copies = cut(self.members.where("doc_id <> rep").select("doc_id"))
        sent = without(self.slim, copies).mapInArrow(_scatterer(self.n, self.threshold, parts, spark.sparkContext.broadcast(counts.ravel()), float(most)), PACKED)
        counted = sent.repartitionById(parts, "part").mapInArrow(_frequencies(parts), PACKED)
        return cut(counted.repartitionById(parts, "part").mapInArrow(_keys, "key long, doc_id long, size int"))

    def alike(self, a: str, b: str) -> object:
        return F.least(a, b) >= F.greatest(a, b) * F.lit(self.threshold) - 1e-9

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, jaccard) of the candidate pairs at the threshold or above."""
        pairs = cut(pairs)
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sets = self.slim.join(broadcast_if_small(wanted), "doc_id", "left_semi").mapInArrow(_packer(self.n, ["doc_id"]), "doc_id long, grams binary")
        both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
        return cut(both.select("a", "b", "x", "y").mapInArrow(_measurer(self.threshold), "a long, b long, jaccard double").where(F.col("jaccard") >= self.threshold - 1e-12))

    def roots(self) -> DataFrame:
        """(node, root) of the different sets that have a partner."""
        keyed = self.keys()
        hub = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "size")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.doc_id").alias("b"), F.col("h.size").alias("hub_size"))
        keyed = cut(keyed.join(hub, "key"))
        tried = cut(keyed.where((F.col("doc_id") > F.col("b")) & self.alike("size", "hub_size")).select(F.col("doc_id").alias("a"), "b").distinct())
        found = self.verified(tried)
        root = components(found)
        named = keyed.select("key", "doc_id", "size").join(broadcast_if_small(root.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        open_keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        left = cut(named.join(open_keys, "key", "left_semi"))
        p, q = (left.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "size", "root"))) for x in "pq")
        more = p.join(q, "key").where((F.col("doc_id_p") > F.col("doc_id_q")) & (F.col("root_p") != F.col("root_q")) & self.alike("size_p", "size_q"))
        more = more.select(F.col("doc_id_p").alias("a"), F.col("doc_id_q").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        return components(found.select("a", "b").union(self.verified(more).select("a", "b")))

    def links(self, root: DataFrame) -> DataFrame:
        """(a, b, jaccard) of all pairs of different sets at the threshold or above."""
        sizes = root.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
        placed = cut(root.join(broadcast_if_small(cut(sizes)), "root").select(F.col("node").alias("doc_id"), "root", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.col("blocks").cast("int").alias("blocks")))
        tasks = max(1, -(-placed.count() // (4 * BLOCK)))
        sets = self.slim.join(broadcast_if_small(placed), "doc_id").mapInArrow(_packer(self.n, ["doc_id", "root", "block", "blocks"]), "doc_id long, root long, block int, blocks int, grams binary")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        spread = sets.select("*", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", F.when(F.col("block") == F.col("other"), 0).otherwise(F.when(F.col("block") < F.col("other"), 1).otherwise(2)).alias("side"), "grams")
        return cut(spread.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_products(self.threshold), "a long, b long, jaccard double"))

    def copies(self) -> DataFrame:
        return self.members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair (a, b) of documents with a > b and Jaccard similarity of the threshold or above.

    Documents with the same set are joined through one representative and expanded at the end, so
    the result alone is quadratic in a group. Documents that are null, empty or without tokens are
    in no pair; curly quotes, dashes and the like are no parts of tokens; repeated rows of one doc_id are one document; other columns don't matter. Ids may
    have any type that can be ordered.
    """

    def run(docs: DataFrame) -> DataFrame:
        join = Join(docs, n, threshold)
        found, member = join.links(join.roots()), join.members.select("doc_id", "rep")
        across = found.join(member.toDF("x", "a"), "a").join(member.toDF("y", "b"), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "jaccard")
        inside = member.alias("p").join(member.alias("q"), F.expr("p.rep = q.rep and p.doc_id > q.doc_id")).select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
        return across.union(inside)

    return numbered(docs, run, "ab")


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """As jaccard_pairs, but documents with the same set have a pair each with the least of them
    alone, at 1.0, and only that one is in pairs with other sets: all pairs follow from these."""

    def run(docs: DataFrame) -> DataFrame:
        join = Join(docs, n, threshold)
        return join.links(join.roots()).union(join.copies().withColumn("jaccard", F.lit(1.0)))

    return numbered(docs, run, "ab")


def jaccard_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, links: bool = True) -> DataFrame:
    """(doc_id, group_id, group_size, n_links) of each document with a partner: the connected
    components of the pairs at the threshold or above; group_id is the least doc_id in it. n_links
    is the number of other sets, whatever documents have them, that the document's set is linked to;
    documents with the same set don't count there. links: False leaves it out.

    Null, empty and token-less texts have no partner and no row; nor do rows with a null doc_id.
    Repeated rows of one doc_id are one document. An empty table gives no rows. Ids may have any
    type that can be ordered.
    """

    def run(docs: DataFrame) -> DataFrame:
        join = Join(docs, n, threshold)
        root = cut(join.roots())
        repeated = join.copies().select(F.col("b").alias("node")).distinct()
        named = root.join(repeated, "node", "full").select("node", F.coalesce("root", "node").alias("group_id"))
        rows = join.members.join(named, F.col("rep") == F.col("node")).select("doc_id", "rep", "group_id")
        sizes = rows.groupBy("group_id").agg(F.count("*").alias("group_size"))
        rows = rows.join(sizes, "group_id")
        if not links:
            return rows.select("doc_id", "group_id", "group_size")
        found = join.links(root)
        each = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        return rows.join(each, "rep", "left").select("doc_id", "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    return numbered(docs, run, ("doc_id", "group_id"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group, the one with the least doc_id, and every document
    without a partner, among them all with null, empty or token-less text or a null doc_id. Of
    repeated rows of one doc_id in a group that stays one row does. All columns stay as they are."""
    gone = cut(jaccard_groups(docs, n, threshold, links=False).where("doc_id <> group_id").select("doc_id"))
    if repeats_ids(docs):
        row = fresh(docs, "_row")
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.nullif("text", F.lit("")).asc_nulls_last()))
        docs = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), number).otherwise(1)).where(F.col(row) == 1).drop(row)
    return without(docs, gone)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op9_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's own result, (a, b, jaccard); op9 gives its groups."""
    return set_pairs(table(spark, sf_dir, "documents"))
