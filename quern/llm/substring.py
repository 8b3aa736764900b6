"""Line and paragraph dedup: units that occur anywhere in the corpus before are cut out.

A unit is what stands between two separators ("line": one line feed, "paragraph": a blank line).
Passages are copied into the middle of lines too, where no whole line repeats; so each run of
phrases, from any phrase to the first end of a phrase that makes MIN_PASSAGE words, is a unit as
well. A phrase ends after one of . , ; : ! ? | and a line feed. A copied passage thus goes but for
the words before its first and after its last such sign.

A unit's digest is over its normalised words: runs of letters, digits and underscores, with A-Z
and the letters from U+00C0 to U+00DE in lower case; other signs and white space don't count. Of
equal units the one with the least (doc_id, place) stays, in all the corpus; the others go. Lines
of fewer than ``min_words`` words are left alone: two texts may well share "Thank you." op4 leaves
them below MIN_WORDS, as its SQL does; op4_passages takes every line with a word.

With ``window`` above 0 passages without such signs are found as well: a run is a unit, too, from
any anchor to the first anchor at least MIN_PASSAGE words later. Anchors are the words at which the
hash of three words is the least of ``window`` neighbours in some stretch, so that equal texts have
equal anchors whatever their signs: two copies of MIN_PASSAGE + 3 * window words or more always
share a unit, and the words of a copy before its first and after its last anchor stay.

Digests have 64 bits: among n units about n * n / 2**65 are taken for a copy that they aren't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._bytes import Powers, U, grams, hashes, mix, pieces, spans, trimmed
from quern.llm._io import id_and_text, numbered, table, whole

MIN_WORDS = 8
MIN_PASSAGE = 20
#: Neighbouring hashes of three words of which the least is an anchor; 44 words always share a unit.
WINDOW = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?|\n"]] = True
SPAN = 31


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, as many as before."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, int)
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


def _lines(data: np.ndarray, at: np.ndarray, paragraphs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of each line or paragraph, its separator included, in order."""
    stop = np.flatnonzero(data == 10) + 1
    if paragraphs and len(stop):  # a run of line feeds in one text is one separator, a single one is none
        owner = np.searchsorted(at, stop - 1, side="right") - 1
        last = np.r_[(np.diff(stop) != 1) | (np.diff(owner) != 0), True]
        first = np.r_[True, last[:-1]]
        stop = stop[last][np.flatnonzero(last) > np.flatnonzero(first)]
    return _between(at, stop)


def _between(at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.unique(np.r_[at, stop])
    return np.searchsorted(at, edge[:-1], side="right") - 1, edge[:-1], edge[1:]


def _anchors(h: np.ndarray, before: np.ndarray, window: int) -> np.ndarray:
    """The words, by number, that start the least hash of three words in some window of neighbours
    within one text; of equal hashes the last counts. h: the words' hashes, before: as of spans."""
    g, of = grams(h, before, 3)
    n = len(g) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for k in range(1, window):
        less = g[k : k + n] <= least
        least[less] = g[k : k + n][less]
        at[less] = np.flatnonzero(less) + k
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    at = np.unique(at[row[:n] == row[window - 1 :]])
    return at - of[row[at]] + before[row[at]]


def _units(least: int, passage: int, paragraphs: bool, window: int) -> Callable:
    """(doc_id, span, h) of each unit. A unit that repeats one of the same piece can't be the first:
    it needs no comparison, has the complement of its span and a digest of its doc_id alone, so
    that the units of no digest pile up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, _, data, at in pieces(b.column("text")):
                low = fold(data)
                s, e, before = spans(low, at)
                h = hashes(low, s, e, powers)
                powers.grow(len(h) + 1)
                total = np.zeros(len(h) + 1, U)
                np.cumsum(h * powers.up[: len(h)], out=total[1:])
                who, start, end = _lines(data, at, paragraphs)
                first, last = np.searchsorted(s, start), np.searchsorted(s, end)
                big = last - first >= max(1, least)
                units = [x[big] for x in (who, start, end, first, last)]
                kind = np.zeros(big.sum(), U)
                who, start, end = _between(at, np.flatnonzero(STOP[data]) + 1)
                first, last = np.searchsorted(s, start), np.searchsorted(s, end)
                who, start, end, first, last = (x[last > first] for x in (who, start, end, first, last))
                to = np.searchsorted(last, first + passage)
                ok = np.flatnonzero(to < len(last))
                ok = ok[who[to[ok]] == who[ok]]
                runs = (who[ok], start[ok], end[to[ok]], first[ok], last[to[ok]])
                who, start, end, first, last = (np.r_[x, y] for x, y in zip(units, runs))
                kind = np.r_[kind, np.ones(len(ok), U)]
                if window:
                    anchor = _anchors(h, before, window)
                    owner, to = np.searchsorted(before, anchor, side="right") - 1, np.searchsorted(anchor, anchor + passage)
                    ok = np.flatnonzero(to < len(anchor))
                    ok = ok[owner[to[ok]] == owner[ok]]
                    a, z = anchor[ok], anchor[to[ok]]
                    who, start, end, first, last = (np.r_[x, y] for x, y in zip((who, start, end, first, last), (owner[ok], s[a], e[z - 1], a, z)))
                    kind = np.r_[kind, np.full(len(ok), 1 << 40, U)]
                digest = mix((total[last] - total[first]) * powers.down[first] + (last - first).astype(U) * U(2) + kind)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                base = chars[at[who]]
                span, doc = (chars[start] - base) << SPAN | (chars[end] - base), ids[lo + who]
                o = np.lexsort((span, doc, digest))
                digest, doc, span = digest[o], doc[o], span[o]
                again = np.r_[False, digest[1:] == digest[:-1]] if len(o) else np.zeros(0, bool)
                digest = np.where(again, mix(doc.astype(np.int64).view(U)), digest)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.where(again, ~span, span)), pa.array(digest.view(np.int64))], names=["doc_id", "span", "h"])

    return trimmed(run)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "line", min_passage: int = MIN_PASSAGE, window: int = 0) -> DataFrame:
    """(doc_id, start, end) of each stretch to remove, in characters of the original text, from 0:
    the units that aren't the first of their digest, and as one those that overlap or touch."""
    if unit not in ("line", "paragraph"):
        raise ValueError(f"unit is 'line' or 'paragraph', not {unit!r}")
    units = id_and_text(docs).mapInArrow(_units(min_words, max(1, min_passage), unit == "paragraph", window), "doc_id long, span long, h long")
    order = Window.partitionBy("h").orderBy(F.col("span") < 0, "doc_id", "span")
    gone = units.withColumn("n", F.row_number().over(order)).where("n > 1 or span < 0")
    span = F.when(F.col("span") < 0, -F.col("span") - 1).otherwise(F.col("span"))
    gone = gone.select("doc_id", F.shiftright(span, SPAN).alias("start"), span.bitwiseAND(F.lit((1 << SPAN) - 1)).alias("end"))
    by_place = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    apart = F.col("start") > F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce("apart", F.lit(True)), 1).otherwise(0)).over(by_place)
    return gone.withColumn("apart", apart).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "line", min_passage: int = MIN_PASSAGE, window: int = 0) -> DataFrame:
    """(doc_id, text, n_removed, removed) a document: the text that is left and the removed
    (start, end) in the original, in order. A line goes with its line feed, a paragraph with the
    blank line after it, a passage with the sign at its end or, if an anchor ends it, up to the end
    of its last word.

    Null text counts as empty and gives ''. Rows with a null doc_id are left out, rows that share
    one are one document with the least of their texts. Repeats within one document go like any
    other. Documents without repeats come back as they are. Ids may have any type that can be
    ordered. Other columns don't matter.
    """
    if not whole(docs):
        return numbered(docs, lambda d: dedup_units(d, min_words, unit, min_passage, window))
    gone = repeats(docs, min_words, unit, min_passage, window).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    joined = id_and_text(docs).join(gone, "doc_id", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda g: g["end"]))
    starts = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.length("text").cast("long")))
    left = F.array_join(F.zip_with(ends, starts, lambda a, z: F.col("text").substr((a + 1).cast("int"), (z - a).cast("int"))), "")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dedup_units of documents, the removed stretches written as 'start-end' lists so that SQL gives the same."""
    return _as_text(dedup_units(table(spark, sf_dir, "documents")))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4, and what it leaves: passages whatever their signs, and lines of any word at all. There
    is no SQL for the anchors."""
    return _as_text(dedup_units(table(spark, sf_dir, "documents"), min_words=1, window=WINDOW))


def _as_text(found: DataFrame) -> DataFrame:
    spans_text = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return found.withColumn("removed", spans_text)


WORDS_SQL = r"regexp_extract_all(lower({}), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
cut AS (SELECT doc_id, 0 AS kind, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS parts FROM d
    UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '[^.,;:!?|\n]*[.,;:!?|\n]|[^.,;:!?|\n]+') FROM d),
part AS (SELECT doc_id, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
placed AS (SELECT doc_id, kind, k, {WORDS_SQL.format('part')} AS words, length(part) AS n,
    sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM part),
phrase AS (SELECT *, stop - n AS start, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY k) AS w_end FROM placed WHERE kind = 1 AND len(words) > 0),
told AS (SELECT doc_id, flatten(list(words ORDER BY k)) AS words FROM phrase GROUP BY doc_id),
run AS (SELECT a.doc_id, a.start, b.stop, a.w_end - len(a.words) AS w_start, b.w_end FROM phrase a ASOF JOIN phrase b ON a.doc_id = b.doc_id AND a.w_end - len(a.words) + {MIN_PASSAGE} <= b.w_end),
unit AS (SELECT doc_id, 0 AS kind, stop - n AS start, stop, array_to_string(words, ' ') AS key FROM placed WHERE kind = 0 AND len(words) >= {MIN_WORDS}
    UNION ALL SELECT doc_id, 1, start, stop, array_to_string(words[(w_start + 1)::BIGINT:w_end::BIGINT], ' ') FROM run JOIN told USING (doc_id)),
gone AS (SELECT doc_id, start, stop FROM unit QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY doc_id, start) > 1),
marked AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS apart FROM gone),
numbered AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS island FROM marked),
hole AS (SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM numbered GROUP BY doc_id, island),
kept AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0)::BIGINT AS before FROM hole),
left_over AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before), '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS text,
    count(*) AS n_removed, string_agg(start::VARCHAR || '-' || stop::VARCHAR, ',' ORDER BY start) AS removed FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.text, d.text) AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN left_over l USING (doc_id)
"""
