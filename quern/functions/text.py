"""Text for the embedder: clean-up, pre-tokens, WordPiece, windows of tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript has it; Java's \s is ASCII alone.
SPACE = "\\x09-\\x0D\\x20\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
PUNCTUATION = "!-/:-@\\[-`{-~"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]"
PRE_TOKEN = f"[{PUNCTUATION}]|[^{PUNCTUATION}{SPACE}]+"
#: Tokens a model takes at once, two marks among them. Longer texts get windows of 509 content
#: tokens that begin 459 apart.
MAX_LENGTH = 512
LONGEST_WORD = 200
#: Tokens and pieces that WordPiece takes at once, and distinct tokens whose pieces a worker keeps.
SLICE_TOKENS = 1 << 18
SLICE_PIECES = 1 << 18
KNOWN_TOKENS = 1 << 18


@F.pandas_udf(T.StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition; accents stay, as marks of their own."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x))


def strip_control(c: Column) -> Column:
    """Without control characters but tab, line feed and carriage return."""
    return F.regexp_replace(c, CONTROL, "")


def squeeze_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def is_punctuation(c: Column) -> Column:
    """Whether the first character is ASCII punctuation; punctuation beyond ASCII is none."""
    return c.rlike(f"^[{PUNCTUATION}]")


def pretokens(c: Column) -> Column:
    """Words, and every ASCII punctuation sign by itself, in order."""
    return F.regexp_extract_all(c, F.lit(PRE_TOKEN), F.lit(0))


def clean(c: Column) -> Column:
    """Decomposed, without controls, with single spaces."""
    return squeeze_space(strip_control(nfd(c)))


def pieces_of(token: str, vocab: dict[str, int], unknown: str = "[UNK]", longest: int = LONGEST_WORD) -> list[str]:
    """Greedy longest pieces from the left, later ones with ##; a gap makes all of the token unknown."""
    if len(token.encode("utf-16-le")) // 2 > longest:
        return [unknown]
    out, at = [], 0
    while at < len(token):
        for end in range(len(token), at, -1):
            piece = ("##" if at else "") + token[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def wordpiece(df: DataFrame, tokens: str, vocab: dict[str, int], out: str = "pieces", ids: str | None = "ids", unknown: str = "[UNK]", longest: int = LONGEST_WORD) -> DataFrame:
    """df with the pieces of an array of pre-tokens, and their ids; tokens are put in lower case
    here, and no array counts as an empty one. Each distinct token is cut once a slice of a batch;
    what a worker holds follows the slices and the largest row."""
    held = df.sparkSession.sparkContext.broadcast(vocab)
    # Else a filter on the pieces goes below them, and they are worked out for it once more.
    cut = F.arrow_udf(_pieces(held, special_ids(vocab)["[UNK]"], unknown, longest), "pieces array<string>, ids array<bigint>").asNondeterministic()
    done = df.withColumn("_cut", cut(tokens)).withColumn(out, F.col("_cut.pieces"))
    return (done.withColumn(ids, F.col("_cut.ids")) if ids else done).drop("_cut")


def _pieces(held: Broadcast, missing: int, unknown: str, longest: int, tokens: int = SLICE_TOKENS, pieces: int = SLICE_PIECES, keep: int = KNOWN_TOKENS) -> Callable:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, known, codes = held.value, {}, {}
        names, numbers = [], []

        def cut_up(token: str) -> bytes:
            found = pieces_of(token.lower(), words, unknown, longest)
            for p in found:
                if p not in codes:
                    codes[p] = len(codes)
                    names.append(p)
                    numbers.append(words.get(p, missing))
            return np.array([codes[p] for p in found], np.int32).tobytes()

        for col in it:
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _slices(size, tokens):
                coded = col.slice(lo, hi - lo).flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > keep:
                    known.clear()
                for t in distinct:
                    if t not in known:
                        known[t] = cut_up(t)
                each = [known[t] for t in distinct]
                flat, n = np.frombuffer(b"".join(each), np.int32), np.fromiter(map(len, each), np.int64, len(each)) // 4
                code, first = coded.indices.to_numpy(), np.cumsum(n) - n
                before = np.r_[0, np.cumsum(size[lo:hi])]
                upto = np.r_[0, np.cumsum(n[code])][before]
                values = pa.array(names, pa.string()), pa.array(numbers, pa.int64())
                for a, b in _slices(np.diff(upto), pieces):
                    own = code[before[a] : before[b]]
                    start, many = first[own], n[own]
                    take = pa.array(flat[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())])
                    edge = pa.array((upto[a : b + 1] - upto[a]).astype(np.int32))
                    yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(edge, v.take(take)) for v in values], ["pieces", "ids"])

    return run


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows whose sizes sum to most, or of one row."""
    upto, lo = np.r_[0, np.cumsum(size)], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def special_ids(vocab: dict[str, int]) -> dict[str, int]:
    """Ids of the marks, with the usual ones where the vocabulary has none; ValueError if one isn't a number."""
    found = {t: vocab.get(t, d) for t, d in (("[CLS]", 101), ("[SEP]", 102), ("[UNK]", 100))}
    for t, i in found.items():
        if isinstance(i, bool) or not isinstance(i, (int, np.integer)):
            raise ValueError(f"the id of {t} is not a number: {i!r}")
    return found


def windows(content: Column, max_length: int = MAX_LENGTH) -> Column:
    """Windows of an array of content tokens: all of it if it fits with two marks, else overlapping
    ones, the last of them even where the one before already holds it."""
    # As a variable of a function content is worked out once, however many windows there are.
    return F.transform(F.array(content), lambda c: windows_of(c, max_length))[0]


def windows_of(content: Column, max_length: int = MAX_LENGTH) -> Column:
    """As windows, for a column that is there already: an expression would be worked out for each window."""
    fits = max_length - 2
    width, stride = fits - 1, fits - fits // 10
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(content) - 1, F.lit(0)), F.lit(stride)), lambda i: F.slice(content, i + 1, width))
    return F.when(F.size(content) <= fits, F.array(content)).otherwise(many)


def with_marks(window: Column, first: object, last: object) -> Column:
    return F.concat(F.array(F.lit(first)), window, F.array(F.lit(last)))


def token_chunks(df: DataFrame, text: str, vocab: dict[str, int], max_length: int = MAX_LENGTH) -> DataFrame:
    """df exploded to (…, chunk_no, tokens, ids): each text's windows with their marks. Empty text
    has one window, the two marks alone; null counts as empty."""
    ids = special_ids(vocab)
    d = df.withColumn("_pre", pretokens(clean(F.coalesce(F.col(text), F.lit("")))))
    d = wordpiece(d, "_pre", vocab, "_pieces", "_ids").withColumn("_chunks", F.arrays_zip(windows_of(F.col("_pieces"), max_length).alias("t"), windows_of(F.col("_ids"), max_length).alias("i")))
    d = d.select(*df.columns, F.posexplode("_chunks").alias("chunk_no", "_c"))
    return d.select(*df.columns, "chunk_no", with_marks(F.col("_c.t"), "[CLS]", "[SEP]").alias("tokens"), with_marks(F.col("_c.i"), ids["[CLS]"], ids["[SEP]"]).cast("array<bigint>").alias("ids"))


def ids_are_numbers(ids: Column) -> Column:
    """Whether every id is there; for assert_true before a model sees them."""
    return F.forall(ids, lambda x: x.isNotNull())


