"""Segmentation lattices of pre-tokens over a fixed public vocabulary, walked along a trie.

A pre-token is U+2581 and a run of bytes without ASCII white space. The distinct pre-tokens of a
batch, sorted, are the leaves of a trie whose nodes are their prefixes: a prefix is new where it is
longer than what a word shares with the word before. Depth by depth all new prefixes get their
value at once, from the values of the prefixes that end before a last piece; a prefix that many
words share is worked out once. Pieces are found by the running hash of their characters, for
many depths at once where few words go on, so that a word may have any length: text without white
space is one word, and costs time in proportion to its characters.
A character outside the vocabulary is spelled in UTF-8 bytes, each a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm._bytes import Powers, U, hashes, mix, pieces, spans

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SOLID = np.ones(256, bool)
SOLID[[*b"\t\n\v\f\r "]] = False
#: Characters of words that are walked at once (one word may have more), and positions whose pieces are found at once.
BLOCK = 1 << 17
AHEAD = 1 << 15
#: Bytes of text whose words are gathered at once.
PIECE = 1 << 19
#: What a byte of a character outside the vocabulary costs below the rarest piece.
BYTE_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces in the order of the vocabulary, and two hash tables that find them."""

    texts: list[str]
    keys: tuple[np.ndarray, np.ndarray]
    ids: tuple[np.ndarray, np.ndarray]
    longest: int

    @property
    def size(self) -> int:
        return len(self.texts)

    def parts(self) -> tuple:
        """What the constructor takes, as plain values: workers unpickle a broadcast without this package."""
        return self.texts, self.keys, self.ids, self.longest

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 for none."""
        a, b = (h >> U(47)).astype(np.int64), ((h >> U(30)) & U(0x1FFFF)).astype(np.int64)
        return np.where(self.keys[0][a] == h, self.ids[0][a], np.where(self.keys[1][b] == h, self.ids[1][b], -1))


def text_hash(points: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums from which slices of code points get their hashes."""
    powers.grow(len(points) + 1)
    total = np.zeros(len(points) + 1, U)
    np.cumsum((points.astype(U) + U(1)) * powers.up[: len(points)], out=total[1:])
    return total


def load(path: str = VOCABULARY) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model, by their rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return vocabulary(texts)


def vocabulary(texts: list[str]) -> Vocabulary:
    texts = list(dict.fromkeys(t for t in texts if t))
    powers = Powers()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    total = text_hash(points, powers)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    h = mix((total[end] - total[start]) * powers.down[start])
    keys, ids = (np.zeros(1 << 17, U), np.zeros(1 << 17, U)), (np.full(1 << 17, -1, np.int32), np.full(1 << 17, -1, np.int32))
    for i, x in enumerate(h.tolist()):
        side = 0
        for _ in range(500):  # a full slot makes room by moving its piece to the other table
            at = x >> 47 if side == 0 else (x >> 30) & 0x1FFFF
            old, old_id = int(keys[side][at]), int(ids[side][at])
            keys[side][at], ids[side][at] = x, i
            if old_id < 0:
                break
            x, i, side = old, old_id, 1 - side
        else:
            raise ValueError("vocabulary too large for its tables")
    return Vocabulary(texts, keys, ids, max(map(len, texts)))


def words(col: pa.Array, powers: Powers) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a text column in order; for each occurrence its word, and its row."""
    seen: dict[int, bytes] = {}
    keys, places, rows = [], [], []
    for lo, _, data, at in pieces(col, PIECE):
        s, e, first = spans(data, at, SOLID)
        own, where, place = np.unique(hashes(data, s, e, powers), return_index=True, return_inverse=True)
        held = data.tobytes()
        for k, a, z in zip(own.tolist(), s[where].tolist(), e[where].tolist()):
            if k not in seen:
                seen[k] = held[a:z]
        keys.append(own)
        places.append(place)
        rows.append(lo + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    if not seen:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.fromiter(seen.keys(), U, len(seen))
    texts = [MARK + b.decode("utf-8", "replace") for b in seen.values()]
    order = pc.sort_indices(pa.array(texts, pa.large_string())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(key)
    found = [rank[by[np.searchsorted(key[by], own)]][place] for own, place in zip(keys, places)]
    return [texts[i] for i in order], np.concatenate(found), np.concatenate(rows)


def blocks(sorted_words: list[str], size: int) -> Iterator[tuple[int, int]]:
    """(first word, word after the last) of blocks of about size characters, or of one word."""
    end = np.cumsum(np.fromiter(map(len, sorted_words), np.int64, len(sorted_words)))
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


@dataclass
class Stretch:
    """The lattice between two depths. keep: the words, by their place among those of the stretch
    before, that go on. Nodes (new prefixes) are sorted by depth and have an edge for each piece
    that ends there, the shortest first; ids is the piece, or -1 - bytes for a character outside
    the vocabulary. at and first: nodes before each depth, edges before each node."""

    depth: int
    keep: np.ndarray
    word: np.ndarray
    at: np.ndarray
    first: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    #: For each depth, the words that share a node and the words whose node it is.
    shared: list[tuple[np.ndarray, np.ndarray]]


def shared_prefixes(sorted_words: list[str], points: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many characters each word has in common with the word before."""
    out = np.zeros(len(size), np.int64)
    least = np.minimum(size[1:], size[:-1])
    alike = np.arange(1, len(size))
    for d in range(32):
        alike = alike[least[alike - 1] > d]
        alike = alike[points[off[alike] + d] == points[off[alike - 1] + d]]
        out[alike] = d + 1
    for i in alike.tolist():
        a, b, lo, hi = sorted_words[i - 1], sorted_words[i], 32, int(least[i - 1])
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
        out[i] = lo
    return out


def stretches(sorted_words: list[str], vocab: Vocabulary, powers: Powers, share: bool = True) -> Iterator[Stretch]:
    """The lattice of sorted words, from depth 1 on; share: False treats every word by itself."""
    points = np.frombuffer("".join(sorted_words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, sorted_words), np.int64, len(sorted_words))
    off = np.cumsum(size) - size
    total, back = text_hash(points, powers), np.arange(vocab.longest)
    alike = shared_prefixes(sorted_words, points, off, size) if share else np.zeros(len(size), np.int64)
    d, lanes = 1, np.arange(len(size))
    while len(keep := np.flatnonzero(size[lanes] >= d)):
        if len(keep) < len(lanes):
            # What two words share that were no neighbours is the least along the way between them.
            alike, lanes = np.minimum.reduceat(alike[: keep[-1] + 1], np.r_[0, keep[:-1] + 1]), lanes[keep]
        far = min(max(1, AHEAD // len(lanes)), int(size[lanes].max()) + 1 - d)
        begin, stop = np.maximum(d, alike + 1), np.minimum(d + far, size[lanes] + 1)
        n = np.maximum(stop - begin, 0)
        word = np.repeat(np.arange(len(lanes)), n)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        order = np.argsort(depth, kind="stable")
        word, depth = word[order], depth[order]
        end = off[lanes[word]] + depth
        start = np.maximum(end[:, None] - 1 - back, 0)
        ids = vocab.find(mix((total[end][:, None] - total[start]) * powers.down[start]))
        ids[back >= depth[:, None]] = -1
        hit = ids >= 0
        lone = ~hit[:, 0]
        p = points[end[lone] - 1]
        ids[lone, 0] = -2 - (p >= 0x80).astype(np.int32) - (p >= 0x800) - (p >= 0x10000)
        hit[:, 0] = True
        node, k = np.nonzero(hit)
        shared, pool = [], np.flatnonzero(alike >= d)
        for x in range(d, d + far):
            if len(pool):
                pool = pool[alike[pool] >= x]
            lead = np.maximum.accumulate(np.where(alike < x, np.arange(len(lanes)), 0))[pool] if len(pool) else pool
            shared.append((pool, lead))
        yield Stretch(d, keep, word, np.searchsorted(depth, np.arange(d, d + far + 1)), np.searchsorted(node, np.arange(len(word) + 1)), k + 1, ids[node, k], shared)
        d += far


def zipf(n: int) -> np.ndarray:
    """Log probabilities of n pieces by rank: a vocabulary's order is that of its frequencies."""
    p = 1.0 / (np.arange(n) + 10.0)
    return np.log(p / p.sum())


def _log_weights(ids: np.ndarray, score: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Of each edge; the spelling of a character costs byte for each of its bytes."""
    w = score[np.maximum(ids, 0)]
    alone = np.flatnonzero(ids < 0)
    w[alone] = np.multiply.outer(-1.0 - ids[alone], byte)
    return w


def viterbi(sorted_words: list[str], vocab: Vocabulary, score: np.ndarray, share: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of pieces of the best segmentation of each word; of equal scores, the fewest pieces."""
    byte, powers, long = np.float64(score.min()) - BYTE_PENALTY, Powers(), vocab.longest
    out, count = np.zeros(len(sorted_words)), np.zeros(len(sorted_words), np.int64)
    for lo, hi in blocks(sorted_words, BLOCK):
        size = np.fromiter(map(len, sorted_words[lo:hi]), np.int64, hi - lo)
        live, v, n = np.arange(hi - lo), np.zeros((long, hi - lo)), np.zeros((long, hi - lo), np.int64)
        for s in stretches(sorted_words[lo:hi], vocab, powers, share):
            if len(s.keep) < len(live):
                live, v, n = live[s.keep], v[:, s.keep], n[:, s.keep]
            w, more = _log_weights(s.ids, score, byte), np.where(s.ids < 0, -1 - s.ids, 1)
            nodes = np.diff(s.first)
            lane = np.repeat(s.word, nodes)
            for x in range(len(s.at) - 1):
                d, a, z = s.depth + x, s.at[x], s.at[x + 1]
                to = d % long
                if a < z:
                    e, f = s.first[a], s.first[z]
                    row, of = (d - s.length[e:f]) % long, lane[e:f]
                    first = s.first[a:z] - e
                    each, uses = v[row, of] + w[e:f], n[row, of] + more[e:f]
                    best = np.maximum.reduceat(each, first)
                    v[to, s.word[a:z]] = best
                    n[to, s.word[a:z]] = np.minimum.reduceat(np.where(each == np.repeat(best, nodes[a:z]), uses, 1 << 62), first)
                same, lead = s.shared[x]
                if len(same):
                    v[to, same], n[to, same] = v[to, lead], n[to, lead]
                done = np.flatnonzero(size[live] == d)
                if len(done):
                    out[lo + live[done]], count[lo + live[done]] = v[to, done], n[to, done]
    return out, count


def _sum(each: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Logs of the sums over each node's edges."""
    top = np.maximum.reduceat(each, first)
    return top + np.log(np.add.reduceat(np.exp(each - np.repeat(top, sizes, axis=0)), first))


def forward(sorted_words: list[str], vocab: Vocabulary, logp: np.ndarray, share: bool = True) -> np.ndarray:
    """Log probability of each word, summed over all its segmentations, in each of the models:
    logp has a column a model, and a last row for a byte."""
    models, powers, long = logp.shape[1], Powers(), vocab.longest
    out = np.zeros((len(sorted_words), models))
    for lo, hi in blocks(sorted_words, BLOCK):
        size = np.fromiter(map(len, sorted_words[lo:hi]), np.int64, hi - lo)
        live, v = np.arange(hi - lo), np.zeros((long, hi - lo, models))
        for s in stretches(sorted_words[lo:hi], vocab, powers, share):
            if len(s.keep) < len(live):
                live, v = live[s.keep], v[:, s.keep]
            w, nodes = _log_weights(s.ids, logp, logp[-1]), np.diff(s.first)
            lane = np.repeat(s.word, nodes)
            for x in range(len(s.at) - 1):
                d, a, z = s.depth + x, s.at[x], s.at[x + 1]
                to = d % long
                if a < z:
                    e, f = s.first[a], s.first[z]
                    v[to, s.word[a:z]] = _sum(v[(d - s.length[e:f]) % long, lane[e:f]] + w[e:f], s.first[a:z] - e, nodes[a:z])
                same, lead = s.shared[x]
                if len(same):
                    v[to, same] = v[to, lead]
                done = np.flatnonzero(size[live] == d)
                if len(done):
                    out[lo + live[done]] = v[to, done]
    return out


def expected(sorted_words: list[str], counts: np.ndarray, vocab: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, and of a byte in the last row, over all segmentations of words
    with counts in each model (a row a word, a column a model). All prefixes of a block are held."""
    models, powers, out = logp.shape[1], Powers(), np.zeros_like(logp)
    for lo, hi in blocks(sorted_words, max(1 << 14, BLOCK // (4 * models))):
        size = np.fromiter(map(len, sorted_words[lo:hi]), np.int64, hi - lo)
        off = np.cumsum(size + 1) - size - 1
        alpha = np.zeros((size.sum() + hi - lo, models))
        beta = np.full_like(alpha, -np.inf)
        held, live = [], np.arange(hi - lo)
        for s in stretches(sorted_words[lo:hi], vocab, powers, False):
            live = live[s.keep]
            w, nodes = _log_weights(s.ids, logp, logp[-1]), np.diff(s.first)
            end = off[live[s.word]] + np.repeat(np.arange(s.depth, s.depth + len(s.at) - 1), np.diff(s.at))
            to = np.repeat(end, nodes)
            since = to - s.length
            for a, z in zip(s.at[:-1], s.at[1:]):
                e, f = s.first[a], s.first[z]
                alpha[end[a:z]] = _sum(alpha[since[e:f]] + w[e:f], s.first[a:z] - e, nodes[a:z])
            held.append((s, w, to, since, np.repeat(live[s.word], nodes)))
        beta[off + size] = 0.0
        whole, n = alpha[off + size], counts[lo:hi]
        for s, w, to, since, of in reversed(held):
            for a, z in zip(s.at[-2::-1], s.at[:0:-1]):
                e, f = s.first[a], s.first[z]
                beta[since[e:f]] = np.logaddexp(beta[since[e:f]], w[e:f] + beta[to[e:f]])
            use = np.exp(alpha[since] + w + beta[to] - whole[of]) * n[of]
            spelled = s.ids < 0
            out[-1] += ((-1.0 - s.ids[spelled])[:, None] * use[spelled]).sum(axis=0)
            for m in range(models):
                out[:, m] += np.bincount(s.ids[~spelled], weights=use[~spelled, m], minlength=len(out))
    return out
