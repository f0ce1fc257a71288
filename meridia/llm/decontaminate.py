"""Benchmark decontamination by latent semantic retrieval.

Texts are read as passages of ``WINDOW`` words: end to end for the corpus's statistics and
space, every ``STRIDE`` words for the search. Their terms are the words of the benchmark;
what else a passage holds cannot tell it apart from the items. However common a term is here, it keeps a weight: what is common may be so
because copies of an item are.

1. One pass counts in how many passages of the corpus each term is.
2. One pass takes the sketch of a randomised SVD: each task adds up A'(A R) over its TF-IDF
   passages for a fixed random matrix R of ``RANK`` and some more columns, and the parts
   are summed. From the sketch alone follow the leading right singular vectors of A; they
   are the latent space, and nothing of the items goes into it.
3. One pass projects all passages, and takes as candidates those with a cosine of
   ``LEAST_COSINE`` or more, in the latent space, to a passage of an item. Checks follow:
   the candidate holds ``HELD`` of the passage's words, and the words around have a
   longest common subsequence with the item of ``LEAST_LCS`` of its words, or of
   ``PARAPHRASE_LCS`` if the item's answer, its last words, stands there too. An item
   of more than one passage is matched by one whole passage as well.

The rank and the least cosine are set by measurement: of matches found by comparing every
document with every item, retrieval has to find 0.9 at least (a test does so).

Items are handled in blocks of ``BLOCK`` passages, which bounds what tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytescan import _LOWER, buffers, lean, mix, pieces, prefix_hash, span_hash
from .common import only, table

WINDOW, STRIDE, ITEM = 64, 32, 32
LEAST_COSINE, LEAST_LCS, PARAPHRASE_LCS, ANSWER = 0.2, 0.8, 0.6, 5
HELD, BLOCK, RANK, MORE, LEAST_WORDS = 0.55, 512, 256, 32, 5
ROWS = 1024  # passages projected at a time
GATHER = 2048  # terms of sparse rows multiplied at a time
DENSE = 16  # so many of them have a common term
FLUSH = 64  # blocks added up in single precision
LONG = 64  # bytes of a word that are hashed by eights

# Of each byte of a word the lower-cased one, of other bytes 0.
_FOLD = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _FOLD[_a:_b] = _LOWER[_a:_b]
_FOLD = _FOLD.tobytes()
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower-cased), and for each text
    the number of its first word, one entry more than texts."""
    n = len(raw)
    low = np.zeros((n // 8 + 3) * 8, np.uint8)  # from 8 on, so that a word's bytes stand in whole integers
    low[8 : n + 8] = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8)
    solid = low[7 : n + 9] != 0
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = turns[0::2], turns[1::2]
    inside = np.unique(at[solid[at] & solid[at + 1]])  # ends of texts between two words
    if len(inside):
        starts, stops = np.sort(np.append(starts, inside)), np.sort(np.append(stops, inside))
    return _hashed(low, starts, stops), np.searchsorted(starts, at)


def _hashed(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of ``low[8:]``, by eight bytes at a time; of long ones by running sums."""
    eights, size = low.view("<u8"), stops - starts

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        place, shift = (at >> 3) + 1, ((at & 7) << 3).view(np.uint64)
        both = (eights[place] >> shift) | (eights[place + 1] << np.uint64(1) << (np.uint64(63) - shift))
        return both & _LEFT[np.minimum(left, 8)]

    out = mix(eight(starts, size) + size.astype(np.uint64) * _SIZE)
    some, done = np.flatnonzero(size > 8), 8
    while done < LONG and len(some):
        out[some] = mix((out[some] ^ eight(starts[some] + done, size[some] - done)) + _SIZE)
        done += 8
        some = some[size[some] > done]
    if len(some):
        out[some] = mix(out[some] ^ span_hash(prefix_hash(low), starts[some] + 8, stops[some] + 8))
    return out


def windows(first: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of all passages; a text of ``width`` words or fewer is one."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(count))[:-1], count) if len(text) else text
    lo = first[:-1][text] + k * stride
    return text, lo, np.minimum(lo + width, first[1:][text])


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    terms: np.ndarray  # sorted hashes
    passages: np.ndarray  # item number of each passage
    spans: list[tuple[int, int]]
    tables: list[Subsequence]
    parts: list[Subsequence | None]  # of each passage, where the item has more than one
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # term by latent dimension
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # passages in the latent space, of unit length
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # term by passage: how often it is there
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))  # words of each passage that a candidate holds
    spots: tuple = ()  # of each term the first of its entries in the next two; passages; how often

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        raw = [(t or "").encode() for _, t in rows]
        at = np.append(0, np.cumsum([len(x) for x in raw]))
        hashes, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
        text, lo, hi = windows(first, ITEM, ITEM // 2)
        words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        spans = [(a - first[t], b - first[t]) for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
        alone = np.bincount(text, minlength=len(words)) < 2
        parts = [None if alone[t] else Subsequence.of(words[t][a:b]) for t, (a, b) in zip(text.tolist(), spans, strict=True)]
        return cls([i for i, _ in rows], words, np.unique(hashes), text, spans, [Subsequence.of(w) for w in words], parts)

    def counts(self) -> np.ndarray:
        """How often each term is in each of the items' passages."""
        out = np.zeros((len(self.passages), len(self.terms)), np.float32)
        for row, (item, (a, b)) in enumerate(zip(self.passages.tolist(), self.spans, strict=True)):
            np.add.at(out[row], np.searchsorted(self.terms, self.words[item][a:b]), 1)
        return out

    def index(self) -> None:
        """Prepares the count of the passages' words that a candidate holds."""
        self.own = np.ascontiguousarray(self.counts().T)
        self.least = np.ceil((HELD - 1e-6) * self.own.sum(0, dtype=float)).astype(np.float32)
        term, passage = np.nonzero(self.own)
        self.spots = np.searchsorted(term, np.arange(len(self.terms) + 1)), passage, self.own[term, passage]

    def matrix(self) -> np.ndarray:
        """TF-IDF rows of the items' passages, of unit length."""
        out = self.counts()
        out = np.where(out > 0, 1 + np.log(np.maximum(out, 1)), 0).astype(np.float32) * self.weight.astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Terms:
    """Sorted hashes with a table by some of their bits, which finds most words by one look;
    words at a place that several terms share are searched."""

    BITS = 17

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        key = self._key(hashes)
        self.places = np.full(1 << self.BITS, -1, np.int32)
        self.places[key] = np.arange(len(hashes))
        self.places[np.flatnonzero(np.bincount(key, minlength=1 << self.BITS) > 1)] = -2

    def _key(self, words: np.ndarray) -> np.ndarray:
        return (words.view(np.uint64) >> np.uint64(64 - self.BITS)).view(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 without one."""
        at = self.places[self._key(words)]
        some = np.flatnonzero(at != -1)
        spot, own = at[some], words[some]
        shared = np.flatnonzero(spot == -2)
        spot[shared] = np.minimum(np.searchsorted(self.hashes, own[shared]), len(self.hashes) - 1)
        at[some] = np.where(self.hashes[spot] == own, spot, -1)
        return at


@lru_cache(maxsize=4)
def _terms(raw: bytes, kind: str) -> Terms:
    return Terms(np.frombuffer(raw, kind) if raw else np.zeros(0, kind))


def _hits(raw: np.ndarray, at: np.ndarray, terms: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """(words, first, window text, lo, hi, others, hit window, hit term): what of the terms
    is in which passage, and how many other words each has (a run of one word is one)."""
    words, first = word_hashes(raw, at)
    text, lo, hi = windows(first, WINDOW, stride)
    where = _terms(terms.tobytes(), terms.dtype.str).find(words)
    known = where >= 0
    place = np.flatnonzero(known)
    other = np.append(0, np.cumsum(~known & np.append(True, words[1:] != words[:-1]))) if len(words) else np.zeros(1, np.int64)
    a, b = np.searchsorted(place, lo), np.searchsorted(place, hi)
    window = np.repeat(np.arange(len(lo)), b - a)
    k = np.arange(len(window)) - np.repeat(np.append(0, np.cumsum(b - a))[:-1], b - a) if len(window) else window
    return words, first, text, lo, hi, other[hi] - other[lo], window, where[place[np.repeat(a, b - a) + k]].astype(np.int64) if len(window) else np.zeros(0, np.int64)


def _frequencies(terms: np.ndarray):
    """(term, n): in how many passages each term is; term -1 counts the passages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in pieces(batches, "t"):
            _, _, text, _, _, _, window, term = _hits(*buffers(batch["t"]), terms, WINDOW)
            pair = np.sort(window * len(terms) + term)
            total += np.bincount(pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]] % len(terms), minlength=len(terms))
            n += len(text)
        found = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(np.append(found, -1), pa.int64()), "n": pa.array(np.append(total[found], n), pa.int64())})

    return scan


def _weighted(window: np.ndarray, term: np.ndarray, others: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sparse TF-IDF rows of unit length: (row, term, value, window of each row); passages without
    a term have none. Words that are no terms count in the length, as terms of middling weight."""
    pair = np.sort(window * len(weight) + term)
    own = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    tf, pair = np.diff(np.append(own, len(pair))), pair[own]
    at, term = pair // len(weight), pair % len(weight)
    value = (1 + np.log(tf)) * weight[term]
    new = np.append(True, at[1:] != at[:-1])[: len(at)]
    rows, row = at[new], np.cumsum(new) - 1
    norm = np.sqrt(np.bincount(row, value * value, len(rows)) + others[rows] * np.median(weight) ** 2)
    return row, term, value / norm[row] if len(row) else value, rows


def _stretches(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place) of all places of stretches that begin at ``first``."""
    stretch = np.repeat(np.arange(len(first)), count)
    return stretch, np.arange(len(stretch)) + np.repeat(first - (np.cumsum(count) - count), count)


def _project(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times the basis; rows with equally many terms are multiplied together."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    first = np.searchsorted(row, np.arange(n + 1))
    held = np.diff(first)
    by = np.argsort(held, kind="stable")
    value = value.astype(np.float32)
    for own in np.split(by, np.flatnonzero(np.diff(held[by])) + 1):
        k = int(held[own[0]]) if len(own) else 0
        for some in np.array_split(own, max(1, len(own) * k // GATHER)) if k else ():
            at = first[some][:, None] + np.arange(k)
            out[some] = np.matmul(value[at][:, None, :], basis[term[at]])[:, 0, :]
    return out


@dataclass
class Rows:
    """Some sparse rows: those of their terms that ``DENSE`` of them have as a dense block, the rest as they were."""

    n: int
    common: np.ndarray
    block: np.ndarray
    row: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> Rows:
        many = np.bincount(term) >= DENSE
        common = np.flatnonzero(many)
        column, here = np.cumsum(many) - 1, many[term]
        block = np.zeros((n, len(common)), np.float32)
        block[row[here], column[term[here]]] = value[here]
        rest = ~here
        return cls(n, common, block, row[rest], term[rest], value[rest])

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The rows times the basis."""
        out = _project(self.row, self.term, self.value, self.n, basis)
        out += self.block @ basis[self.common]
        return out

    def back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds the transposed rows times y to the total."""
        total[self.common] += self.block.T @ y
        by = np.argsort(self.term, kind="stable")
        own, number = np.unique(self.term[by], return_inverse=True)
        total[own] += _project(number, self.row[by], self.value[by], len(own), y)

    def holds(self, items: Items) -> np.ndarray:
        """How many of each passage's words (column) are in each row."""
        out = (self.block > 0).astype(np.float32) @ items.own[self.common]
        first, passage, count = items.spots
        some, at = _stretches(first[self.term], first[self.term + 1] - first[self.term])
        np.add.at(out.reshape(-1), self.row[some] * out.shape[1] + passage[at], count[at])
        return out


def _blocks(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[int, Rows]]:
    """(first row, rows) of about ``ROWS`` rows each."""
    cuts = np.linspace(0, n, max(1, round(n / ROWS)) + 1).astype(int).tolist()
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        cut = slice(*np.searchsorted(row, (s, e)))
        if e > s:
            yield s, Rows.of(row[cut] - s, term[cut], value[cut], e - s)


def _ground(n_terms: int, seed: int) -> np.ndarray:
    """The random matrix R."""
    return np.random.default_rng(seed).standard_normal((n_terms, min(RANK + MORE, n_terms))).astype(np.float32)


def _sketch(terms: np.ndarray, weight: np.ndarray, seed: int):
    """(term, row): this task's part of A'(A R), row by row of terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ground = _ground(len(terms), seed)
        total, part, n = np.zeros(ground.shape), np.zeros_like(ground), 0
        for batch in pieces(batches, "t"):
            *_, others, window, term = _hits(*buffers(batch["t"]), terms, WINDOW)
            row, term, value, rows = _weighted(window, term, others, weight)
            for _, some in _blocks(row, term, value, len(rows)):
                some.back(some.times(ground), part)
                n += 1
                if n % FLUSH == 0:
                    total += part
                    part[:] = 0
        total += part
        found = np.flatnonzero(np.abs(total).sum(1))
        yield pa.record_batch({"term": pa.array(found, pa.int64()), "row": pa.array([x.astype("<f4").tobytes() for x in total[found]], pa.binary())})

    return scan


def _summed(rank: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the terms of this partition: bounded by the block's vocabulary
        for batch in batches:
            for term, row in zip(batch["term"].to_pylist(), batch["row"].to_pylist(), strict=True):
                sums[term] = sums.get(term, np.zeros(rank)) + np.frombuffer(row, "<f4")
        yield pa.record_batch({"term": pa.array(list(sums), pa.int64()), "row": pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())})

    return scan


@dataclass
class Subsequence:
    """An item prepared for longest common subsequences, its words as bits of one integer."""

    own: np.ndarray
    counts: np.ndarray
    places: list[int]
    size: int

    @classmethod
    def of(cls, item: np.ndarray) -> Subsequence:
        own, number, counts = np.unique(item, return_inverse=True, return_counts=True)
        places = [0] * len(own)
        for k, w in enumerate(number.tolist()):
            places[w] |= 1 << k
        return cls(own, counts, places, len(item))

    def length(self, text: np.ndarray, least: int = 0) -> int:
        """Its longest common subsequence with the text; 0 where fewer than ``least`` of
        its words are in the text at all."""
        at = self.own.searchsorted(text)
        at[at == len(self.own)] = 0
        here = at[self.own[at] == text]
        if len(here) < least or self.counts[np.bincount(here, minlength=len(self.own)) > 0].sum() < least:
            return 0
        v = full = (1 << self.size) - 1
        for w in here.tolist():
            u = v & self.places[w]
            v = (v + u | v - u) & full
        return self.size - v.bit_count()


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    if len(part) > len(text):
        return False
    spots = np.flatnonzero(text[: len(text) - len(part) + 1] == part[0])
    return any(np.array_equal(text[s : s + len(part)], part) for s in spots.tolist())


def _candidates(some: Rows, items: Items, cosine: float) -> tuple[np.ndarray, ...]:
    """(row, passage, cosine) of the pairs near each other in the latent space where the
    row holds ``HELD`` of the passage's words."""
    own = some.times(items.basis)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    near = own @ items.latent.T
    found = np.flatnonzero((near >= cosine) & (some.holds(items) >= items.least))
    r, p = np.divmod(found, near.shape[1])
    return r, p, near[r, p]


def matches(raw: np.ndarray, at: np.ndarray, items: Items, cosine: float, lcs: float, paraphrase: float) -> dict[tuple[int, int], tuple[float, float]]:
    """(text, item) -> the best (share of the item's words in common, cosine) of each match."""
    words, first, text, lo, hi, others, window, term = _hits(raw, at, items.terms)
    row, term, value, rows = _weighted(window, term, others, items.weight)
    out: dict[tuple[int, int], tuple[float, float]] = {}
    for s, some in _blocks(row, term, value, len(rows)):
        r, p, c = _candidates(some, items, cosine)
        for t, w, k, i, near in zip(text[rows[s + r]].tolist(), rows[s + r].tolist(), p.tolist(), items.passages[p].tolist(), c.tolist(), strict=True):
            own = items.words[i]
            if len(own) < LEAST_WORDS or out.get((t, i), (0, 0))[0] >= 1:
                continue
            around = words[max(first[t], lo[w] - len(own)) : min(first[t + 1], hi[w] + len(own))]
            share = items.tables[i].length(around, int(min(lcs, paraphrase) * len(own))) / len(own)
            found = share >= lcs or share >= paraphrase and _contains(around, own[-ANSWER:])
            if not found and items.parts[k] is not None:
                part = items.parts[k].length(around, int(lcs * items.parts[k].size))
                found = part >= lcs * items.parts[k].size
                share = max(share, part / len(own))
            if found:
                out[t, i] = max(out.get((t, i), (0.0, 0.0)), (share, near))
    return out


def _found(items: Items, cosine: float, lcs: float, paraphrase: float, id_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            got = matches(*buffers(batch["t"]), items, cosine, lcs, paraphrase)
            yield pa.record_batch([batch["id"].take(pa.array([t for t, _ in got], pa.int64())), pa.array([items.ids[i] for _, i in got], id_type), pa.array([v[1] for v in got.values()], pa.float64()), pa.array([v[0] for v in got.values()], pa.float64())], names=["id", "item", "cosine", "share"])

    return scan


def item_blocks(spark_rows: DataFrame, passages: int = BLOCK) -> Iterator[list[tuple]]:
    """The benchmark in blocks; only one is on the driver at a time."""
    held, n = [], 0
    for r in spark_rows.toLocalIterator():
        more = 1 + max(0, len((r.t or "").split()) - ITEM) // (ITEM // 2) + 1
        if held and n + more > passages:
            yield held
            held, n = [], 0
        held.append((r.item, r.t))
        n += more
    if held:
        yield held


def fitted(rows: DataFrame, block: list[tuple], seed: int = 7) -> Items | None:
    """The items with weights, latent space and projections, from the whole corpus."""
    items = Items.of(block)
    if not len(items.terms):
        return None
    counts = {r.term: r.n for r in rows.mapInArrow(lean(_frequencies(items.terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    df = np.zeros(len(items.terms))
    df[list(counts)] = list(counts.values())
    items.weight = np.log((1 + total) / (1 + df)) + 1
    items.index()
    parts = rows.mapInArrow(lean(_sketch(items.terms, items.weight, seed)), "term long, row binary")
    ground = _ground(len(items.terms), seed).astype(float)
    summed = parts.repartition(min(16, len(items.terms)), "term").mapInArrow(lean(_summed(ground.shape[1])), "term long, row binary")
    sketch = np.zeros(ground.shape)
    for r in summed.toLocalIterator():
        sketch[r.term] = np.frombuffer(r.row, "<f4")
    items.basis = latent_space(sketch, ground)
    latent = items.matrix() @ items.basis
    items.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return items


def latent_space(sketch: np.ndarray, ground: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of A (columns), from A'A R and R alone: an
    orthonormal basis Q of the sketch's columns, and the eigenvectors of Q'A'A Q, which is
    solved from Q'(A'A R) = (Q'A'A Q)(Q'R)."""
    basis, _ = np.linalg.qr(sketch)
    inner = np.linalg.lstsq((basis.T @ ground).T, (basis.T @ sketch).T, rcond=None)[0].T
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-value)[:rank]
    order = order[value[order] > 1e-9 * max(float(value.max(initial=0)), 1e-300)]
    return (basis @ vector[:, order]).astype(np.float32)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id=id_col, t=text_col).select("id", F.col("t").cast("string").alias("t"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = LEAST_COSINE, lcs: float = LEAST_LCS, paraphrase: float = PARAPHRASE_LCS) -> DataFrame:
    """One row for each match: doc_id, item_id, cosine (in the latent space), lcs_share (of the
    item's words; best of the document's passages).

    Texts are read whole; a null text has no words and matches nothing. Items of under
    ``LEAST_WORDS`` words (or null) match nothing. Rows that repeat an id are matched
    each, and items that repeat a text too. Other columns are not read; with an empty
    corpus or benchmark the result is empty.
    """
    rows, found = _rows(docs, id_col, text_col), None
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, cosine double, share double"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    for block in item_blocks(only(benchmark, item=item_col, t=item_text)):
        if items := fitted(rows, block):
            part = rows.mapInArrow(lean(_found(items, cosine, lcs, paraphrase, kind)), schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.toDF("doc_id", "item_id", "cosine", "lcs_share")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they were; nothing is shuffled."""
    rows = _rows(docs, docs.columns[0], text_col)
    cosine, lcs, paraphrase = (options.get(k, d) for k, d in (("cosine", LEAST_COSINE), ("lcs", LEAST_LCS), ("paraphrase", PARAPHRASE_LCS)))
    column = docs.columns.index(text_col)
    for block in item_blocks(only(benchmark, item=options.get("item_col", "item_id"), t=options.get("item_text", "text"))):
        if not (items := fitted(rows, block)):
            continue

        def scan(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                gone = {t for t, _ in matches(*buffers(batch.column(column)), items, cosine, lcs, paraphrase)}
                yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in gone], pa.int64()))

        docs = docs.mapInArrow(lean(scan), docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
