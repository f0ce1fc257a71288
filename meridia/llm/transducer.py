"""A byte-pair vocabulary compiled into a deterministic transducer.

The merges are turned into a relation on tokens first: two tokens may stand side by side
if no merge across their border comes before the merges that make them (``Pairs``). The
tokens of a prefix of a word end in exactly one token that may follow those of a shorter
prefix, so reading a byte is a step of a deterministic machine. Its states are prefixes
of words, each with its last token and its number of tokens; a transition's count is the
tokens that its byte adds to (or takes back from) the prefix, and a word's end has a
transition of its own, since there the last byte carries the end-of-word mark. States are
made when a word first needs them, and all are dropped when there are ``max_states``.

``Words`` reads whole pieces of text at once: it finds the words, and sends each word
that it has not met lately through the transducer. Words stand for 64-bit hashes there.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .bytescan import _LOWER, prefix_hash, span_hash

VOCABULARY = "word_bpe_49k.json"
#: The word pattern that the splitter is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER, LONG = 1 << 60, 64


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pairs:
    """Which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), k)
            self.made.setdefault(whole, (left, right, k))
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.known: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at its left (0) or right (1) border, smallest first, each
        with the rank of the merge that uses it up."""
        found = self.spines.get((token, side))
        if found is None:
            found, used = [(token, NEVER)], token
            while used in self.made:
                parts = self.made[used]
                found.append((parts[side], parts[2]))
                used = parts[side]
            found.reverse()
            self.spines[token, side] = found
        return found

    def allowed(self, a: int, b: int) -> bool:
        key = a << 32 | b
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 300_000:
                self.known.clear()
            out = self.known[key] = self._allowed(self.spine(a, 1), self.spine(b, 0))
        return out

    def _allowed(self, left: list, right: list) -> bool:
        """Goes through the merges at both borders in their order. A merge across is first
        if its rank is lower; at equal ranks the leftmost pair goes first."""
        i = j = 0
        while True:
            (a, used_a), (b, used_b) = left[i], right[j]
            across = self.rank.get((a, b), NEVER)
            if across < used_a and across <= used_b and across < NEVER:
                return False
            if used_a == used_b == NEVER:
                return True
            if used_a <= used_b:
                i += 1
            else:
                j += 1


class Transducer:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, max_states: int = 300_000):
        self.pairs, self.max_states = Pairs(vocab, merges), max_states
        number = byte_characters()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for text, token in vocab.items():
            end = text.endswith(suffix)
            body = text.removesuffix(suffix) if end else text
            if (len(body) == 1 or token in self.pairs.made) and all(c in number for c in body):
                (self.final if end else self.inner)[bytes(number[c] for c in body)] = token
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.clear()

    def clear(self) -> None:
        """Only the start state, 0, the empty prefix."""
        self.next: dict[int, int] = {}
        self.token, self.back, self.tokens = [-1], [0], [0]

    def _last(self, word: bytes, path: list[int], stop: int, known: dict[bytes, int]) -> tuple[int, int]:
        """(token, state before it) of the one token that can end word[:stop]."""
        for start in range(stop - 1, max(-1, stop - self.longest - 1), -1):
            token = known.get(word[start:stop])
            if token is not None and (start == 0 or self.pairs.allowed(self.token[path[start]], token)):
                return token, path[start]
        raise ValueError(f"no token ends {word[:stop]!r}")

    def ids(self, word: bytes) -> list[int]:
        """The tokens of a word, read byte by byte; the last byte takes the transition of a word's end."""
        if len(self.token) > self.max_states:
            self.clear()
        state, path, held = 0, [0], len(self.token)
        for k in range(len(word) - 1):
            key = state << 8 | word[k]
            state = self.next.get(key, -1)
            if state < 0:
                token, back = self._last(word, path, k + 1, self.inner)
                state = len(self.token)
                self.token.append(token)
                self.back.append(back)
                self.tokens.append(self.tokens[back] + 1)
                if len(word) <= LONG:  # a longer word's states are dropped after it
                    self.next[key] = state
            path.append(state)
        token, state = self._last(word, path, len(word), self.final)
        out = [token]
        while state:
            out.append(self.token[state])
            state = self.back[state]
        if len(word) > LONG:
            del self.token[held:], self.back[held:], self.tokens[held:]
        return out[::-1]

    def emitted(self, state: int, byte: int) -> int:
        """The count on the transition from a state by a byte."""
        return self.tokens[self.next[state << 8 | byte]] - self.tokens[state]


# Classes of the characters of Latin-1 (in UTF-8): space, letter, number, other sign.
SPACE, LETTER, NUMBER, SIGN = range(4)


def _latin() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and classes and lower cases of the second bytes after C2 and C3."""
    kind = lambda c: SPACE if c in "\t\n\v\f\r \x85\xa0" else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SIGN
    one = np.array([kind(chr(b)) if b < 128 else SIGN for b in range(256)], np.int8)
    two = np.array([[kind(chr(lead * 64 + b)) for b in range(64)] for lead in (2, 3)], np.int8)
    small = np.array([[ord(chr(lead * 64 + b).lower()) & 63 | 128 if ord(chr(lead * 64 + b).lower()) < 256 else b | 128 for b in range(64)] for lead in (2, 3)], np.uint8)
    return one, two, small


_ONE, _TWO, _SMALL = _latin()


def split(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, stops) of all words of texts with characters of Latin-1
    alone; those of other texts are left out."""
    n = len(raw)
    low, kind = _LOWER[raw], _ONE[raw]
    begin = np.ones(n, bool)
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        other = raw[lead] > 0xC3
        far = np.unique(np.searchsorted(at, lead[other], "right") - 1)
        lead = lead[~other]
        tail = raw[lead + 1] & 63
        kind[lead] = kind[lead + 1] = _TWO[raw[lead] - 0xC2, tail]
        low[lead + 1] = _SMALL[raw[lead] - 0xC2, tail]
        begin[lead + 1] = False
        for t in far.tolist():
            kind[at[t] : at[t + 1]] = SPACE
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.append(np.int8(SPACE), kind[:-1])
    start = begin & (kind != SPACE) & ((kind != before) | (kind == NUMBER) | edge[:-1])
    quotes = np.flatnonzero(start & (raw == 39))
    if len(quotes):
        wide = np.append(low, np.zeros(3, np.uint8))
        limit = at[np.searchsorted(at, quotes, "right")]
        a, b = wide[quotes + 1], wide[quotes + 2]
        two = (quotes + 2 <= limit) & np.isin(a, list(b"stmd"))
        three = (quotes + 3 <= limit) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        size = np.where(two, 2, 3)[two | three]
        quotes, limit = quotes[two | three], limit[two | three]
        start[quotes + 1] = False
        after = quotes + size
        after = after[after < limit]
        start[after[kind[after] == LETTER]] = True
    solid = np.append(kind, np.int8(SPACE)) != SPACE
    fresh = np.append(start, True) | edge
    starts = np.flatnonzero(start)
    return low, starts, np.flatnonzero(solid[:-1] & (~solid[1:] | fresh[1:])) + 1


class Words:
    """Token ids of whole texts; ``met`` keeps those of up to ``max_words`` words."""

    def __init__(self, spec: dict, max_words: int = 600_000):
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        model = spec["model"]
        if steps != ["NFC", "Replace", "Lowercase"] or len(cut) != 1 or model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("this compiler is for a word-end BPE with lower-casing")
        if cut[0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("this vocabulary splits words by another pattern")
        self.transducer = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
        self.marks = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.narrow = max([*model["vocab"].values(), *self.special.values()]) < 1 << 16
        self.kind = np.uint16 if self.narrow else np.uint32
        self.splitter, self.max_words = regex.compile(PATTERN), max_words
        self.forget()

    def forget(self) -> None:
        self.hashes, self.sizes, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each: list = [None] * len(words)
        for k in sorted(range(len(words)), key=words.__getitem__):  # neighbours share states
            each[k] = self.transducer.ids(words[k])
        sizes = np.array([len(x) for x in each], np.int32)
        begins = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(max(len(self.pool), 2 * total), self.kind))
        self.pool[self.used : self.used + total] = [i for x in each for i in x]
        self.used += total
        return sizes, begins

    def _met(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each word its place in ``sizes`` and ``begins``."""
        hashes, first, back = np.unique(span_hash(prefix_hash(low), starts, stops), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > self.max_words:
            self.forget()
        place = np.searchsorted(self.hashes, hashes)
        new = np.append(self.hashes, np.uint64(0))[place] != hashes
        new |= place == len(self.hashes)
        if new.any():
            sizes, begins = self._learn([low[starts[k] : stops[k]].tobytes() for k in first[new].tolist()])
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
            self.sizes = np.insert(self.sizes, place[new], sizes)
            self.begins = np.insert(self.begins, place[new], begins)
            place = np.searchsorted(self.hashes, hashes)
        return place[back]

    def _words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts without special strings, and each text's first word (one entry more)."""
        low, starts, stops = split(raw, at)
        text = np.searchsorted(at, starts, "right") - 1
        far = np.unique(np.searchsorted(at, np.flatnonzero(raw > 0xC3), "right") - 1).tolist()
        if far:
            # Lower-casing goes character by character in the library: no final sigma.
            found = [[w.encode() for w in self.splitter.findall(unicodedata.normalize("NFC", raw[at[t] : at[t + 1]].tobytes().decode()).replace("Σ", "σ").lower())] for t in far]
            size = np.array([len(w) for x in found for w in x], np.int64)
            stop = len(low) + np.cumsum(size)
            starts, stops = np.concatenate([starts, stop - size]), np.concatenate([stops, stop])
            text = np.concatenate([text, np.repeat(far, [len(x) for x in found])])
            order = np.argsort(text, kind="stable")
            low = np.append(low, np.frombuffer(b"".join(w for x in found for w in x), np.uint8))
            starts, stops, text = starts[order], stops[order], text[order]
        return self._met(low, starts, stops), np.searchsorted(text, np.arange(len(at)))

    def tokens(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one entry more)."""
        if not self._special(raw):
            return self._plain(raw, at)
        # Texts are cut at special strings first, each of which is a transition of its own.
        body = raw.tobytes()
        parts = [self.marks.split(body[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        plain = [p for x in parts for p in x[::2]]
        flat, edge = self._plain(np.frombuffer(b"".join(plain), np.uint8), np.append(0, np.cumsum([len(p) for p in plain])))
        out, stops, k = [np.zeros(0, self.kind)], [0], 0
        for x in parts:
            for j, part in enumerate(x):
                out.append(np.array([self.special[part]], self.kind) if j % 2 else flat[edge[k] : edge[k + 1]])
                k += 1 - j % 2
            stops.append(len(out) - 1)
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out[1:]]))[stops]

    def counts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many tokens each text has."""
        if self._special(raw):
            return np.diff(self.tokens(raw, at)[1])
        words, first = self._words(raw, at)
        return np.diff(np.append(0, np.cumsum(self.sizes[words], dtype=np.int64))[first])

    def _special(self, raw: np.ndarray) -> bool:
        return self.marks is not None and self.marks.search(raw.tobytes()) is not None

    def _plain(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, first = self._words(raw, at)
        sizes = self.sizes[words].astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        flat = self.pool[np.arange(int(ends[-1])) + np.repeat(self.begins[words] - ends[:-1], sizes)]
        return flat, ends[first]

    def ids(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.tokens(raw, np.array([0, len(raw)]))[0]

    def count(self, text: str) -> int:
        raw = np.frombuffer(text.encode(), np.uint8)
        return int(self.counts(raw, np.array([0, len(raw)]))[0])


@lru_cache(maxsize=4)
def compiled(name: str = VOCABULARY) -> Words:
    """The transducer of a vocabulary, once for each Python worker. ``name`` is a path, or
    a file of the installed ``public_tokenizers``."""
    if "/" not in name:
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    with open(name, encoding="utf-8") as file:
        return Words(json.load(file))
