"""Pre-tokens of whole blocks of text in numpy, and the worker's cache of their encodings.

A byte-pair tokenizer encodes each pre-token by itself, so equal pre-tokens need one call of the library. Texts
are split by a vectorised form of the tokenizer's own pattern where that is certain to agree with it: all code
points are plain (Latin letters, digits, usual punctuation and white space), no contraction such as ``'s`` and no
special token's string occurs. Every other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core already

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from winnow.llm.textscan import mix, powers

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Pre-tokens whose encodings one worker keeps; beyond that it starts afresh.
MAX_CACHED = 1 << 19
_CONTRACTION = re.compile(r"'(?:[sdmt]|re|ve|ll)", re.IGNORECASE)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the first plane: kind, whether it is plain, and a random value."""
    kind = np.full(1 << 16, OTHER, dtype=np.uint8)
    plain = np.zeros(1 << 16, dtype=bool)
    for c in [*range(0x300), *range(0x2010, 0x2028), 0x20AC]:
        category = unicodedata.category(chr(c))[0]
        kind[c] = {"L": LETTER, "N": NUMBER}.get(category, OTHER)
        plain[c] = not 0x1C <= c <= 0x1F and c not in (0x85, 0xA0, 0x130)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    return kind, plain, mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Split:
    """The pre-tokens of the plain texts among ``texts``: ``start``, ``end`` in ``joined``, and ``doc``, a number in ``texts``."""

    def __init__(self, texts: list[str], spaced: bool):
        """spaced: white space belongs to pre-tokens (byte-level pattern); else texts are lower-cased and it is dropped."""
        kind, plain, _ = _tables()
        maybe = [i for i, t in enumerate(texts) if "<|" not in t and not ("'" in t and _CONTRACTION.search(t))]
        points = np.frombuffer("".join([texts[i] for i in maybe]).encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in maybe], dtype=np.int64)]).astype(np.int64)
        odd = np.flatnonzero(~plain[np.minimum(points, 0xFFFF)] | (points > 0xFFFF))
        if len(odd):
            bad = set(np.unique(np.searchsorted(at, odd, "right") - 1).tolist())
            maybe = [x for i, x in enumerate(maybe) if i not in bad]
        own = "".join([texts[i] for i in maybe])
        self.joined = own if spaced else own.lower()
        if len(odd) or not spaced:
            points = np.frombuffer(self.joined.encode("utf-32-le"), dtype=np.uint32)
            at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in maybe], dtype=np.int64)]).astype(np.int64)
        rest = set(maybe)
        self.others = [i for i in range(len(texts)) if i not in rest]
        n = len(points)
        k = kind[points]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        run = edge.copy()
        run[1:n] |= k[1:] != k[:-1]
        run[n] = True
        if spaced:
            first = run[:n].copy()
            inner = np.zeros(n, dtype=bool)  # a word begins here, after white space of its own text
            inner[1:] = run[1:n] & ~edge[1:n] & (k[1:] != SPACE) & (k[:-1] == SPACE)
            after = np.flatnonzero(inner)
            first[after - 1] = True  # the last white space stands alone or opens the word
            first[after[points[after - 1] == 32]] = False
            self.start = np.flatnonzero(first)
            self.end = np.append(self.start[1:], n) if len(self.start) else self.start
        else:
            run[:n] |= k == NUMBER
            run[1:] |= np.append(k[1:] == NUMBER, True) if n else False
            cut = np.flatnonzero(run)
            word = k[cut[:-1]] != SPACE if len(cut) else np.zeros(0, bool)
            self.start, self.end = cut[:-1][word], cut[1:][word]
        self.doc = np.array(maybe, dtype=np.int64)[np.searchsorted(at, self.start, "right") - 1] if len(self.start) else np.zeros(0, np.int64)
        self._points = points

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        value = _tables()[2][self._points[place + np.repeat(self.start, length)]] * powers(int(length.max()))[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Cache:
    """One worker's encodings: from the hash of a pre-token to a run of ids in a growing pool."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.size, self.begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in one array, and how many each has.

        The library takes a few microseconds a call, so many pre-tokens go into one text, joined so that its
        pattern parts them again: by a line feed, whose own ids are left out, or directly where each opens with a
        space. White space alone is encoded by itself.
        """
        opens = [self.spaced and w[0] == " " and not w.isspace() for w in words]
        alone = [self.spaced and w.isspace() for w in words]
        groups = [([i for i, x in enumerate(opens) if x], "", 1), ([i for i in range(len(words)) if not opens[i] and not alone[i]], "\n", 2 if self.spaced else 1)]
        sizes = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for members, joint, step in groups:
            for low in range(0, len(members), 4096):
                part = np.array(members[low : low + 4096])
                got = self.tokenizer.encode(joint.join([words[i] for i in part.tolist()]), add_special_tokens=False)
                number = np.array(got.word_ids, dtype=np.int64)
                own = number % step == 0
                number = number[own] // step
                sizes[part] = np.bincount(number, minlength=len(part))
                found.append((part[number], np.array(got.ids, dtype=np.uint32)[own]))
        for i, ids in zip([i for i, x in enumerate(alone) if x], self.encode([w for w, x in zip(words, alone, strict=True) if x]), strict=True):
            sizes[i] = len(ids)
            found.append((np.full(len(ids), i), np.array(ids, dtype=np.uint32)))
        if not found:
            return np.zeros(0, np.uint32), sizes
        of, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids[np.argsort(of, kind="stable")], sizes

    def _add(self, hashes: list[int], words: list[str]) -> None:
        ids, sizes = self.encode_words(words)
        n, m = len(self.known), len(words)
        while n + m > len(self.size):
            self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + m], self.begin[n : n + m] = sizes, self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(hashes, range(n, n + m), strict=True))
        self.used += len(ids)

    def entries(self, split: Split, hashes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The entry of each pre-token in ``which``, encoding those that this worker hasn't met."""
        unique, at, back = np.unique(hashes[which], return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MAX_CACHED:
            self._clear()
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            places = which[at[new]]
            self._add([keys[i] for i in new], [split.joined[a:b] for a, b in zip(split.start[places].tolist(), split.end[places].tolist(), strict=True)])
        known = self.known
        return np.fromiter((known[h] for h in keys), np.int64, len(keys))[back]


@lru_cache(maxsize=4)
def cache(path: str, spaced: bool) -> Cache:
    """This worker's cache for a tokenizer file; it outlives the task, as the worker does."""
    return Cache(path, spaced)


def encode_texts(texts: list[str], own: Cache) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts in one array, and the offsets of each text."""
    split = Split(texts, own.spaced)
    entry = own.entries(split, split.hashes(), np.arange(len(split.start)))
    size = own.size[entry].astype(np.int64)
    total = np.zeros(len(texts), np.int64)
    np.add.at(total, split.doc, size)
    others = own.encode([texts[i] for i in split.others])
    for i, ids in zip(split.others, others, strict=True):
        total[i] = len(ids)
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(at[-1]), np.uint32)
    begin = np.cumsum(size) - size
    ids = own.pool[np.arange(int(size.sum())) - np.repeat(begin - own.begin[entry], size)]
    plain = np.ones(len(texts), bool)
    plain[split.others] = False
    out[np.repeat(plain, total)] = ids  # texts keep their order, and so do their pre-tokens
    for i, more in zip(split.others, others, strict=True):
        out[at[i] : at[i + 1]] = more
    return out, at


def strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()
