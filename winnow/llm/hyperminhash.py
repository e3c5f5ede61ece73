"""HyperMinHash sketches of shingle sets: per bucket the leading zeros of the smallest hash and some mantissa bits.

Each bucket hashes the whole set by a function of its own. (Splitting one hash over the buckets would leave most of
them empty for short texts, and equal empty buckets say nothing.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from winnow.llm.textscan import BLANK_SEPARATED, Words, gram_hashes, mix

SHINGLE = 5
#: Buckets: BANDS bands of ROWS. At a similarity of 0.75 a pair shares no band with probability (1 - 0.75**5)**51, 1e-6.
ROWS, BANDS = 5, 51
BUCKETS = ROWS * BANDS
MANTISSA = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)
_constants = mix((np.arange(2 * BUCKETS, dtype=np.uint64) + np.uint64(77)) * _STEP)
_FLIP = (_constants[:BUCKETS] >> np.uint64(32)).astype(np.uint32)
_FACTOR = (_constants[BUCKETS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted: runs of SHINGLE words, or all words if there are fewer."""
    words = Words(column, BLANK_SEPARATED)
    hashes = words.hashes()
    grams = gram_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        short = b - a < SHINGLE
        out.append(gram_hashes(hashes[a:b], b - a) if short and b > a else np.unique(grams[a : b - SHINGLE + 1]) if b > a else hashes[:0])
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: equal for equal sets."""
    a, b = mix(shingles + _STEP).sum(dtype=np.uint64), mix(shingles ^ _STEP).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: leading zeros and mantissa of each bucket's smallest 32-bit hash."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 64):  # a table of 64 hashes by all buckets stays in the cache
        table = x[low : low + 64, None] ^ _FLIP
        table *= _FACTOR
        np.minimum(least, table.min(axis=0), out=least)
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    mantissa = ((least.astype(np.uint64) << zeros.astype(np.uint64)) >> np.uint64(31 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; texts that agree in all registers of a band share its key."""
    bands = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, bands.shape[:2])
    for i in range(ROWS):
        key = mix(key + bands[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers in which disjoint sets of these sizes agree by chance."""
    level = 0.5 ** np.arange(34)
    at_level = lambda size: (1 - level[1:]) ** size[:, None] - (1 - level[:-1]) ** size[:, None]
    return (at_level(n.astype(float)) * at_level(m.astype(float))).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of sketches, corrected for chance matches."""
    chance = chance_matches(n, m)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
