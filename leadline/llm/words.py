"""Words of whole texts as 64-bit hashes, straight from the UTF-8 bytes of Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z taken as a-z. Its hash is the sum modulo
2**64 of what a non-linear mix makes of each byte and its place in the word, taken from a running sum over all
bytes of a stretch of texts, then mixed with the length. (A polynomial modulo 2**64 gives some long words
one hash whatever its base is.) No text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time. A single word longer than this makes its own stretch.
STRETCH = 1 << 18

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED, _PLACE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only a stretch's worth is kept."""
    if n <= STRETCH:
        n = STRETCH
    if n in _powers:
        return _powers[n]

    def of(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        k = 1
        while k < n:
            out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        return out

    made = of(_BASE), of(_INVERSE)
    if n == STRETCH:
        _powers[n] = made
    return made


def hash_words(data: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte + 1, hash) of each word of concatenated texts that begin at the given places."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts_text[(starts_text > 0) & (starts_text < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    place = np.arange(n, dtype=np.int64)
    before = np.zeros(n, np.int64)
    before[s] = s
    place -= np.maximum.accumulate(before)
    total = np.cumsum(mix(_VALUES[data] ^ place.astype(np.uint64) * _PLACE))
    h = total[e]
    h[s > 0] -= total[s[s > 0] - 1]
    h = mix(h ^ (e - s + 1).astype(np.uint64) * _SEED)
    return s, e + 1, h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts) of a string column without nulls."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)), offsets


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, offsets): the word hashes of texts lo to hi - 1, text i's from offsets[i - lo] on."""
    data, offsets = text_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= STRETCH:
            hi += 1
        a, b = offsets[lo], offsets[hi]
        if b - a <= STRETCH:
            s, _, h = hash_words(data[a:b], offsets[lo:hi] - a)
            yield lo, hi, h, np.searchsorted(s, offsets[lo : hi + 1] - a)
        else:
            parts = [hash_words(data[x:y], np.zeros(1, np.int64))[2] for x, y in _stretches(data, a, b)]
            h = np.concatenate(parts)
            yield lo, hi, h, np.array([0, len(h)])
        lo = hi


def _stretches(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Cuts one long text at white space."""
    while b - a > STRETCH:
        end = a + STRETCH
        gaps = np.flatnonzero(_SPACE[data[a:end]])
        while not len(gaps) and end < b:
            a0, end = end, min(end + STRETCH, b)
            gaps = np.flatnonzero(_SPACE[data[a0:end]]) + (a0 - a)
        cut = a + int(gaps[-1]) + 1 if len(gaps) else b
        yield a, cut
        a = cut
    if a < b:
        yield a, b


def grams(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words in each text, and their offsets; a shorter text's words make one run."""
    count = np.diff(offsets)
    if len(h) >= size:
        out = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            out += h[k : len(h) - size + 1 + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        out = mix(out)
    else:
        out = np.empty(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(count)), n)
    at = offsets[text] + np.arange(to[-1]) - to[text]
    if len(short):
        got = np.empty(to[-1], np.uint64)
        full = count[text] >= size
        got[full] = out[at[full]]
        for d in short:
            own = h[offsets[d] : offsets[d + 1]]
            k = np.array([pow(_BASE, i + 1, 1 << 64) for i in range(len(own))], np.uint64)
            got[to[d]] = mix((own * k).sum(keepdims=True) + np.uint64(len(own)) * _SEED)[0]
        return got, to
    return out[at], to
