"""Ids of many texts at once, straight from the UTF-8 bytes of Arrow columns.

Texts are cut where the published byte-level pattern always ends a piece: before white space that follows another
character, after white space other than a space that stands alone, and between a letter and a mark such as a
full stop. Whatever the cuts leave, pieces never go over them, so units are encoded one by one, each once. A unit of
up to 16 bytes is two numbers, looked up in a table of arrays; only units that the table lacks are looked at
singly. Which bytes stand before a cut is read from tables of byte pairs; where these leave a doubt, there is no cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa

from leadline.llm.bpe import TABLE_BYTES, merges, spans_of_special
from leadline.llm.units import UnitIds, pairs_of, stretches, unit_bytes
from leadline.llm.words import text_bytes

#: Bytes of a short unit; bytes of texts taken together; slots of a table, and units from which on another takes its place.
SHORT, TOGETHER, SLOTS, MOST = 16, 1 << 20, 1 << 21, 1 << 20
#: Low bits of a place that say how many ids a unit has, at most one a byte of what is taken together.
COUNT_BITS = 24
COUNT = (1 << COUNT_BITS) - 1

_SPACES, _MARKS, _DIGITS = b" \t\n\r\x0b\x0c", b".,;:!?", b"0123456789"
#: Bytes before which a piece surely begins, if what is before is a letter.
STARTS = _SPACES + _MARKS
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: Letters of two bytes, of old, in any Unicode version.
_LETTERS_2 = [chr(c).encode() for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x400, 0x481), (0x48A, 0x52F)) for c in range(a, b + 1)]


def _bytes(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*of]] = True
    return out


_SPACE, _LETTER, _DIGIT = _bytes(_SPACES), _bytes(_LETTERS), _bytes(_DIGITS)
_KIND = _SPACE + 2 * _bytes(_MARKS).astype(np.uint8)
#: Whether two bytes are a letter of two bytes.
_TWO = np.zeros((256, 256), bool)
_TWO[tuple(np.array([[*x] for x in _LETTERS_2]).T)] = True
#: By kind less 1 and the two bytes before: a cut before white space (1) is after what is surely none, before a mark (2) after a letter.
_CUT = np.zeros((2, 256, 256), bool)
_CUT[0] = True
_CUT[0][:, [*_SPACES, 0x1C, 0x1D, 0x1E, 0x1F]] = False
for _c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)):
    _CUT[0][tuple(_c.encode()[-2:])] = False
_CUT[1] = _TWO | _LETTER
_CUT = _CUT.reshape(2, -1)
#: Bytes that surely begin no white space.
_SOLID = ~_bytes(_SPACES + b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def cuts(data: np.ndarray, n: int) -> np.ndarray:
    """Places in the first n bytes where a piece surely begins; at least two zero bytes follow these."""
    kind = _KIND[data[:n]]
    at = np.flatnonzero(kind)
    kind = kind[at] - 1
    sure = _CUT[kind, data[at - 2].astype(np.int64) << 8 | data[at - 1]]
    at, kind = at[sure], kind[sure]
    alone = at[(kind == 0) & (data[at] != 32)] + 1
    return np.concatenate([at, alone[_SOLID[data[alone]]]])


def cut_units(raw: bytes, at: np.ndarray, never: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Where units of texts begin, their bytes, whether they are long, and the two numbers of short ones.

    The texts begin at the given places, the last of which is the end. There is no cut before a byte that ``never`` has.
    """
    n, data = len(raw), np.frombuffer(raw + bytes(SHORT), np.uint8)
    mark = np.zeros(n + 1, bool)
    places = cuts(data, n)
    mark[places if never is None else places[~never[data[places]]]] = True
    mark[at] = True
    start = np.flatnonzero(mark[:n])
    size = np.diff(start, append=n)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = words[start] & _LOW_BYTES[np.minimum(size, 8)]
    high = words[start + 8 * (size > 8)] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
    long = size > SHORT
    if b"\0" in raw:
        long[np.searchsorted(start, np.flatnonzero(data[:n] == 0), "right") - 1] = True
    return start, size, long, low, high


def different(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones among short units, and which of these each is."""
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    first = np.ones(len(order), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return low[first], high[first], of


class Shelf:
    """Ids of short units by open addressing: a unit's bytes are two numbers, the first never 0."""

    def __init__(self):
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        #: A unit's place among the ids and, in the low bits, how many.
        self.where = np.zeros(SLOTS, np.int64)
        self.ids, self.used, self.n = np.empty(1 << 16, np.uint32), 0, 0

    @staticmethod
    def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (low >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(43)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each unit's place and number of ids, 0 where it is absent."""
        slot = self._slots(low, high)
        own = self.low[slot]
        same = (own == low) & (self.high[slot] == high)
        out = np.where(same, self.where[slot], 0)
        rest = np.flatnonzero(~same & (own != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) % SLOTS
            own = self.low[slot]
            same = (own == low[rest]) & (self.high[slot] == high[rest])
            out[rest[same]] = self.where[slot[same]]
            on = ~same & (own != 0)
            rest, slot = rest[on], slot[on]
        return out

    def room(self, ids: np.ndarray) -> int:
        """Puts ids behind those in use, where the next ones go over them, and gives their place."""
        if (end := self.used + len(ids)) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(end, len(self.ids)), np.uint32)])
        self.ids[self.used : end] = ids
        return self.used

    def put(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keeps different units that are absent, with their ids one after another; gives what ``find`` will."""
        where = (self.room(ids) + np.cumsum(counts) - counts) << COUNT_BITS | counts
        self.used += len(ids)
        self.n += len(low)
        rest, slot = np.arange(len(low)), self._slots(low, high)
        while len(rest):
            free = np.flatnonzero(self.low[slot] == 0)
            # of units that want one slot the last one written has it
            self.where[slot[free]] = free
            own = free[self.where[slot[free]] == free]
            k, s = rest[own], slot[own]
            self.low[s], self.high[s], self.where[s] = low[k], high[k], where[k]
            on = np.ones(len(rest), bool)
            on[own] = False
            rest, slot = rest[on], (slot[on] + 1) % SLOTS
        return where


def taken(source: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units one after another, and where each unit's end."""
    counts = where & COUNT
    ends = np.cumsum(counts)
    return source[np.repeat((where >> COUNT_BITS) - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def shared_texts(path: str) -> TextIds:
    """This process's table, which its next task finds as the last one has left it."""
    return TextIds(path)


class TextIds:
    """Ids of texts as unsigned 32-bit numbers; those of units are kept, in two tables of which a full one takes the other's place."""

    def __init__(self, path: str, most: int = MOST):
        self.path, self.most, self.special = path, most, merges(path).special
        self.kept, self.before = Shelf(), None
        self.long: dict[bytes, bytes] = {}
        self.units = UnitIds(path)

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column, special strings counted."""
        data, offsets = text_bytes(column)
        special = [s.encode() for s in self.special]
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOGETHER, "right")) - 1)
            raw, at = data[offsets[lo] : offsets[hi]].tobytes(), offsets[lo : hi + 1] - offsets[lo]
            if any(s in raw for s in special):
                cut = [[*spans_of_special(raw[a:b].decode(), self.special)] for a, b in pairwise(at.tolist())]
                plain = [x.encode() for spans in cut for x, is_special in spans if not is_special]
                got = iter(self._together(b"".join(plain), np.cumsum([0, *map(len, plain)]))) if len(raw) <= TOGETHER else map(self._plain, plain)
                for spans in cut:
                    yield b"".join([np.array([self.special[x]], np.uint32).tobytes() if is_special else next(got) for x, is_special in spans])
            elif len(raw) > TOGETHER:
                yield self._plain(raw)
            else:
                yield from self._together(raw, at)
            lo = hi

    def _plain(self, raw: bytes) -> bytes:
        """Ids of one text, however long, in which no special string counts."""
        if len(raw) <= TOGETHER:
            return self._together(raw, np.array([0, len(raw)]))[0]
        return b"".join(self._plain(x) if len(x := s.encode()) <= TOGETHER else self.units.text(s) for s in stretches(raw.decode()))

    def _together(self, raw: bytes, at: np.ndarray) -> list[bytes]:
        """Ids of each of several texts, which begin at the given places and don't end in the midst of a character."""
        if self.kept.n > self.most:
            self.kept, self.before = Shelf(), self.kept
        if len(self.long) > self.most // 4:
            self.long = {}
        start, size, long, low, high = cut_units(raw, at)
        where = np.empty(len(start), np.int64)
        short = ~long
        where[short] = self._short(low[short], high[short])
        if long.any():
            where[long] = self._long([raw[a : a + k] for a, k in zip(start[long].tolist(), size[long].tolist(), strict=True)])
        ids, ends = taken(self.kept.ids, where)
        to = np.concatenate([[0], ends])[np.searchsorted(start, at)] * 4
        out = ids.tobytes()
        return [out[a:b] for a, b in pairwise(to.tolist())]

    def _short(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of short units' ids in the present table, which learns those that it lacks."""
        where = self.kept.find(low, high)
        if not len(new := np.flatnonzero(where == 0)):
            return where
        low, high, of = different(low[new], high[new])
        old = self.before.find(low, high) if self.before else np.zeros(len(low), np.int64)
        put = np.empty(len(low), np.int64)
        if (was := old > 0).any():
            put[was] = self.kept.put(low[was], high[was], old[was] & COUNT, taken(self.before.ids, old[was])[0])
        if not was.all():
            put[~was] = self.kept.put(low[~was], high[~was], *fresh(self.path, low[~was], high[~was]))
        where[new] = put[of]
        return where

    def _long(self, units: list[bytes]) -> np.ndarray:
        """Places of long units' ids, which lie behind the table's until it learns more; counts take more bits."""
        lacking = [*{u for u in units if u not in self.long}]
        got = dict(zip(lacking, unit_bytes(self.path, [u.decode() for u in lacking]), strict=True))
        self.long.update((u, x) for u, x in got.items() if len(u) <= TABLE_BYTES)
        found = [self.long[u] if u in self.long else got[u] for u in units]
        counts = np.array([*map(len, found)], np.int64) // 4
        return self.kept.room(np.frombuffer(b"".join(found), np.uint32)) + np.cumsum(counts) - counts << COUNT_BITS | counts


def fresh(path: str, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each short unit has, and the ids one after another."""
    chars = np.stack([low, high], 1).astype("<u8").view(np.uint8)
    size = (chars != 0).sum(1)
    two = np.zeros(chars.shape, bool)
    two[:, :-1] = _TWO[chars[:, :-1], chars[:, 1:]]
    two[:, 1:] |= two[:, :-1]
    own = chars.copy()
    own[own[:, 0] == 32, 0] = 0
    none = own == 0
    one = (_LETTER[own] | two | none).all(1) | (_DIGIT[own] | none).all(1)
    counts, ids = np.empty(len(chars), np.int64), np.zeros(chars.shape, np.uint32)
    counts[one], ids[one] = pairs_of(path).merged_short(chars[one], size[one])
    if not one.all():
        other = np.flatnonzero(~one)
        got = unit_bytes(path, [x[:k].tobytes().decode() for x, k in zip(chars[other], size[other].tolist(), strict=True)])
        for k, x in zip(other.tolist(), got, strict=True):
            counts[k] = len(x) // 4
            ids[k, : counts[k]] = np.frombuffer(x, np.uint32)
    return counts, ids[np.arange(SHORT) < counts[:, None]]


def unit_ids(path: str, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each unit has, and the ids one after another."""
    short = np.array([len(u) <= SHORT and 0 not in u for u in units], bool)
    rows = np.frombuffer(b"".join([u.ljust(SHORT, b"\0") for u in compress(units, short.tolist())]), "<u8").reshape(-1, 2)
    others = unit_bytes(path, [u.decode() for u in compress(units, (~short).tolist())])
    counts = np.empty(len(units), np.int64)
    counts[short], ids = fresh(path, rows[:, 0], rows[:, 1])
    counts[~short] = [len(x) // 4 for x in others]
    out, own = np.empty(counts.sum(), np.uint32), np.repeat(short, counts)
    out[own], out[~own] = ids, np.frombuffer(b"".join(others), np.uint32)
    return counts, out
