"""Texts in units that tokenizers never join: a run of spaces with what follows up to the next one.

A piece of the published byte-level pattern never goes over the border between a character that is not
white space and a space, and neither does a merge of a vocabulary none of whose entries has a space after
another character. So units are tokenised one by one, each once, by the tokenizers' own libraries, and looked
up afterwards. A part is a unit without its first space.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from leadline.llm.bpe import TABLE_BYTES, TABLE_PIECES, Encoder, closed_windows, merges, pattern_for

#: Characters of a text handled at a time.
WINDOW = 1 << 16
#: From so many units on, plain words among them are merged together; texts are taken together up to so many characters.
MANY, TOGETHER = 1000, 1 << 21
#: Characters of a word that is merged with others; words in a block of short ones.
WORD_CHARS, BLOCK = 40, 1 << 14

_BORDER = regex.compile(r"(?r)\S(?= \S)")
#: White space that a cut before each space would take from more white space, or from the end.
_ODD = re.compile(r"[^\S ] (?!\S)")
_CUT = re.compile(r"(?<=\S)(?= )")
#: One piece of the published pattern in any Unicode version, and perhaps a second one of marks.
_WORD = re.compile(r"( [A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ]+)([.,;:!?]*)")


def stretches(text: str) -> Iterator[str]:
    """The text cut at borders of units, a window at a time; longer where a window has no border."""
    at, n = 0, len(text)
    while n - at > WINDOW:
        end, to = None, at + WINDOW
        while end is None and to < n:
            m = _BORDER.search(text, max(at, to - WINDOW - 2), to)
            end, to = (m.end() if m and m.end() > at else None), to + WINDOW
        if end is None:
            break
        yield text[at:end]
        at = end
    if at < n:
        yield text[at:]


def parts(stretch: str) -> list[str]:
    """The parts of a stretch that begins with a space."""
    if "  " not in stretch and not _ODD.search(stretch):
        return stretch[1:].split(" ")
    return [u[1:] for u in _CUT.split(stretch)]


def split_first(stretch: str) -> tuple[str, str]:
    """A stretch's first unit if no space begins it, else nothing, and the rest."""
    if not stretch or stretch[0] == " ":
        return "", stretch
    cut = _CUT.search(stretch)
    return (stretch[: cut.end()], stretch[cut.end() :]) if cut else (stretch, "")


@lru_cache(maxsize=4)
def plain_tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer, on one thread, with special strings taken as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


def long_ids(path: str, unit: str) -> Iterator[list[int]]:
    """Ids of a unit longer than a window, in parts: whole pieces, and one that never closes through the transducer."""
    encoder = Encoder(merges(path))
    for got in closed_windows(unit, pattern_for(unit)):
        if isinstance(got, list):
            yield [i for piece in got for i in encoder.whole(piece.encode())]
        else:
            yield [*encoder._feed(got.encode())] if got else encoder._end()


@lru_cache(maxsize=4)
def _lengths(path: str) -> np.ndarray:
    """Each id's length in bytes."""
    of = merges(path).bytes_of
    out = np.zeros(max(of) + 1, np.int64)
    out[[*of]] = [*map(len, of.values())]
    return out


def _of_one(path: str, units: list[str]) -> list[list[int]] | None:
    """Ids of units none of which ends in white space, encoded as one text; none if tokens don't end where units do."""
    text = "".join(units)
    ids = plain_tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids
    ends = np.cumsum(_lengths(path)[ids])
    own = np.cumsum([*map(len, units if text.isascii() else map(str.encode, units))])
    at = np.searchsorted(ends, own)
    if not len(ends) or ends[-1] != own[-1] or (ends[at] != own).any():
        return None
    at = (at + 1).tolist()
    return [ids[a:b] for a, b in zip([0, *at], at, strict=False)]


class Pairs:
    """The rank of pairs of ids, by two tables of hashes of which one surely has a pair."""

    NONE = 1 << 30

    def __init__(self, path: str):
        m = merges(path)
        a, b, self.made = np.array(m.pairs, np.int64).reshape(-1, 3).T
        keys, ranks = (a << 24 | b).astype(np.uint64), np.arange(len(a))
        self.tables, tries = [], iter(np.random.default_rng(1).integers(1 << 62, 1 << 63, 1000, dtype=np.uint64) | np.uint64(1))
        while len(keys) or len(self.tables) < 2:
            times = next(tries)
            slot = keys * times >> np.uint64(44)
            own, rank = np.full(1 << 20, np.uint64(1 << 63)), np.full(1 << 20, self.NONE)
            first = np.unique(slot, return_index=True)[1]
            own[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((times, own, rank))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks = keys[rest], ranks[rest]
        self.of_byte = np.array(m.of_byte)
        self.of_bytes = self.ranks(*np.meshgrid(self.of_byte, self.of_byte, indexing="ij"))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, out = (a << 24 | b).astype(np.uint64), None
        for times, own, rank in self.tables:
            slot = keys * times >> np.uint64(44)
            got = np.where(own[slot] == keys, rank[slot], self.NONE)
            out = got if out is None else np.minimum(out, got)
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each one piece: words of a length lose a symbol each in every round, or are done."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            ids = self.of_byte[np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8).reshape(-1, n)]
            ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                best = ranks.argmin(1) if ranks.shape[1] else None
                rank = ranks[np.arange(len(rows)), best] if best is not None else np.full(len(rows), self.NONE)
                done = rank == self.NONE
                if done.any():
                    data, size = ids[done].astype(np.uint32).tobytes(), 4 * ids.shape[1]
                    for k, i in zip(rows[done].tolist(), range(0, len(data), size), strict=True):
                        out[k] = data[i : i + size]
                    if done.all():
                        break
                    rows, ids, ranks, best, rank = (x[~done] for x in (rows, ids, ranks, best, rank))
                at, width = np.arange(len(rows)), ids.shape[1] - 1
                places = np.arange(width)
                ids[at, best] = self.made[rank]
                ids = np.take_along_axis(ids, places + (places > best[:, None]), 1)
                ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= best[:, None]), 1)
                for has, shift in ((best > 0, -1), (best < width - 1, 0)):
                    r, c = at[has], best[has] + shift
                    ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        return out

    def merged_short(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids words have, each one piece in a row filled up with zeros, and rows of these ids.

        A word's column has its symbols, and for each the rank of its pair with the next one; every round merges each
        word's first pair of the least rank, whose right symbol goes out of a chain of the others.
        """
        n, width = words.shape
        if n > BLOCK:
            got = [self.merged_short(words[k : k + BLOCK], sizes[k : k + BLOCK]) for k in range(0, n, BLOCK)]
            return np.concatenate([c for c, _ in got]), np.concatenate([x for _, x in got])
        ids = np.ascontiguousarray(self.of_byte[words].T)
        live = np.arange(width)[:, None] < sizes
        ranks = np.full((width, n), self.NONE)
        pair = live[1:]
        ranks[:-1][pair] = self.of_bytes[words.T[:-1][pair], words.T[1:][pair]]
        after, before = (np.repeat(np.arange(width)[:, None] + k, n, 1) for k in (1, -1))
        sizes, w = sizes.copy(), np.arange(n)
        while len(w):
            own = ranks[:, w]
            at = own.argmin(0)
            rank = own[at, np.arange(len(w))]
            on = rank < self.NONE
            w, at, rank = w[on], at[on], rank[on]
            gone = after[at, w]
            ids[at, w], live[gone, w], ranks[gone, w] = self.made[rank], False, self.NONE
            sizes[w] -= 1
            next_, last = after[gone, w], before[at, w]
            after[at, w] = next_
            ranks[at, w] = self.NONE
            has = np.flatnonzero(next_ < width)
            has = has[live[next_[has], w[has]]]
            r, c, b = at[has], w[has], next_[has]
            before[b, c] = r
            ranks[r, c] = self.ranks(ids[r, c], ids[b, c])
            has = np.flatnonzero(last >= 0)
            r, c, b = last[has], w[has], at[has]
            ranks[r, c] = self.ranks(ids[r, c], ids[b, c])
        out = np.zeros((n, width), np.uint32)
        out[np.arange(width) < sizes[:, None]] = ids.T[live.T]
        return sizes, out


@lru_cache(maxsize=2)
def pairs_of(path: str) -> Pairs:
    return Pairs(path)


def unit_bytes(path: str, units: list[str]) -> list[bytes]:
    """Ids of each unit as unsigned 32-bit numbers; of many units, plain words are merged together."""
    if len(units) < MANY:
        return [array("I", ids).tobytes() for ids in _by_library(path, units)]
    out: list = [None] * len(units)
    at, words, tails, other = [], [], [], []
    for k, u in enumerate(units):
        if len(u) <= WORD_CHARS and (m := _WORD.fullmatch(u)):
            word, tail = m.groups()
            at.append(k)
            words.append(word.encode())
            tails.append(tail)
        else:
            other.append(k)
    marks = [t for t in {*tails} if t]
    ids_of = dict(zip(marks, unit_bytes(path, marks), strict=True)) if len(marks) < MANY else {m: unit_bytes(path, [m])[0] for m in marks}
    for k, ids, tail in zip(at, pairs_of(path).merged(words), tails, strict=True):
        out[k] = ids + ids_of[tail] if tail else ids
    for a in range(0, len(other), MANY - 1):
        some = other[a : a + MANY - 1]
        for k, ids in zip(some, unit_bytes(path, [units[k] for k in some]), strict=True):
            out[k] = ids
    return out


def _by_library(path: str, units: list[str]) -> list[list[int]]:
    if any(len(u) > WINDOW for u in units):
        return [[i for part in long_ids(path, u) for i in part] if len(u) > WINDOW else _by_library(path, [u])[0] for u in units]
    # a unit that begins with a space never meets what is before, if that is no white space
    closed = [u for u in units if u[0] == " " and not u[-1].isspace()]
    got = _of_one(path, closed) if len(closed) > 1 else None
    if got is None:
        return [e.ids for e in plain_tokenizer(path).encode_batch_fast(units, add_special_tokens=False)] if units else []
    if len(closed) == len(units):
        return got
    ids = dict(zip(closed, got, strict=True))
    other = [u for u in units if u not in ids]
    ids.update(zip(other, (e.ids for e in plain_tokenizer(path).encode_batch_fast(other, add_special_tokens=False)), strict=True))
    return [ids[u] for u in units]


@lru_cache(maxsize=2)
def shared_units(path: str) -> UnitIds:
    """This process's table, which its next task finds as the last one has left it."""
    return UnitIds(path)


class UnitIds:
    """Ids of texts as unsigned 32-bit numbers in this machine's order; those of short parts are kept, up to a bound.

    There are two tables of half the bound: a full one takes the other's place, whose parts are kept if they come again.
    """

    def __init__(self, path: str, most: int = 2 * TABLE_PIECES):
        self.path, self.most = path, most
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.long: list[str] = []

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, of short ones together."""
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and len(texts[b]) <= WINDOW and chars < TOGETHER:
                chars += len(texts[b])
                b += 1
            if b == a:
                yield self.text(texts[a])
                a += 1
            else:
                yield from self._together(texts[a:b])
                a = b

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = [split_first(t) for t in texts]
        firsts = [*{f for f, _ in cut if f}]
        ids_of = {"": b""} | dict(zip(firsts, self._fresh(firsts), strict=True))
        found = [parts(s) if s else [] for _, s in cut]
        self._learn([*{p for x in found for p in x}])
        kept = self.kept
        out = [ids_of[f] + b"".join(map(kept.__getitem__, x)) for (f, _), x in zip(cut, found, strict=True)]
        self._turn()
        return out

    def text(self, text: str) -> bytes:
        """Ids of a text in which no special string counts."""
        out = []
        for s in stretches(text):
            first, s = split_first(s)
            if first:
                out += self._fresh([first])
            if s:
                out.append(self._parts(parts(s)))
        return b"".join(out)

    def _fresh(self, units: list[str]) -> list[bytes]:
        return unit_bytes(self.path, units)

    def _parts(self, found: list[str]) -> bytes:
        self._learn([*{*found}])
        out = b"".join(map(self.kept.__getitem__, found))
        self._turn()
        return out

    def _learn(self, found: list[str]) -> None:
        """Puts different parts into the table."""
        kept, before = self.kept, self.before
        new = [p for p in found if p not in kept]
        fresh = [p for p in new if p not in before]
        if len(fresh) < len(new):
            kept.update((p, before[p]) for p in new if p in before)
        if fresh:
            kept.update(zip(fresh, self._fresh([" " + p for p in fresh]), strict=True))
            self.long += [p for p in fresh if len(p) > TABLE_BYTES]

    def _turn(self) -> None:
        """Brings the tables within their bounds."""
        for p in self.long:
            del self.kept[p]
        self.long = []
        if 2 * len(self.kept) > self.most:
            self.kept, self.before = {}, self.kept
