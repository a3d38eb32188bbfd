"""Byte-level byte-pair encoding as a streaming transducer, and decoding as a byte-to-text machine.

Encoding never needs a whole text. The text is cut by the published byte-level pattern into pieces;
a piece is closed once the next one has begun. Within a piece, tokens are emitted as soon as no
further byte can change them: the merge list has a finite *sufficient lookahead*, computed in
``sufficient_lookahead``, and a token whose end lies that many bytes before the end of what was
read is stable. So a run of any length, say a megabyte without a space, is held as a window of
constant size.

Decoding goes from ids to bytes to text with an incremental UTF-8 machine, which keeps at most three
bytes of state and puts U+FFFD for each maximal broken part.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadline.llm.common import id_type, session, text_rows

#: The published pattern of byte-level tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of text handled at a time.
WINDOW = 1 << 16
#: Pieces kept in a worker's table, and the longest of them in bytes.
TABLE_PIECES, TABLE_BYTES = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A tokenizer file's merge list over integer symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = doc["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.bytes_of = {vocab[t]: b for t, b in raw.items()}
        self.of_byte = [0] * 256
        for token, b in raw.items():
            if len(b) == 1:
                self.of_byte[b[0]] = vocab[token]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for m in doc["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if (a, b) not in self.rank:
                self.rank[a, b] = (len(self.pairs), c)
                self.pairs.append((a, b, c))
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = defaultdict(bytes, self.bytes_of)
        self.longest = max(map(len, self.bytes_of.values()))
        self.lookahead = sufficient_lookahead(self.pairs, {i: len(b) for i, b in self.bytes_of.items()})

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: a heap of adjacent pairs by (rank, place) over a linked list of symbols."""
        n = len(data)
        ids = [self.of_byte[b] for b in data]
        if n < 2:
            return ids
        rank = self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get((made, ids[k])):
                    heapq.heappush(heap, (r[0], i, made, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, ids[h], made, r[1]))
        return [i for i in ids if i >= 0]


def sufficient_lookahead(pairs: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes after a token that settle it, whatever comes then.

    A later byte changes a token only through a chain of merges, each across the border of the token
    before it: the merge across a token's right border took a prefix of the next token that, without
    the later bytes, an earlier-ranked merge would have taken; and that one failed as its own right
    part was taken by a merge of still lower rank across the next border. Ranks fall along the chain,
    so one pass over the merges in order of rank gives the longest chain in bytes. ``reach[i]`` bounds
    the bytes right of the border that merge i crosses; ``wait[v]`` is the largest for a token that
    begins with v and whose next merge of v has been seen; ``cross[u]`` the largest reach of a merge
    with left part u.
    """
    parts = {c: (a, b) for a, b, c in reversed(pairs)}
    through: dict[int, int] = {}  # the longest token that has the symbol on its left spine
    for a, _, c in reversed(pairs):
        through[c] = max(through.get(c, 0), size[c])
        through[a] = max(through.get(a, 0), through[c])
    wait: dict[int, int] = {}
    cross: dict[int, int] = {}
    best = max(size.values())
    for a, b, c in pairs:
        reach = max(through.get(b, size[b]), wait.get(b, 0))
        best = max(best, reach)
        further, u = 0, b
        while True:
            further = max(further, cross.get(u, 0))
            if u not in parts:
                break
            u = parts[u][1]
        wait[a] = max(wait.get(a, 0), through[c] + further)
        cross[a] = max(cross.get(a, 0), reach)
    return best + max(size.values())


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=1)
def _pieces() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The pattern, the same without letters and numerals that only the pattern library knows, and those.

    The tokenizers library and this process's pattern library can follow different Unicode versions.
    Only characters that are unassigned in Python's own tables can differ; these are asked of the library.
    """
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    unknown = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    odd = [c for c in regex.findall(r"[\p{L}\p{N}]", unknown) if len(cut.pre_tokenize_str(f"a{c}a")) > 1 and len(cut.pre_tokenize_str(f"1{c}1")) > 1]
    plain = regex.compile(PIECES)
    if not odd:
        return plain, plain, None
    out = _ranges(odd)
    strict = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{out}]|[^\s\p{{L}}\p{{N}}])").replace(r" ?\p{L}+", rf" ?(?:(?![{out}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{out}])\p{{N}})+")
    return plain, regex.compile(strict), regex.compile(f"[{out}]")


def _ranges(chars: list[str]) -> str:
    """Ascending characters as the ranges of a set."""
    ends: list[list[str]] = []
    for c in chars:
        if ends and ord(ends[-1][1]) == ord(c) - 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "".join(f"{a}-{b}" for a, b in ends)


#: Bytes that no UTF-8 form of a character from U+0540 on begins with.
_LOW = bytes(range(0xD5))


def pattern_for(text: str) -> regex.Pattern:
    plain, strict, odd = _pieces()
    return plain if odd is None or text.isascii() or not text.encode().translate(None, _LOW) or not odd.search(text) else strict


def spans_of_special(text: str, special: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """The text cut at special strings, leftmost first and the longest of those: (part, is special)."""
    found = [s for s in special if s in text]
    if not found:
        yield text, False
        return
    at = 0
    for m in regex.finditer("|".join(regex.escape(s) for s in sorted(found, key=len, reverse=True)), text):
        if m.start() > at:
            yield text[at : m.start()], False
        yield m[0], True
        at = m.end()
    if at < len(text):
        yield text[at:], False


#: A place where one piece must end and another begin: a space between a non-space and a letter.
_BORDER = regex.compile(r"(?r)\S(?= \p{L})")


def closed_windows(text: str, pattern: regex.Pattern, window: int = WINDOW) -> Iterator[list[str] | str]:
    """The pieces of a text, a window at a time.

    Gives lists of whole pieces and, for a piece longer than a window, its parts as strings, ended by "".
    """
    at, n = 0, len(text)
    while n - at > window:
        m = _BORDER.search(text, at, at + window)
        if m and m.end() > at:
            yield pattern.findall(text, at, m.end())
            at = m.end()
            continue
        # no such place: piece by piece, the last one that the window cuts apart
        end = at
        while (m := pattern.match(text, end)) and m.end() - at <= window:
            end = m.end()
        if end > at:
            yield pattern.findall(text, at, end) if _whole(pattern, text, at, end) else [x[0] for x in _matches(pattern, text, at, end)]
            at = end
            continue
        for k in range(at, m.end(), window):
            yield text[k : min(k + window, m.end())]
        yield ""
        at = m.end()
    if at < n:
        yield [x[0] for x in pattern.finditer(text, at)]


def _matches(pattern: regex.Pattern, text: str, at: int, end: int) -> Iterator[regex.Match]:
    while at < end:
        m = pattern.match(text, at)
        yield m
        at = m.end()


def _whole(pattern: regex.Pattern, text: str, at: int, end: int) -> bool:
    """Whether cutting the text at end leaves the last pieces as they are: white space there looks ahead."""
    return not text[end - 1].isspace()


class Pieces(dict):
    """What a function gives for whole pieces; short ones are kept, up to a bound."""

    def __init__(self, of: Callable[[bytes], object]):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str):
        data = piece.encode()
        out = self.of(data)
        if len(data) <= TABLE_BYTES:
            if len(self) >= TABLE_PIECES:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """The transducer: parts of a text go in, ids come out as they are settled."""

    def __init__(self, m: Merges, table: Pieces | None = None):
        self.m, self.open = m, b""
        self.hold = 4 * (m.lookahead + m.longest)
        self.table = Pieces(self.whole) if table is None else table

    def whole(self, data: bytes) -> tuple[int, ...]:
        """Ids of a whole piece; a long one goes through the window."""
        return tuple(self.m.merge(data)) if len(data) <= self.hold else (*self._feed(data), *self._end())

    def _feed(self, data: bytes) -> Iterator[int]:
        """Takes bytes of an open piece and gives the ids that are settled."""
        for k in range(0, len(data), self.hold):
            self.open += data[k : k + self.hold]
            if len(self.open) < self.hold:
                continue
            settled, at = len(self.open) - self.m.lookahead, 0
            for i in self.m.merge(self.open):
                end = at + len(self.m.bytes_of[i])
                if end > settled:
                    break
                yield i
                at = end
            self.open = self.open[at:]

    def _end(self) -> list[int]:
        ids, self.open = self.m.merge(self.open), b""
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in parts."""
        pattern = pattern_for(text)
        for part, special in spans_of_special(text, self.m.special):
            if special:
                yield [self.m.special[part]]
                continue
            for got in closed_windows(part, pattern):
                if isinstance(got, list):
                    yield [*chain.from_iterable(map(self.table.__getitem__, got))]
                elif got:
                    yield list(self._feed(got.encode()))
                else:
                    yield self._end()


class Decoder:
    """Ids to text: a machine whose state is an unfinished UTF-8 sequence. Ids that the vocabulary lacks give nothing."""

    def __init__(self, m: Merges):
        self.bytes_of = m.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Token ids of every text and the text that these ids give back.

    Returns doc_id, n_tokens long, ids array<int> and decoded string (each null where not asked for),
    ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded text.
    One row for each input row: a null or empty text has no tokens and decodes to "", a null id stays
    null, repeated rows give repeated results, an empty table an empty one; other columns are not read.
    The digests are made as the parts come, so without ids and text a row needs constant memory.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(tokenizer)
        table = Encoder(m).table
        names = [str(i) for i in range(max(m.bytes_of) + 1)]
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                encoder, decoder = Encoder(m, table), Decoder(m)
                ids_hash, text_hash, n, ids, text = hashlib.sha256(), hashlib.sha256(), 0, [], []
                for part in encoder.encode(value.as_py() or ""):
                    if not part:
                        continue
                    ids_hash.update(("," * (n > 0) + ",".join(map(names.__getitem__, part))).encode())
                    n += len(part)
                    text_hash.update((got := decoder.feed(part)).encode())
                    if with_ids:
                        ids += part
                    if with_text:
                        text.append(got)
                text_hash.update((got := decoder.finish()).encode())
                out.append((n, ids if with_ids else None, "".join([*text, got]) if with_text else None, ids_hash.hexdigest(), text_hash.hexdigest()))
            cols = [*zip(*out, strict=True)] if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string")
