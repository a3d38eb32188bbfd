"""Secrets in whole texts: fixed patterns, and a token-efficiency test for random strings.

Text that people write is cheap under a byte-pair vocabulary: a token covers about four characters.
Random strings are dear, under two and a half. Every long run of key characters, or long rest of one
of which a fixed pattern took a part, that isn't a digest of a known length, a UUID or a plain number, is tokenised; a low ratio of
characters to tokens makes it a span of kind ``random``. Capitals, signs and numbers are dear too, so a
run with the shape of a name is spared if its letters, in lower case, are cheap: then they are words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from leadline.llm.bpe import PIECES
from leadline.llm.common import id_type, session, text_rows

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")

# The three base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Least characters of a run that is tested, the ratio below which it is random, characters tokenised at a time.
LEAST_RUN, RATIO, SLICE = 20, 2.4, 4096
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: Hexadecimal digits of the digests that tools print: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
#: A digest after the name of its algorithm: as many bytes as that makes, in hexadecimal or in base64.
LABELLED = re.compile("|".join(rf"(?i:{name})[-_=/](?:[0-9a-fA-F]{{{2 * n}}}|[A-Za-z0-9+/_-]{{{-(-4 * n // 3)}}}={{0,{-n % 3}}})" for name, n in (("md5", 16), ("sha1", 20), ("sha224", 28), ("sha256", 32), ("sha384", 48), ("sha512", 64))))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: The shape of names: words, capitals and short numbers, joined or not. Each part is taken once, so that no run is split in many ways.
NAME = re.compile(r"(?:[+/_=-]|[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[A-Z]{2,}(?=[A-Z][a-z]{2})|(?<![0-9])[0-9]{1,4}(?![0-9]))++")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBER = re.compile(r"[0-9+/_=-]+")

Span = tuple[str, int, int]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """Whole matches of the fixed patterns, leftmost and non-overlapping for each kind, those too short left out."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _is_dear(parts: list[str], encoding: tiktoken.Encoding) -> bool:
    """Whether the parts have few characters a token, taken together."""
    tokens = sum(len(encoding.encode_ordinary(p[k : k + SLICE])) for p in parts for k in range(0, len(p), SLICE))
    return sum(map(len, parts)) < RATIO * tokens


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What spans (by start) cover, as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _untaken(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The stretches of runs that no taken span covers; runs and spans are each gone through once."""
    covered, k = _merged(taken), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < len(covered) and covered[k][0] < end:
            s, e = covered[k]
            if s > start:
                yield start, s
            start = max(start, e)
            if e > end:  # the next run may begin within it
                break
            k += 1
        if start < end:
            yield start, end


def random_spans(text: str, encoding: tiktoken.Encoding, taken: list[Span]) -> list[Span]:
    """Runs, and what the taken spans (by start) leave of runs, with few characters a token."""
    out = []
    for start, end in _untaken(text, taken):
        run = text[start:end]
        if len(run) < LEAST_RUN or any(p.fullmatch(run) for p in (DIGEST, UUID, NUMBER, LABELLED)):
            continue
        if _is_dear([run], encoding) and not (NAME.fullmatch(run) and not _is_dear([w.lower() for w in WORD.findall(run)], encoding)):
            out.append(("random", start, end))
    return out


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Spans of secrets in every whole text, by code point, end exclusive.

    Returns one row for each input row: doc_id, n_assign, n_access, n_hex, n_random long, base_sha256 (of the
    base spans kind:start:end by start, then kind, joined by commas), spans string (all spans, joined likewise)
    and redacted string (the text with every span replaced by a mark; null unless asked for). A null or empty
    text has no spans and the digest of an empty string; a very long one is read whole, in time and memory that
    grow with its length, runs being tokenised in slices; a null id stays null, repeated rows give repeated
    results, an empty table an empty one; other columns, whatever they are called, are not read.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, encoding, base), key=_order)
                n = [sum(s[0] == k for s in spans) for k in KINDS]
                out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redacted(text, spans) if with_text else None))
            cols = [*zip(*out, strict=True)] if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")


def without_secrets(docs: DataFrame, vocabulary_path: str, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The rows, with all their columns, each secret in the text replaced by a mark and the length column kept true.

    A null text stays null, and so does the length of a row whose text has no secret; rows without a span, among
    them all with an empty text, are unchanged; very long texts are read whole; repeated rows give repeated
    results, an empty table an empty one. Null ids and columns of any other name are passed on.
    """
    session(docs)
    names = docs.columns
    at_text, at_length = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            texts, changed = [], {}
            for k, value in enumerate(batch.column(at_text)):
                text = value.as_py()
                base = base_spans(text or "")
                spans = base + random_spans(text or "", encoding, base)
                if spans:
                    text = changed[k] = redacted(text, spans, mark)
                texts.append(text)
            columns = [*batch.columns]
            if changed:
                columns[at_text] = pa.array(texts, columns[at_text].type)
                if at_length is not None:
                    columns[at_length] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(columns[at_length].to_pylist())], columns[at_length].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
