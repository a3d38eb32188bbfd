"""Token counts by byte-pair merging on a heap and a linked list, with no ids made.

A piece starts as one symbol a byte. The heap holds adjacent pairs that the merge list knows, by rank
and place; the lowest is popped, its two symbols become one, and the new neighbours' pairs are pushed.
Each merge takes one symbol away, so a piece's count is its bytes less its merges. Counts of short
pieces are kept in a bounded table; a text's pieces are counted before they are looked up. A piece of any
length goes through a window of constant size: what lies the merge list's sufficient lookahead before the
window's end is settled and counted, and the rest stays for the next bytes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

from leadline.llm.bpe import Merges, Pieces, closed_windows, merges, pattern_for, spans_of_special
from leadline.llm.common import id_type, session, text_rows


def _merged(m: Merges, data: bytes) -> tuple[list[int], int]:
    """(the byte that each symbol left begins with, or -1 where a byte begins none; merges done) of a piece."""
    n = len(data)
    rank, symbol = m.rank, [m.of_byte[b] for b in data]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r[0], i, symbol[i], symbol[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1])))]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        done += 1
        symbol[i], symbol[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if r := rank.get((made, symbol[k])):
                heapq.heappush(heap, (r[0], i, made, symbol[k], r[1]))
        h = before[i]
        if h >= 0 and (r := rank.get((symbol[h], made))):
            heapq.heappush(heap, (r[0], h, symbol[h], made, r[1]))
    return symbol, done


def merged_count(m: Merges, data: bytes) -> int:
    """Symbols left of a piece: initial symbols minus merges."""
    return len(data) - _merged(m, data)[1]


class LongPiece:
    """A piece that comes in parts, counted as they come."""

    def __init__(self, m: Merges):
        self.m, self.open, self.count = m, b"", 0
        self.hold = 4 * (m.lookahead + m.longest)

    def feed(self, data: bytes) -> None:
        for k in range(0, len(data), self.hold):
            self.open += data[k : k + self.hold]
            if len(self.open) < self.hold:
                continue
            symbol, _ = _merged(self.m, self.open)
            settled = len(self.open) - self.m.lookahead
            # the symbols that end in what is settled: all that another one follows there
            starts = [i for i in range(settled + 1) if symbol[i] >= 0]
            self.count += len(starts) - 1
            self.open = self.open[starts[-1] :]

    def end(self) -> int:
        return self.count + merged_count(self.m, self.open)


class Counts:
    """Token counts of texts, with a bounded table of pieces."""

    def __init__(self, m: Merges):
        self.m, self.table = m, Pieces(partial(merged_count, m))

    def text(self, text: str) -> int:
        total, pattern = 0, pattern_for(text)
        for part, special in spans_of_special(text, self.m.special):
            if special:
                total += 1
                continue
            long = LongPiece(self.m)
            for got in closed_windows(part, pattern):
                if isinstance(got, list):
                    seen = Counter(got)
                    total += sum(map(mul, map(self.table.__getitem__, seen), seen.values()))
                elif got:
                    long.feed(got.encode())
                else:
                    total += long.end()
                    long = LongPiece(self.m)
        return total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit) of every text.

    One row for each input row: a null or empty text counts 0 and 0, a very long one is counted whole in constant
    memory beside the text itself, a null id stays null, repeated rows give repeated results, an empty table an
    empty one; other columns, whatever they are called, are not read.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(merges(tokenizer))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counts.text(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, n_bytes long, n_tokens long, over_limit boolean")
