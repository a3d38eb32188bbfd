"""Token ids, counts and decoding against the public library, and the transducer's own rules."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadline.llm.bpe import Decoder, Encoder, closed_windows, encode_decode, merges, pattern_for
from leadline.llm.token_count import Counts, LongPiece, count_tokens, merged_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(32, 127)] + ["\n", "\t", "é", "ß", "中", "１", " ", "　", "𑶰", "ꟑ", "😀", "\U0001e6c0"]
    out = ["", " ", "\n", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "don't  we'll\t\tgo", "'s" * 2000, " " * 3000 + "x", "\n" * 999, "x" * 65536 + " y"]
    out += ["a" * 9000, "é" * 70_000, " " * 70_000, "  x" * 30_000, "0" * 66_000, "ab " * 30_000]
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(150)]
    out += ["".join(rng.choices("abcdetrin", k=12_000)) for _ in range(4)]
    out += ["".join(rng.choices(alphabet + [" "] * 20, k=80_000)) for _ in range(2)]
    return out


def test_ids_and_decoding_are_the_library_s(library):
    m = merges(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        ids = [i for part in Encoder(m).encode(t) for i in part]
        assert ids == want
        d = Decoder(m)
        assert d.feed(ids) + d.finish() == library.decode(want, skip_special_tokens=False)


def test_decoding_broken_ids(library):
    m, rng = merges(PATH), random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(20)]
        d = Decoder(m)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_memory_is_a_window():
    m = merges(PATH)
    e = Encoder(m)
    longest = 0
    for _ in range(50):
        list(e._feed(b"abcdetrin" * 500))
        longest = max(longest, len(e.open))
    assert longest <= e.hold + m.lookahead + m.longest


def test_lookahead_settles_tokens():
    m, rng = merges(PATH), random.Random(3)
    for _ in range(300):
        head = "".join(rng.choices("abcdetrinos", k=m.lookahead + 200)).encode()
        one, two = (m.merge(head + "".join(rng.choices("abcdetrinos", k=40)).encode()) for _ in range(2))
        at = 0
        for a, b in zip(one, two, strict=False):
            at += len(m.bytes_of[a])
            if at > 200:
                break
            assert a == b


def test_counts_are_symbols_less_merges():
    m, rng = merges(PATH), random.Random(4)
    for _ in range(200):
        data = bytes(rng.choices(b"abcdetrinos ", k=rng.randint(0, 60)))
        assert merged_count(m, data) == len(m.merge(data))


def test_windows_are_whole():
    for t in texts():
        parts = []
        for got in closed_windows(t, pattern_for(t), 64):
            parts += got if isinstance(got, list) else [got]
        assert "".join(parts) == t


def test_frames(spark, library):
    rows = [(1, "hello world"), (2, None), (2, ""), (None, "x"), (1, "hello world"), (3, "token " * 2000)]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    counted = count_tokens(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counted) == want
    assert {r.over_limit for r in counted if r.doc_id == 3} == {True} and {r.n_bytes for r in counted if r.doc_id == 2} == {0}
    coded = encode_decode(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in coded) == want
    assert all(r.decoded == "hello world" for r in coded if r.doc_id == 1)
    assert count_tokens(docs.limit(0), PATH).count() == encode_decode(docs.limit(0), PATH).count() == 0


def test_long_pieces_are_counted_in_a_window(library):
    m, rng = merges(PATH), random.Random(3)
    counts = Counts(m)
    for letters in ("a", "abcdefgh", "the", "xyz!?", "é日"):
        run = "".join(rng.choices(letters, k=90_000))
        assert counts.text(run) == len(library.encode(run, add_special_tokens=False).ids)
        piece, data = LongPiece(m), run.encode()[:20_000]
        for k in range(0, len(data), 777):
            piece.feed(data[k : k + 777])
            assert len(piece.open) < 2 * piece.hold
        assert piece.end() == merged_count(m, data)
