"""Packing, collocations and alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leadline.llm import alignment, bpe, packing, phrases, queries, short_units, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", " ", " ", "\n", "\t", "a", "b", "the", "'s", "é", "\xa0", "1", "12", "!", ".", " ", "　", "\x1c", "中", "​", "<|endoftext|>", "x" * 70, "▁", "<s>", "\x00", "ing", "😀"]
ODD = ["", None, "foo ", " foo", "  ", "\n", " ", "<|endoftext|>", "a <|endoftext|> b"]


def made(n, longest=30):
    r = random.Random(7)
    return ODD + ["".join(r.choice(BITS) for _ in range(r.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def test_units_give_what_the_library_gives(tokenizer, monkeypatch):
    for window in (units.WINDOW, 40):
        monkeypatch.setattr(units, "WINDOW", window)
        own = units.UnitIds(A)
        for x in made(800) + made(20, 3000):
            assert own.text(x or "") == np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("x", ["a" * 200_000, " " * 150_000, "ab " * 60_000, "\n " * 50_000, "x" * 150_000 + " foo"])
def test_units_of_very_long_texts(x):
    got = units.UnitIds(A).text(x)
    assert got == np.array([i for part in bpe.Encoder(bpe.merges(A)).encode(x) for i in part], "<u4").tobytes()


def best_fit(lengths, limit):
    """Room left of each bin, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(limit - n)
        else:
            rooms[rooms.index(best)] -= n
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(400):
        limit = r.choice([1, 2, 5, 16, 37, 100])
        lengths = [r.randint(1, limit) for _ in range(r.randint(0, 80))]
        spans = defaultdict(list)
        for n, _, count, first, each, before in packing.plan(Counter(lengths), limit).tolist():
            for i in range(count):
                at = before + i % each * n
                spans[first + i // each].append((at, at + n))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
        assert sorted(limit - max(s)[1] for s in spans.values()) == best_fit(lengths, limit)


def test_plan_of_huge_counts_is_small():
    rows = packing.plan({n: 10**9 + n for n in range(1, 1025)}, 1024)
    assert len(rows) < 4 * 1024 and rows[:, 2].sum() == sum(10**9 + n for n in range(1, 1025))


def test_packing(spark):
    t = Tokenizer.from_file(A)
    texts = made(150, 200) + ["word " * 40, "word " * 40]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)] + [(None, "x", "no id")], "doc_id long, length string, text string").repartition(3)
    limit = 64
    got = packing.pack(df, A, limit=limit).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.offset + r.length))
    for i, x in [*enumerate(texts), (None, "no id")]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // limit)
        assert [i for r in own for i in r.ids] == ids
        assert all(r.length == limit for r in own[1:]) and [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for s in by_bin.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= limit and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    assert sorted(limit - s[-1][1] for s in by_bin.values()) == best_fit([r.length for r in got], limit)
    whole = packing.sequences(packing.pack(df, A, limit=limit)).collect()
    assert len(whole) == len(by_bin) and sum(len(r.ids) for r in whole) == sum(r.length for r in got)


def test_many_units_take_few_calls_of_the_library(monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinésшд") for _ in range(r.randint(1, 14))) + r.choice(["", "", ",", "...", "\n", "'s", "7", "  "])
    texts = ["", " ", "x", *(" ".join(word() for _ in range(300)) for _ in range(20)), "a" * (units.WINDOW + 9), " the end"]
    plain, calls = units.plain_tokenizer(A), []

    class Counted:
        def encode_batch_fast(self, batch, **kw):
            calls.append(len(batch))
            return plain.encode_batch_fast(batch, **kw)

    want = [np.array(plain.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    monkeypatch.setattr(units, "plain_tokenizer", lambda path: Counted())
    assert [*units.UnitIds(A).texts(texts)] == want
    assert sum(calls) < 0.5 * 20 * 300
    few = units.UnitIds(A, most=50)
    assert [few.text(t) for t in texts] == want and [*few.texts(texts)] == want and len(few.kept) <= 25
    assert units.shared_units(A) is units.shared_units(A)


@pytest.mark.parametrize("together", [short_units.TOGETHER, 100])
def test_short_units_give_what_the_library_gives(together, monkeypatch):
    plain = Tokenizer.from_file(A)
    bits = [*BITS, "\n\n", "\r\n", " \n", "\x85", "\u2028", "à", "×", "Ж", "ц,", "ѡ", "'", "'s,", "7.", "x.\ny", " 12", "\u180e", "a" * 17, "\n\xa0", "s.'s"]
    r = random.Random(11)
    texts = [x or "" for x in made(800)] + ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    want = [np.array(e.ids, np.uint32).tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(short_units, "TOGETHER", together)
    for most in (short_units.MOST, 30):
        own = short_units.TextIds(A, most)
        for _ in range(2):
            assert [x for k in range(0, len(texts), 100) for x in own.texts(pa.array(texts[k : k + 100]))] == want
    assert [*own.texts(pa.array(["a " * 90, "", "b" * 300, "é" * 200]).slice(1))] == [np.array(plain.encode(t).ids, np.uint32).tobytes() for t in ("", "b" * 300, "é" * 200)]


def test_words_are_encoded_once_whatever_marks_and_lines_are_around(monkeypatch):
    words = [a + b + c for a in ("ba", "lé", "жо") for b in ("ri", "to", "sä", "q") for c in ("", "n", "st")]
    text = "".join(f" {w}{m}" for m in ("", ",", ".", ";", "!?") for w in words) + "".join(f"\n{w}" for w in words)
    want, learnt, own = np.array(Tokenizer.from_file(A).encode(text).ids, np.uint32).tobytes(), [], short_units.fresh
    monkeypatch.setattr(short_units, "fresh", lambda path, low, high: learnt.append(len(low)) or own(path, low, high))
    table = short_units.TextIds(A)
    assert [*table.texts(pa.array([text] * 3))] == [want] * 3
    # each with a space and, after a line's end, without; marks and line ends
    assert sum(learnt) <= 2 * len(words) + 5
    assert [*table.texts(pa.array([text]))] == [want] and len(learnt) == 1
    # another table's turn: what comes again is not encoded again
    table.most = 1
    assert [*table.texts(pa.array([text]))] == [want] and len(learnt) == 1 and table.before is not None


def test_merges_by_column_give_what_a_heap_gives():
    r, m = random.Random(5), bpe.merges(A)
    words = sorted({" " * r.randint(0, 1) + "".join(r.choice("etaoinshrdlué") for _ in range(r.randint(1, 7))) for _ in range(3000)})
    rows = np.zeros((len(words), 16), np.uint8)
    for k, x in enumerate(words):
        rows[k, : len(x.encode())] = [*x.encode()]
    counts, ids = units.pairs_of(A).merged_short(rows, (rows != 0).sum(1))
    assert [x[:k].tolist() for x, k in zip(ids, counts.tolist(), strict=True)] == [m.merge(x.encode()) for x in words]


def test_alignment_learns_units_of_a_batch_together(monkeypatch):
    texts = ["", "alpha beta\n gamma  delta", " alpha \u2581 beta", "alpha, beta\x00 x" * 3, "y" * 100]
    one, many, calls = alignment.Aligned(A, B), alignment.Aligned(A, B), []
    own = alignment.unit_ids
    monkeypatch.setattr(alignment, "unit_ids", lambda path, u: calls.append(len(u)) or own(path, u))
    many.learn(texts)
    assert len(calls) == 1
    for t in filter(None, texts):
        x, y = ([k for part in u.numbers(t) for k in part] for u in (one, many))
        assert [(one.groups[k], one.pairs[k], *one.counts[k]) for k in x] == [(many.groups[k], many.pairs[k], *many.counts[k]) for k in y]
    many.learn(texts)
    assert sum(calls[1:]) == len(one.groups)


def test_alignment_encodes_words_once_whatever_marks_and_lines_are_around(monkeypatch):
    words = [a + b + c for a in ("ba", "lé", "жо") for b in ("ri", "to", "sä", "q") for c in ("", "n", "st")]
    text = "".join(f" {w}{m}" for m in ("", ",", ".", ";", "!?") for w in words) + "".join(f"\n{w}" for w in words)
    learnt, own = [], alignment.unit_ids
    monkeypatch.setattr(alignment, "unit_ids", lambda path, u: learnt.append(len(u)) or own(path, u))
    table = alignment.Aligned(A, B)
    table.learn([text] * 3)
    # each with a space and, after a line's end, without; marks and line ends
    assert sum(learnt) <= 2 * len(words) + 6
    table.learn([text])
    assert len(learnt) == 1
    # the next task of a worker finds the table
    assert alignment.shared_units(A, B) is alignment.shared_units(A, B)


def chunk_of(b_path, texts):
    """Documents' columns without corpus counts, and the pairs' counts, from one chunk."""
    chunk, out, k = alignment.Chunk(alignment.Aligned(A, b_path), alignment.CHUNK_DOCS), [], 0
    while k < len(texts):
        end = chunk.together(texts, k)
        out += chunk.add(texts[k:end])
        k = end
    return out, {p: n for _, pairs, sums, *_ in chunk.rows() for p, n in zip(pairs.tolist(), sums.tolist(), strict=True)}


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_units_cut_in_bytes(small, tokenizer, monkeypatch):
    bits = [*BITS, "\n\n", "\r\n", ";\r\n", ".\r", "\r", " \n", "\x85", "\u2028", "à", "Ж", "ц,", "'s,", "7.", "x.\ny", "\u180e", "a" * 17, "\n\xa0", "s.'s"]
    r = random.Random(13)
    texts = [x or "" for x in made(300)] + ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    if small:  # tables of few units, texts in windows
        monkeypatch.setattr(alignment, "MOST", 50)
        monkeypatch.setattr(alignment, "WINDOW", 40)
        monkeypatch.setattr(units, "WINDOW", 40)
    got, pairs = chunk_of(B, texts)
    want = aligned(tokenizer, texts)
    assert got == [(*w[:4], w[6]) for w in want] and any(w[0] for w in want) and not all(w[0] for w in want)
    assert sum(pairs.values()) == sum(w[3] for w in want)


@pytest.mark.parametrize("how", [{"split_by_whitespace": False}, {"normalization_rule_name": "nmt_nfkc"}, {"split_by_unicode_script": False}])
def test_alignment_with_entries_over_cuts(how, tokenizer, tmp_path, monkeypatch):
    own = {"normalization_rule_name": "identity", "remove_extra_whitespaces": False} | how
    lines = ["of the sea, of the sea. in the deep; of the, of the."] * 50
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=f"{tmp_path}/m", model_type="bpe", vocab_size=320, byte_fallback=True, hard_vocab_limit=False, minloglevel=2, **own)
    monkeypatch.setitem(globals(), "B", f"{tmp_path}/m.model")
    texts = ["of the sea, of the sea.", "in the deep;\nof the, of the", "a  b", "", "of the.\r\nx", " the sea", "ﬁ sea", " ", "the ", "sea, deep. " * 9]
    table = alignment.Aligned(A, B)
    assert table.whole == ("split_by_unicode_script" not in how)
    assert table.whole or table.never[[*b".,"]].all()
    assert chunk_of(B, texts)[0] == [(*w[:4], w[6]) for w in aligned(tokenizer, texts)]


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, A).collect() == []
    assert packing.pack(spark.createDataFrame([(1, "")], "doc_id long, text string"), A, end_id=None).collect() == []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    return con


def collocations_twin(duck, rows):
    duck.sql("DELETE FROM documents")
    if rows:
        duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(duck.sql(phrases.ORACLE).fetchall())


@pytest.mark.parametrize("chunk_words", [1 << 21, 300])
def test_collocations(spark, duck, chunk_words):
    r = random.Random(5)
    words = ["a", "B", "é", "x\xa0y", "f\x00g"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?", ",", "\x0b"]) for _ in range(n))
    rows = [(i, r.choice(["de", "en", None, "und"]), r.choice([None, "", text(r.randint(1, 90)), text(30), "one two three four. " * 3])) for i in range(600)]
    rows += [(900, "en", "new york city hall " * 2000), (901, "en", "\n".join(["new york"] * 900)), (901, "en", "New York")] * 2
    df = spark.createDataFrame(rows, "f long, lang string, text string").repartition(3)
    got = phrases.collocations(df, chunk_words=chunk_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = collocations_twin(duck, rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20 and {x[0] for x in want} == {"de", "en", "und"}


def test_collocations_go_on_after_a_window(spark, duck, monkeypatch):
    monkeypatch.setattr(phrases, "WINDOW", 16)
    rows = [(1, "en", "alpha beta gamma. delta epsilon\n" * 40)]
    found = [w for w in phrases._windows(rows[0][2])]
    assert len(found) > 20 and sum(w != phrases._BREAK for part in found for w in part) == 200
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "f long, lang string, text string")).collect())) == collocations_twin(duck, rows)


def shuffled(spark):
    """Bytes written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_collocations_shuffle_small_steps_by_side(spark, duck):
    r = random.Random(7)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 3000}"
    rows = [(i, "en" if i % 5 else "de", " ".join(word() for _ in range(400)) + ".") for i in range(500)]
    df = spark.createDataFrame(rows, "f long, lang string, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    got = sorted(map(tuple, phrases.collocations(df).collect()))
    assert shuffled(spark) - before < 0.5 * sum(len(x[2]) for x in rows)
    want = collocations_twin(duck, rows)
    assert got == want and len(want) > 200
    # many sides and chunks
    assert sorted(map(tuple, phrases.collocations(df, chunk_words=20_000, side_keys=10_000).collect())) == want


def test_collocations_cut_to_the_top_and_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b c. d e. f g. " * 40)], "lang string, text string")
    full = sorted(map(tuple, phrases.collocations(df).collect()), key=lambda x: x[1])
    assert [x[1] for x in full] == list(range(1, len(full) + 1)) and {x[2] for x in full} == {"a b c", "d e", "f g"}
    assert sorted(map(tuple, phrases.collocations(df, top=2).collect()), key=lambda x: x[1]) == full[:2]
    assert phrases.collocations(df.filter("false")).collect() == []


def bytes_of_piece(sp, i):
    p = sp.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()


def aligned(tokenizer, texts):
    """Links and groups of whole texts, by spans."""
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = bpe.byte_letters()
    entry = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}
    docs, pairs = [], Counter()
    for t in texts:
        a, b = (tokenizer.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        of_a, of_b = [entry[i] for i in a], [bytes_of_piece(sp, i) for i in b]
        if not t or not b"".join(of_a) == b"".join(of_b) == (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, of_a)]).tolist(), np.cumsum([*map(len, of_b)]).tolist()
        links = [(x, y) for x, e, p in zip(a, ends_a, of_a, strict=True) for y, f, q in zip(b, ends_b, of_b, strict=True) if e - len(p) < f and f - len(q) < e]
        groups, lo = [], 0
        for end in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(x) for x, e in zip(i, ends, strict=True) if lo < e <= end) for i, ends in ((a, ends_a), (b, ends_b))))
            lo = end
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.update(links)
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(0,) * 6 + ("",) if d is None else (*d[:3], len(d[3]), sum(pairs[x] == top[x[1]] for x in d[3]), sum(pairs[x] for x in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("dealt", [{}, {"chunk_docs": 16, "task_postings": 100}])
def test_alignment(spark, sf, tokenizer, dealt):
    texts = made(120) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 700").limit(40).collect()]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)] * 2, "doc_id long, chunk string, text string").repartition(3)
    got = sorted(alignment.align(df, A, B, **dealt).collect(), key=lambda r: r.doc_id)[::2]
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got] == aligned(tokenizer, texts * 2)[: len(texts)]


def test_alignment_of_long_texts_and_nothing(spark, tokenizer):
    schema = "doc_id long, text string"
    texts = ["word " * 30_000, "\n " * 300]
    got = alignment.align(spark.createDataFrame([(None, texts[0]), (1, texts[1])], schema), A, B).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, 1] and got[0].n_a == 30_001 and got[0].n_links == got[0].n_groups == 30_001
    assert alignment.align(spark.createDataFrame([], schema), A, B).collect() == []
    assert alignment.align(spark.createDataFrame([(1, None)], schema), A, B).collect()[0].n_a == 0


def test_queries_have_the_contracts_columns(spark, sf):
    columns = {"op11_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op12_collocations": "lang rank phrase a l r n score", "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}
    for name, want in columns.items():
        got = queries.queries()[name](spark, sf)
        assert got.columns == want.split() and got.count() > 0
