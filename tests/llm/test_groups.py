"""Similarity joins, fingerprints, quotations and the pipeline against plain versions."""

import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from leadline.llm import fingerprint, jaccard_join, quotes
from leadline.llm.components import components
from leadline.llm.words import grams, words_of

RNG = random.Random(11)


def shingles(t: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


class Sets:
    """Union of ids, the least one on top."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_groups(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    s = Sets()
    for n, (i, a) in enumerate(sets):
        s.find(i)
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                s.join(i, j)
    return {i: s.find(i) for i, _ in sets}


def near_rows(n: int, copies: int, edit: float):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(RNG.choices(vocabulary, k=RNG.randint(0, 60)))) for i in range(n)]
    base = RNG.choices(vocabulary, k=150)
    for i in range(n, n + copies):
        w = [x if RNG.random() > edit else RNG.choice(vocabulary) for x in base]
        rows.append((i, " ".join(w)))
    rows += [(i + 10_000, t) for i, t in RNG.sample(rows, 20)]  # exact copies
    RNG.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, small, block", [(3, 90, 32, 2048), (5, 80, 3, 16), (3, 70, 2, 7)])
def test_groups_are_the_plain_ones(spark, monkeypatch, k, percent, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows(120, 90, 0.02) + [(50_000, "one"), (50_001, "ONE\t"), (50_002, ""), (50_003, None), (50_004, " \n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    want = plain_groups(rows, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, k, percent).collect()}
    assert got == {i: (len(shingles(t, k)), want[i]) for i, t in rows}


def test_group_frames(spark):
    rows = [(1, "a b c d e f"), (1, "x y z q r s"), (2, "X Y Z Q R S"), (3, "A B C D E F"), (None, "a b c d e f"), (4, None), (3, "A B C D E F")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, component_id int, token string")
    got = jaccard_join.similar_groups(docs, 3, 90).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("3", "1"), ("4", "4"), ("None", "None")]
    assert jaccard_join.similar_groups(docs.limit(0), 3, 90).count() == 0


def test_prefixes_keep_every_link():
    scale = np.zeros(1 << jaccard_join.BUCKET_BITS, np.uint16)
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > 0.06]
        b = np.unique(np.append(b, rng.integers(1, 2**63, int(rng.integers(0, 4))).astype(np.uint64)))
        if not len(b) or len(np.intersect1d(a, b)) < jaccard_join.overlap_needed(80, len(a), len(b)):
            continue
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        px, probe, _, l = jaccard_join.prefixes(x, scale, 80, 1.0)
        py, _, index, _ = jaccard_join.prefixes(y, scale, 80, 1.0)
        assert len(np.intersect1d(px[:probe], py[:index])) >= l


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)] + [(300, i) for i in range(301, 340)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, **{i: 300 for i in range(300, 340)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_by_array_are_words_by_pattern():
    texts = ["", " a", "A b\tC\x0b\x0cd  e", "é É x", "x" * 600_000, ("word " * 90_000) + "end", "a\x1cb c"]
    seen, back = {}, {}
    for lo, hi, h, to in words_of(pa.array(texts)):
        for d in range(lo, hi):
            own = h[to[d - lo] : to[d - lo + 1]]
            want = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), texts[d]))
            assert len(own) == len(want)
            for x, w in zip(own.tolist(), want, strict=True):
                assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w
            g, t = grams(own, np.array([0, len(own)]), 3)
            assert len(set(g.tolist())) == len(shingles(texts[d], 3)) and t[-1] == len(g)


def canon(t: str) -> str:
    form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", form).strip()


@pytest.mark.parametrize("rows_in_range", [4096, 3])
def test_fingerprints(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", rows_in_range)
    texts = ["Hello  World", "hello world", "", None, "é ﬁ", "é fi", "a" * 5000, "日本語 テキスト", "x", "hello world "]
    ids = [5, -3, 12, 40, 41, 1000, 7, 8, 2, 3]
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, digest string, range int")
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs).collect()}
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canon(edited) == canon(t)) and r.near_next == float(canon(nxt) == canon(t))
        assert (r.edited_fingerprint == r.fingerprint) == (canon(edited) == canon(t))
    by = defaultdict(set)
    for i, t in order:
        by[canon(t or "")].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({*map(min, by.values())}) == len(by)
    groups = {r.doc_id: (r.group_id, r.group_size) for r in fingerprint.fingerprint_groups(docs).collect()}
    assert groups[5] == groups[-3] == groups[3] == (-3, 3) and groups[41] == groups[1000] == (41, 2) and groups[12] == (12, 2)


@pytest.mark.parametrize("kind", ["far off", "strings", "repeated"])
def test_next_documents_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 50)
    n = 1000
    ids = {"far off": [*range(n), 4 * 10**18], "strings": [f"doc-{i * 7919 % 1000:04}" for i in range(n)], "repeated": [7] * n + [3, 9]}[kind]
    rows = [(i, "same" if kind == "repeated" and k % 2 else f"text {k} of {i}") for k, i in enumerate(ids)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'strings' else 'long'}, text string").repartition(5).selectExpr("*", "xxhash64(text) text_hash")
    hash_of = {r.text: r.text_hash for r in df.collect()}
    order = sorted(rows, key=lambda r: (r[0], hash_of[r[1]]))
    want = sorted((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    got = fingerprint.with_next(df)
    assert sorted((r.doc_id, r.text, r.next_text) for r in got.collect()) == want
    keys = df.select("doc_id", "text_hash")
    sizes = [r["count"] for r in fingerprint._in_ranges(keys.distinct(), fingerprint._ranges(keys)).groupBy("range").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 400


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "digest", lambda c: F.substring(c, 1, 1))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "ad"), (5, "b")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_groups(docs).collect()}
    assert got == {1: "a", 3: "a", 2: "a-1", 4: "a-2", 5: "b"}


def test_fingerprint_frames(spark):
    docs = spark.createDataFrame([(None, "q"), (1, "a"), (1, "b"), (None, "q"), (2, "c")], "doc_id long, text string")
    got = fingerprint.edited_likeness(docs).collect()
    assert len(got) == 5 and sum(r.near_next for r in got) == 1
    one = fingerprint.edited_likeness(docs.filter("doc_id = 2")).collect()
    assert one[0].near_next == 1 and fingerprint.edited_likeness(docs.limit(0)).count() == 0


def test_quotes_are_parsed_by_level():
    own, digests, quoted = quotes.parse("On Monday, A wrote:\n> > deep\n> shallow\n>also\n\nmine\n > not? yes\nend")
    assert own == "mine\nend" and len(digests) >= 2
    assert {q[0] for q in quoted} == {1, 2} and len([q for q in quoted if q[0] == 2]) == 1
    assert quotes.parse("> only") == ("", [], [(1, hashlib.md5(b"only").hexdigest(), 4)]) and quotes.parse("") == ("", [], [])
    assert quotes.parse("He wrote:\nnothing quoted")[0] == "He wrote:\nnothing quoted"


def test_threads(spark):
    rows = [
        (1, 0, "user", "First question\nwith two lines"),
        (1, 1, "bot", "On x, y wrote:\n> First QUESTION\n> with  two lines\n\nan answer"),
        (1, 2, "user", "> an answer\n>> with two lines\nthanks"),
        (1, 3, "other", "a new thread"),
        (1, 4, "bot", "> thanks\nwelcome\n> First question\n"),
        (1, 5, "bot", "> never said\nhm"),
        (2, 0, "user", "> an answer\nelsewhere"),
        (None, 0, "user", "> an answer\nlost"),
        (2, 1, None, None),
        (2, 1, None, None),
    ]
    m = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(m).collect()}
    at = lambda c, t: (got[c, t].parent_turn, got[c, t].root_turn, got[c, t].depth, got[c, t].position)
    assert [at(1, t) for t in range(6)] == [(None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 2), (None, 3, 0, 0), (0, 0, 1, 3), (None, 5, 0, 0)]
    assert got[1, 4].text == "welcome" and got[1, 1].text == "an answer" and got[1, 5].n_quoted == 1 and got[1, 5].n_linked == 0
    assert at(2, 0) == (None, 0, 0, 0) and at(None, 0)[0] is None and got[2, 1].text == ""
    assert quotes.link_quotes(m).count() == len(rows) and quotes.link_quotes(m.limit(0)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, t, "u", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(70)]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[t].depth, got[t].position, got[t].root_turn) == (t, t, 0) for t in range(70))


def test_pipeline_stage_by_stage(spark, tmp_path):
    from leadline.llm import decontam, quality, secret_scan
    from leadline.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    c = quality.train(docs, table(spark, sf, "labels"))
    benchmark = table(spark, sf, "benchmark").collect()
    index = decontam.Passages([r.item_id for r in benchmark], [r.text for r in benchmark], decontam.Q, decontam.RATE)
    enc = secret_scan.vocabulary(corpus_pipeline.RANKS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            scores = dict(zip(want, (c.score(x) for x in quality.features_of(pa.array([r.text for r in want.values()]))), strict=True))
            want = {i: r for i, r in want.items() if scores[i] >= 0.3}
        elif k == 1:
            top = plain_groups([(i, r.text) for i, r in want.items()], 5, 80)
            want = {i: r for i, r in want.items() if top[i] == i}
        elif k == 2:
            want = {i: r for i, r in want.items() if not index.find(r.text)}
        if k < 3:
            assert got == want and docs.columns == columns, name
        elif k == 3:
            assert docs.columns == columns and set(got) == set(want)
            for i, r in want.items():
                base = secret_scan.base_spans(r.text)
                text = secret_scan.redacted(r.text, base + secret_scan.random_spans(r.text, enc, base))
                assert got[i].text == text and got[i].n_chars == len(text) and got[i].source == r.source
            want = got
        else:
            assert set(got) == set(want)
            assert all(got[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and len(got[i].ids) == got[i].n_tokens for i, r in want.items())
    assert 0 < len(got) < 200 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_takes_nulls_repeats_and_any_columns(spark):
    sf = "/root/testdata/sf0.001"
    other = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a fine text", "en", "s", 11, 7, True, "x"), (None, None, None, None, None, None, None, None), (1, "a fine text", "en", "s", 11, 7, True, "x"), (2, "", "en", None, 0, 1, None, "y"), (1, other, "en", "s", 1, 8, False, "z"), (5, other + " tail", "en", "s", 1, 9, False, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, again long, c0 boolean, component_id string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if k == 1:  # two texts of id 1, one of them twice; 5 is like one of them
            assert sorted((str(r.doc_id), r.text or "", str(r.again), str(r.c0)) for r in out.collect()) == sorted([("1", "a fine text", "7", "True"), ("1", other, "8", "False"), ("2", "", "1", "None"), ("None", "", "None", "None")])
        if k < 4:
            assert out.columns == docs.columns
        if k > 1:
            assert out.count() == 6


def test_what_stages_make_for_themselves_goes(spark):
    from leadline.llm import common

    before = {*common._made}
    with common.scratch():
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        assert len({*common._made} - before) == 1 and out.count() > 50
    assert {*common._made} == before


def test_long_words_have_hashes_of_their_own(spark):
    """The sequence of Thue and Morse and its complement have one hash under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 4096):
        one, other = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        df = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {other} y"), (3, f"x {one} y")], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(df, words=3, percent=90).collect()}
        assert got == {1: 1, 2: 2, 3: 1}


def test_mail_keeps_own_lines_whatever_they_are(spark):
    texts = ["run this:\n>>> print(1)\n> quoted in markdown\nend", " > a\n  b\n>\n\n", "\n> x\n", "On Monday, A wrote:\nnothing", None, "after nothing", "", "   ", "after blanks\r\n > z", "From here", ">>", "last"]
    m = spark.createDataFrame([(1, i, "user", t, "x") for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, level string")
    got = {r.turn: r for r in quotes.link_quotes(quotes.as_mail(m), stuffed=True).collect()}
    assert [got[i].text for i in range(len(texts))] == [t or "" for t in texts]
    # a reply to nothing is one to what stands before it; after two that are empty a thread begins
    parents = [None, 0, 1, 2, 3, 3, 5, 5, None, 8, 9, None]
    assert [got[i].parent_turn for i in range(len(texts))][:9] == parents[:9]
    assert quotes.link_quotes(quotes.as_mail(m.limit(0)), stuffed=True).collect() == []
