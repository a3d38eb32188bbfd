"""The quality classifier on held-out labels, and text scores against a plain model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leadline.llm import ppm, quality
from leadline.llm.queries import op1_quality


def fold(i) -> int:
    return zlib.crc32(str(i).encode()) % 5


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in op1_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(scores[i].score, y) for i, y in labels.items() if scores[i].held_out]
    assert all(scores[i].held_out == (fold(i) == 0) for i in labels) and len(held) > 40
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.85
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scores.values())


def test_dual_coordinate_descent_reaches_the_minimum():
    rng = np.random.default_rng(0)
    xs = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(80)]
    y = np.where(np.array([3 in x or 5 in x for x in xs]), 1, -1)
    values = rng.normal(size=40)
    w, b = quality.dual_coordinate_descent(xs, values, y, cost=1.0, rounds=2000, tolerance=1e-9)

    def loss(w, b):
        m = np.array([values[x] @ w[x] / math.sqrt(len(x) + 1) + b for x in xs])
        return 0.5 * (w @ w + b * b) + np.sum(np.maximum(0, 1 - y * m))

    least = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(scale=0.01, size=40), b + rng.normal(scale=0.01)) >= least - 1e-9


def test_log_count_ratios():
    xs = [np.array([1, 2], np.int32), np.array([2], np.int32), np.array([3], np.int32)]
    r = quality.log_count_ratios(xs, np.array([1, 1, -1]))
    n = 1 << quality.PLACES_BITS
    assert r[2] == pytest.approx(math.log(3 / (n + 3)) - math.log(1 / (n + 1))) and r[3] < 0 < r[1]


def test_shapes_see_repeats_capitals_and_signs():
    same = [set(x.tolist()) for x in quality.features_of(pa.array(["Abc! Def!", "abc! def!", "The The The", "The Cat Sat", "", "x" * 300_000 + " y z"]))]
    assert same[0] != same[1] and same[2] != same[3] and same[4] == set() and len(same[5]) > 0


def plain_features(t: str) -> set:
    """Words, pairs of words and runs of up to three shapes, by plain loops."""
    w = words(t)
    raw = re.findall(r"[^\x20\x09-\x0d]+", t)
    shapes = []
    for k, x in enumerate(raw):
        signs = ["a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in x]
        shapes.append("same" if k and w[k] == w[k - 1] else "".join(c for j, c in enumerate(signs) if not j or c != signs[j - 1]))
    runs = lambda xs, n, kind: {(kind, *xs[k : k + n]) for k in range(len(xs) - n + 1)} if len(xs) >= n else ({(kind, *xs)} if xs else set())
    return runs(w, 1, "w1") | runs(w, 2, "w2") | runs(shapes, 1, "s1") | runs(shapes, 2, "s2") | runs(shapes, 3, "s3")


def test_features_and_scores_are_the_plain_ones(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() if r.text] + ["", "one", "two two", "Ab1! é"]
    plain, places = [plain_features(t) for t in docs], [set(x.tolist()) for x in quality.features_of(pa.array(docs))]
    for a, x in zip(plain, places, strict=True):  # a place can be shared by chance
        assert 0.97 * len(a) - 1 <= len(x) <= len(a)
    for i in range(0, len(docs), 7):
        for j in range(len(docs)):
            both = len(plain[i] & plain[j])
            assert both - 0.03 * len(plain[i]) - 1 <= len(places[i] & places[j]) <= both + 0.02 * len(plain[i]) * len(plain[j]) / 1000 + 3
    rng = np.random.default_rng(1)
    c = quality.Classifier(rng.normal(size=1 << quality.PLACES_BITS), 0.25, 1.5, -0.5)
    for x in places:
        margin = sum(c.weights[p] for p in x) / math.sqrt(len(x) + 1) + 0.25
        assert c.score(np.array(sorted(x), np.int32)) == pytest.approx(1 / (1 + math.exp(-(1.5 * margin - 0.5))))


def test_quality_frames(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, None, 2), (None, "", 3), (3, "BAD!! BAD!! BAD!!", 4), (3, "BAD!! BAD!! BAD!!", 4)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "y"), (3, 0, "y"), (None, 1, "z"), (2, None, "q")], "doc_id long, quality int, text string")
    c = quality.train(docs, labels, learn="fold >= 0")
    got = quality.quality_scores(docs, c).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, None)} and not [r for r in got if r.doc_id is None][0].held_out
    one = quality.train(docs, labels.filter("quality = 1"), learn="fold >= 0")
    assert one.score(np.array([1, 2], np.int32)) == pytest.approx(2 / 3)
    none = quality.train(docs, labels.limit(0))
    assert none.score(np.empty(0, np.int32)) == pytest.approx(0.5)
    assert quality.quality_scores(docs.limit(0), none).count() == 0
    assert quality.good_texts(docs, one).count() == 5


def plain_scores(train: list[str], texts: list[str]):
    """The same model by plain counting: a walk down from the longest context for each symbol."""
    order = ppm.ORDER
    symbols = lambda t: [256] * order + list(t.encode()) + [256]
    seen = defaultdict(Counter)
    for t in train:
        s = symbols(t)
        for p in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[p - k : p])][s[p]] += 1
    for t in texts:
        s, total = symbols(t), 0.0
        for p in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                left = {x: n for x, n in seen.get(tuple(s[p - k : p]), {}).items() if x not in out}
                if not left:
                    continue
                n, d = sum(left.values()), len(left)
                if s[p] in left:
                    total += math.log10(left[s[p]] / (n + d))
                    break
                total += math.log10(d / (n + d))
                out |= set(left)
            else:
                total -= math.log10(257 - len(out))
        yield total


def words(t: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))


@pytest.mark.parametrize("most_nodes, most_words, shard_nodes, shard_keys", [(1 << 22, 1 << 20, 1 << 18, 1 << 20), (300, 5, 200, 50), (0, 0, 15, 10_000)])
def test_scores_are_the_plain_model_s(spark, most_nodes, most_words, shard_nodes, shard_keys):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("aab bc\nABé", k=rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (62, "x" * 3000 + "ÿ" * 5)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fold int, word string")
    got = defaultdict(list)
    for r in ppm.score_texts(docs, most_nodes=most_nodes, most_words=most_words, shard_nodes=shard_nodes, shard_keys=shard_keys).collect():
        got[r.doc_id].append(r)
    train = [t or "" for i, t in rows if fold(i) != 1]
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for (i, t), score in zip(rows, plain_scores(train, [t or "" for _, t in rows]), strict=True):
        own = [*words(t or ""), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(own), sum(counts[w] > 0 for w in own), n)
            assert r.score == pytest.approx(score, rel=1e-6, abs=1e-6) and r.base_score == pytest.approx(base, rel=1e-9)
    assert len(got[61]) == 2 and sum(map(len, got.values())) == len(rows)


def test_probabilities_add_up():
    data = np.frombuffer(b"abracadabra banana", np.uint8)
    keys = next(ppm.grams_of(data, np.array([0, 11, 18])))[2]
    k, c = np.unique(keys, return_counts=True)
    model = ppm.Model(k, c, {n: ppm._summed(k & ppm._mask(n + 1), c) for n in (0, 1)})
    for context in (b"ra", b"zz", b"an", b""):
        s = [256] * (ppm.ORDER - len(context)) + list(context)
        keys = np.zeros(257, np.uint64)
        for x in [*s]:
            keys = (keys << np.uint64(9)) | np.uint64(x)
        keys = (keys << np.uint64(9)) | np.arange(257, dtype=np.uint64)
        assert (10 ** -model.costs(keys)).sum() == pytest.approx(1, abs=1e-5)


def test_shards_are_small_and_know_their_contexts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("aaaab", k=200)) for _ in range(20)] + ["".join(rng.choices("abcdefghij ", k=50)) for _ in range(20)]
    counts = Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for _, _, keys, _ in ppm.grams_of(data, np.array([0, len(data)])):
            counts.update(keys.tolist())
    k = np.array(sorted(counts), np.uint64)
    c = np.array([counts[x] for x in k.tolist()])
    whole = ppm.Model(k, c, {n: ppm._summed(k & ppm._mask(n + 1), c) for n in (0, 1)})
    asked = np.array([rng.choice(k.tolist()) ^ (rng.randrange(512) << 9 * rng.randrange(6)) for _ in range(3000)], np.uint64)
    asked = asked[(asked & np.uint64(511)) <= 256]
    for most in (1, 6, 30, 10_000):
        shards = ppm.Shards(spark.createDataFrame([(int(x), int(n)) for x, n in zip(k, c, strict=True)], "key long, n long"), most)
        own = shards.of(k)
        # one context of five symbols is never divided
        largest = max(Counter((x >> 9) for x in k.tolist()).values())
        assert max(Counter(own.tolist()).values()) <= max(most, largest) and len(set(own.tolist())) == len(shards.above)
        to = shards.of(asked)
        low = {n: ppm._summed(k & ppm._mask(n + 1), c) for n in (0, 1)}
        for s in set(to.tolist()):
            part = ppm.Model(k[own == s], c[own == s], low | shards.low_of(s))
            assert np.allclose(part.costs(asked[to == s]), whole.costs(asked[to == s]), atol=1e-6)


def test_nothing_learnt_and_nothing_there(spark):
    docs = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, round(r.score, 6), r.n_known, r.held_out) for r in ppm.score_texts(docs).collect())
    assert got == [(1, round(-math.log10(257), 6), 0, False), (2, round(-3 * math.log10(257), 6), 0, False)]
    assert ppm.score_texts(docs.limit(0)).count() == 0
