"""Source audit, hard negatives and language-model scores against plain versions."""

import collections
import math
import random
import re
import string
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import recurrent
from glyphlake.llm.hard_negatives import Block, Tree, between, hard_negatives
from glyphlake.llm.lm_scoring import lm_score, score, train
from glyphlake.llm.queries import op12_hard_negatives
from glyphlake.llm.source_audit import shares, source_audit

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def audit(rows, top):
    docs = collections.defaultdict(collections.Counter)
    counts, groups = collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = words(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
        docs[lang].update(set(w))
        counts.update((lang, source, t) for t in w)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        mine = sorted(s for x, s in groups if x == lang)
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        n = {s: {t: counts[lang, s, t] for t in kept} for s in mine}
        p = {s: share(n[s]) for s in mine}
        q = share({t: sum(n[s][t] for s in mine) for t in kept})
        for s in mine:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in mine if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("block", "chunk", "slab"), [(16, 1 << 16, 16), (2, 20, 2), (1, 7, 1)])
def test_source_audit(spark, block, chunk, slab):
    rng = random.Random(3)
    vocabulary = [a + b for a in "abcdefgh" for b in ("", "é", "zz", "日本")] + ["rare" + c for c in "uvwxyz"]
    rows = []
    for i in range(300):
        text = rng.choice([" ", "-1 ", "_"]).join(rng.choice(vocabulary[: rng.randint(2, len(vocabulary))]).title() for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None]), rng.choice([None, "", "s", "S", "é", "zz", "s1"]) if i % 3 else "s", rng.choice([text, text, text, None])))
    rows += [("fr", "only", "le la"), ("it", "a", "x"), ("it", "b", None), *rows[:20]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "chunk": F.lit(2), "term": F.lit("x"), "block": F.lit(0), "total": F.lit(0)})
    got = [tuple(r) for r in source_audit(df.repartition(5), top=7, block=block, chunk=chunk, slab=slab).collect()]
    assert len(got) == len(set(got))
    assert set(got) == audit(rows, 7)


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 5, 10**10, 9 * 10**12], np.int64)
    assert shares(n, 10**13 + 7).tolist() == [1 + 10**9 * (x + 1) // (10**13 + 7) for x in n.tolist()]


def mined(rows, every, positives, negatives):
    usable = []
    for rid, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * y) for y in v]
        if sum(y * y for y in x) <= 2**62 * 0.999:
            usable.append((rid, i, label, x))
    out = collections.Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for rid, i, label, x in usable:
        if i % every:
            continue
        ranked = sorted((-dot(x, y), j, r, m) for r, j, m, y in usable if r != rid)
        for s, j, _, _ in [z for z in ranked if z[3] == label][:positives]:
            found = [z for z in ranked if z[3] != label and 30 * -s <= 100 * -z[0] <= 90 * -s]
            out.update((i, j, k + 1, z[1], -s, -z[0]) for k, z in enumerate(found[:negatives]))
    return out


@pytest.mark.parametrize(("block", "sample"), [(8192, 16384), (40, 300), (7, 64)])
def test_hard_negatives(spark, block, sample):
    rng = np.random.default_rng(5)
    spots = rng.standard_normal((6, 8))
    rows = [(i, int(rng.integers(0, 4)), (spots[rng.integers(6)] + rng.standard_normal(8) * rng.choice([0, 0.05, 0.5])).tolist()) for i in range(600)]
    rows += [(1000, 1, None), (1010, None, [1.0] * 8), (1020, 1, [1.0, None]), (1030, 1, [float("nan")] * 8), (1040, 2, [float("inf")]), (1050, 2, []), (1060, 3, [0.3]), (1070, 2, [1e300] * 8), (1080, 0, [0.1] * 20), (None, 1, [1.0] * 8)]
    rows += rows[:15] + [(i, 3, rows[0][2]) for i in range(2000, 2060)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "norm": F.lit(0), "region": F.lit(1), "rid": F.lit(7)})
    got = collections.Counter(tuple(r) for r in hard_negatives(df.repartition(6), every=10, positives=3, negatives=4, block=block, sample=sample).collect())
    assert got == mined(rows, 10, 3, 4)


def test_hard_negatives_of_great_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, (rng.standard_normal(5) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(120)]
    got = collections.Counter(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=4, block=16).collect())
    assert got == mined(rows, 4, 5, 10)


def test_bounds_of_a_tree_hold_and_leaves_are_left_out():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((4000, 3)) * 200).astype(np.int64)
    top = float((x**2).sum(axis=1).max())
    tree, leaves = Tree.of(x, 5, top)
    d = between(x, tree.points, top)
    low = np.array([[d[rows, node].min() for node in above] for rows, above in zip(leaves, tree.above(), strict=True)])
    high = np.array([[d[rows, node].max() for node in above] for rows, above in zip(leaves, tree.above(), strict=True)])
    q = x[:50]
    least, most = tree.bounds(q, low, high)
    far = np.sqrt((q**2).sum(axis=1)[:, None] + top - 2.0 * (q @ x.T))
    for k, rows in enumerate(leaves):
        assert (far[:, rows].min(axis=1) >= least[:, k] - 1e-6).all()
        assert (far[:, rows].max(axis=1) <= most[:, k] + 1e-6).all()
    # In few dimensions a search of a narrow ring visits few leaves.
    block = Block([(i, i, "a" if i % 2 else "b", v.astype("<i8").tobytes(), int((v**2).sum())) for i, v in enumerate(x)], top)
    far = x[(x**2).sum(axis=1).argmax()]
    asked = [(-1, 0, "b", far.astype("<i8").tobytes(), int((far**2).sum()), [-(2**62)], [2**62])]
    score = np.sort((x @ far)[::2])[::-1]
    assert [r[2] for r in block.search(asked, True, 5)] == score[:5].tolist()
    assert block.visited < len(block.low) / 2


def test_empty_tables(spark, tmp_path):
    assert source_audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    assert hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), every=2).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>"), every=2).count() == 0
    assert lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12_moves_labels(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.0]), (7, 1, [0.9, 0.0]), (1, 2, [0.8, 0.0]), (2, 9, [0.5, 0.1])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect()}
    # 0 and 7 become 2; 7 (label 2) and 1 are positives of 0, and 2 alone has another label.
    dot = lambda a, b: sum(math.floor(256 * np.float32(x)) * math.floor(256 * np.float32(y)) for x, y in zip(a, b, strict=True))
    negative = dot(rows[0][2], rows[3][2])
    assert got == {(0, 7, 1, 2, dot(rows[0][2], rows[1][2]), negative), (0, 1, 1, 2, dot(rows[0][2], rows[2][2]), negative)}


TEXTS = ["the cat sat on the mat", "The dog sat on THE log\n", "a cat and a dog", "le chat est sur le tapis", "\x00 é É 日本", ""]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    grammar = {"a": ["cat", "dog", "é"], "cat": ["sat", "ran"], "dog": ["sat", "ate"], "é": ["ate"], "sat": ["a", "down"], "ran": ["a"], "ate": ["a", "fish"], "down": ["a"], "fish": ["a"]}
    rows = []
    for i in range(400):
        w = ["a"]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(grammar[w[-1]]))
        rows.append((i, " ".join(w).upper() if i % 50 == 0 else " ".join(w)))
    return [*rows, *((1000 + i, t) for i, t in enumerate(TEXTS)), (2000, None), (2001, "word" * 30 + " x " * 700), *rows[:5], (None, "a cat")]


def based(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    cut = [(i, words(t, r"[^\x20\x09-\x0D]+")) for i, t in rows]
    counts, n, ends = collections.Counter(), 0, 0
    for i, w in cut:
        if not held(i):
            counts.update(w)
            n, ends = n + len(w) + 1, ends + 1
    v = len(counts) + (ends > 0)
    return [(i, held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n, sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[x] for x in w), ends])) for i, w in cut]


def test_lm_score(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({"held_out": F.lit(1), "n": F.lit(2), "word": F.lit("x"), "score": F.lit(0), "rid": F.lit(0)}).repartition(3)
    for hot in (1 << 18, 4):  # all counts travel; most are joined
        got = lm_score(df, hot=hot).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        for g, want in zip(sorted(got, key=key), sorted(based(corpus), key=key), strict=True):
            assert tuple(g)[:5] == want[:5]
            assert g.base_score == pytest.approx(want[5], rel=1e-9)
            assert math.isfinite(g.score) and g.score < 0
        again = collections.defaultdict(set)
        for r in got:
            again[r.doc_id].add(round(r.score, 3))
        assert all(len(x) == 1 for x in again.values())
        if hot > 4:
            new = [r for r in got if r.held_out]
            assert len(new) > 30
            assert sum(r.score for r in new) > 0.8 * sum(r.base_score for r in new)


def test_lm_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in lm_score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
        assert math.isfinite(r.score)


def test_lm_probabilities_sum_to_one(spark, corpus):
    """Over the end, every word and one unseen word, after any beginning."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    model = train(df, hot=8, rounds=1)
    known = [r.word for r in model.counts.collect()]
    one = lambda texts: {r.doc_id: r.score for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    # P(begin w end) / P(end | begin w) would need the state; chain two lengths instead: sum over w of P(begin, w) is P(begin).
    tokens = {w: i + 1 for i, w in enumerate(sorted(known, key=lambda w: (-dict((r.word, r.n) for r in model.counts.collect())[w], w))[: len(model.hot_counts)])}
    begin = np.array([tokens.get("a", recurrent.HEAD), tokens.get("cat", recurrent.HEAD)])
    prefix = recurrent.log10_of(model.weights, [begin])[0]
    after = [recurrent.log10_of(model.weights, [np.append(begin, t)])[0] - prefix for t in range(len(model.hot_counts) + 1)]
    head = sum(10**x for x in after)
    tail = 10 ** (recurrent.log10_of(model.weights, [np.append(begin, recurrent.HEAD)])[0] - prefix)
    assert head + tail == pytest.approx(1, abs=1e-4)
    rest = [r.n for r in model.counts.collect() if r.word not in tokens]
    assert sum((n + 1) / model.tail for n in rest) + 1 / model.tail == pytest.approx(1)
    # A text's score is what the steps give, one token at a time.
    text = "a cat zebra"
    t = np.append(begin, [recurrent.HEAD, 0])
    assert one([text])[0] == pytest.approx(recurrent.log10_of(model.weights, [t])[0] - math.log10(model.tail), rel=1e-6)


def _weights(seed):
    rng = np.random.default_rng(seed)
    w = recurrent.Weights.of(rng.integers(1, 50, 300), 70)
    return w.like(w.flat() + rng.standard_normal(w.flat().size).astype(np.float32) * (w.flat() > -1e8) * 0.1)


def test_state_is_carried_through_all_windows():
    w, rng = _weights(1), np.random.default_rng(3)
    texts = [np.append(rng.choice([*range(1, 300), recurrent.HEAD], n), 0) for n in (0, 1, 31, 32, 33, 200, 5, 200)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p = {name: getattr(w, name).astype(np.float64) for name in w.__dataclass_fields__}
    n = recurrent.HIDDEN

    def log_softmax(x):
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    for t, got in zip(texts, recurrent.log10_of(w, texts), strict=True):
        h, last, total = np.zeros(n), 0, 0.0
        for token in t:
            x, g = p["words"][last] @ p["enter"] + p["bias"], h @ p["again"]
            z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
            c = np.tanh(x[2 * n :] + r * g[2 * n :])
            h = (1 - z) * c + z * h
            kind = token // recurrent.WIDTH
            total += log_softmax(h @ p["classes"] + p["class_bias"])[kind]
            if token < recurrent.HEAD:
                total += log_softmax(p["inside"][kind] @ h + p["inside_bias"][kind])[token % recurrent.WIDTH]
            last = token
        assert got == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_gradient_of_a_window(monkeypatch):
    w, rng = _weights(2), np.random.default_rng(4)
    flat = w.flat().astype(np.float64)
    wide = recurrent.Weights(*(x.astype(np.float64) for x in w.each()))

    def like(v):
        out, at = [], 0
        for x in wide.each():
            out.append(v[at : at + x.size].reshape(x.shape))
            at += x.size
        return recurrent.Weights(*out)

    read, token = rng.choice([*range(300), recurrent.HEAD], (6, 4)), rng.choice([*range(300), recurrent.HEAD], (6, 4))
    real = rng.random((6, 4)) < 0.8
    state = rng.standard_normal((4, recurrent.HIDDEN)) * 0.3
    _, _, grad = recurrent.window_gradient(like(flat), state, read, token, real)
    g = grad.flat()
    for i in [*rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 60), *rng.choice(len(g), 10)]:
        if flat[i] < -1e8:
            continue
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (recurrent.window_gradient(like(up), state, read, token, real)[0] - recurrent.window_gradient(like(down), state, read, token, real)[0]) / 2e-5
        assert g[i] == pytest.approx(slope, rel=1e-3, abs=1e-5)


def test_the_weights_are_fitted_to_every_training_token(spark, monkeypatch):
    """However few tokens count as few, the rounds see each token of the training texts, and no other."""
    module, seen = sys.modules[train.__module__], []
    plain = module._pass
    size = lambda rows: sum(len(r.tokens) // 4 - 1 for r in rows.collect())
    monkeypatch.setattr(module, "_pass", lambda dealt, weights, *more: (seen.append(size(dealt)), plain(dealt, weights, *more))[1])
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d " * 40) for i in range(60)], "doc_id long, text string")
    model = train(docs, least=100)
    assert len(seen) == 3 and min(seen) > 0 and sum(seen) == model.tokens


def test_a_pass_takes_many_segments_side_by_side(monkeypatch):
    """The work beside the tokens (moving all weights, each class's arrays) is shared by thousands of them, and each token is learned from once."""
    rng, seen, plain = np.random.default_rng(6), [], recurrent.window_gradient
    monkeypatch.setattr(recurrent, "window_gradient", lambda w, state, read, token, real, *more: (seen.append((read.size, int(real.sum()))), plain(w, state, read, token, real, *more))[1])
    segments = [rng.integers(0, 300, 1 + (k % 2 and 256 or 1 + k % 256)).astype(np.int32) for k in range(1500)]
    tokens = sum(len(x) - 1 for x in segments)
    w = recurrent.fit(_weights(4), segments)
    assert all(np.isfinite(x).all() for x in w.each())
    assert sum(n for _, n in seen) == tokens
    assert len(seen) < tokens / 4000
    assert sum(slots for slots, _ in seen) < 1.15 * tokens


def test_words_are_cut_from_their_bytes():
    from glyphlake.llm.lm_scoring import _words
    from glyphlake.llm.words import word_hashes

    text = "a  日本 é\tx" + "y" * 100 + "\x0b\x0cb\r\n"
    start = word_hashes(text.encode())[1]
    assert _words(text.encode(), start).to_pylist() == text.split()
    assert _words(text.encode(), start[[2, 0]]).to_pylist() == ["é", "a"]
    assert _words(text.encode(), start[:0]).to_pylist() == []
