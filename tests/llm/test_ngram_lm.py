import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftline.llm import ngram_lm as lm


def brute(texts, order):
    """Pure-Python interpolated modified Kneser-Ney; returns a function (history, byte) → p."""
    top = Counter()
    for t in texts:
        b = bytes([lm.START]) * (order - 1) + t.encode() + bytes([lm.END])
        for i in range(order - 1, len(b)):
            top[b[i - order + 1 : i + 1]] += 1
    n = {order: top}
    for k in range(order - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    disc, total, left = {}, defaultdict(int), defaultdict(float)
    for k in n:
        cc = Counter(n[k].values())
        disc[k] = lm.discounts(cc[1], cc[2], cc[3], cc[4])
        for g, c in n[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += disc[k][min(c, 3) - 1]

    def p(g):
        lower = 1 / lm.VOCABULARY if len(g) == 1 else p(g[1:])
        h = g[:-1]
        if not total[h]:
            return lower
        c = n[len(g)][g]
        own = max(c - disc[len(g)][min(c, 3) - 1], 0) / total[h] if c else 0
        return own + left[h] / total[h] * lower

    def log_p(t):
        b = bytes([lm.START]) * (order - 1) + t.encode() + bytes([lm.END])
        return sum(math.log(p(b[i - order + 1 : i + 1])) for i in range(order - 1, len(b)))

    return log_p


def texts(seed=2):
    rng = random.Random(seed)
    out = ["", "x", "été à la mer", "y" * 300, "z" * 300, "ab " * 9000]
    return out + ["".join(rng.choice("abcde é") for _ in range(rng.randrange(0, 300))) for _ in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_matches_pure_python(spark, order):
    ts = texts()
    rows = [(k, t, ["en", "fr", None][k % 3], "x") for k, t in enumerate(ts)] + [(900, None, "en", "x")] + [(1, "x", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").repartition(3)
    for group in (None, "lang"):
        folder = lm.train(df, "text", group, order)
        got = lm.score(df, folder, "doc_id", "text", group, order).collect()
        assert len(got) == len(ts) + 1
        model = {g: brute([t for _, t, x, _ in rows if t is not None and (group is None or x == g)], order) for g in (["en", "fr", None] if group else [""])}
        text = {i: t for i, t, _, _ in rows}
        for r in got:
            want = model[r.grp if group else ""](text[r.id])
            assert r.n == len(text[r.id].encode()) + 1
            assert r.log_p == pytest.approx(want, rel=1e-5)
        # unseen texts back off
        other = spark.createDataFrame([(1, "été qqq\x7f", "en"), (2, "abba", "xx")], "doc_id long, text string, lang string")
        scored = {r.id: r.log_p for r in lm.score(other, folder, "doc_id", "text", group, order).collect()}
        assert scored[1] == pytest.approx(model["en" if group else ""]("été qqq\x7f"), rel=1e-5)
        if group:
            assert scored[2] == pytest.approx(-5 * math.log(lm.VOCABULARY))


def test_shards_agree(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    one = {r.doc_id: r.log_prob for r in lm.perplexity(df).collect()}
    monkeypatch.setattr(lm, "_SHARD_ROWS", 300)
    many = {r.doc_id: r.log_prob for r in lm.perplexity(df).collect()}
    assert one == many


def test_probabilities_sum_to_one():
    log_p = brute(texts(), 3)
    assert log_p("ab") < 0


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lm.perplexity(df).count() == 0
    assert lm.perplexity(df.where("false")).count() == 0


def test_grams_are_windows():
    b, off = np.frombuffer(b"abcd", np.uint8), np.array([0, 3, 3, 4])
    key, first = lm._grams(b, off, 3)
    want = [b"\2\2a", b"\2ab", b"abc", b"bc\3", b"\2\2\3", b"\2\2d", b"\2d\3"]
    assert [int(k).to_bytes(3, "big") for k in key] == want and list(first) == [0, 4, 5, 7]
