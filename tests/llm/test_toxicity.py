import math
import random
import re
import time

import numpy as np
import pytest

from siftline.llm import toxicity as tox


def all_segments(s, at=0):
    """By definition: the best segment, then the rest on either side."""
    best, where = 0, None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if s[i:j].sum() > best + 1e-12:
                best, where = s[i:j].sum(), (i, j)
    if where is None:
        return []
    i, j = where
    return all_segments(s[:i], at) + [(at + i, at + j, best)] + all_segments(s[j:], at + j)


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_definition(seed):
    s = np.random.default_rng(seed).normal(-0.2, 1, 40)
    got = tox.segments(s)
    # runs of positives start at their first positive element either way
    want = all_segments(s)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_sparse_scan_equals_dense():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(0, 10**6, 30))
    score = rng.normal(1, 2, 30)
    for _ in range(50):
        h = np.where(rng.random(80) < 0.3, rng.choice(words, 80), -5)
        dense = np.array([score[np.searchsorted(words, x)] if x in words else 0.0 for x in h]) - 0.3
        got, want = tox._scan_doc(h, words, score, 0.3), tox.segments(dense)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_lambda():
    p, s = np.array([0.2, 0.8]), np.array([1.0, -1.0])
    assert tox.solve_lambda(p, s) == pytest.approx(np.log(4))


def corpus(n=600):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    bad = ["vile", "rotten", "foul", "scum", "éugh"]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 300))]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(bad) if rng.random() < 0.7 else rng.choice(clean) for _ in range(8)] + ["Vile", "SCUM"]
        rows.append((k, " ".join(w), "x"))
        if k < 500:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found_and_others_left_alone(spark):
    rows, labels = corpus()
    rows += [(700, None, "x"), (701, "", "x"), (702, "!!!", "x"), (None, rows[0][1], "x"), (rows[0][0], rows[0][1], "x"), (703, "fine " * 100_000 + "vile scum rotten foul vile " + "fine " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels + [(0, 1, 0), (None, 0, 1), (9999, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = tox.passages(docs, lab).collect()
    found = [r.doc_id for r in got]
    assert {k for k in range(600) if k % 4 == 0} | {703, None} <= set(found)
    assert len(set(found) - {703, None} - set(range(0, 600, 4))) <= 2
    long = [r for r in got if r.doc_id == 703]
    assert (long[0].start_word, long[0].end_word) == (100_000, 100_005)
    assert found.count(0) == 2 * found.count(None)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.passages(docs, lab).count() == 0
    assert tox.passages(docs.where("false"), lab).count() == 0


def test_segments_take_linear_time():
    began = time.time()
    falling = np.tile([1.0, -2.0], 50_000)
    assert len(tox.segments(falling)) == 50_000
    assert len(tox.segments(np.tile([1.0, -0.5], 50_000))) == 1
    assert time.time() - began < 1


def brute_force(sample, docs):
    """(id, start, end, score, E value, p value) by definition: words as byte strings, all segments, sums over dictionaries."""
    split = lambda t: re.findall(rb"[a-z0-9_\x80-\xff]+", t.encode().lower())

    def scores(rows):
        t, o = {}, {}
        for label, _, text in rows:
            for w in set(split(text)):
                c = t if label else o
                c[w] = c.get(w, 0) + 1
        n, m = sum(t.values()), sum(o.values())
        words, out = set(t) | set(o), {}
        for w in words:
            x, y = t.get(w, 0), o.get(w, 0)
            f, q = (x / n + y / m) / 2, n / (n + m)
            x1, n1, y1, m1 = x + tox.PRIOR * n * f, n + tox.PRIOR * n, y + tox.PRIOR * m * f, m + tox.PRIOR * m
            odds = math.log(x1 / (n1 - x1)) - math.log(y1 / (m1 - y1))
            e = (x * math.log(x / ((x + y) * q)) if x else 0) + (y * math.log(y / ((x + y) * (1 - q))) if y else 0)
            out[w] = odds * max(0.0, 1 - math.log(len(words) / tox.CHANCE) / max(e, 1e-9))
        return out, o, m

    full, _, m = scores(sample)
    cross = [scores([r for r in sample if r[1] != k])[0] for k in range(tox.FOLDS)]
    mass = []
    for k in range(tox.FOLDS):
        _, o, _ = scores([r for r in sample if r[1] == k])
        mass += [(c / m, cross[k].get(w, 0.0) - tox.DRIFT) for w, c in o.items()]
    assert sum(p * s for p, s in mass) < 0 and any(s > 0 for _, s in mass)
    lam = 1.0
    for _ in range(200):  # Newton from the right side of the root
        f = sum(p * math.exp(lam * s) for p, s in mass) - 1
        lam -= f / sum(p * s * math.exp(lam * s) for p, s in mass)
    n = x = 0.0
    for label, k, text in sample:
        w = split(text)
        if not label and w:
            got = all_segments(np.array([cross[k].get(v, 0.0) - tox.DRIFT for v in w]))
            n, x = n + 1, x + len(w) * math.exp(-lam * max([0.0, *(s for *_, s in got)]))
    out = []
    for i, text in docs:
        w = split(text or "")
        got = all_segments(np.array([full.get(v, 0.0) - tox.DRIFT for v in w])) if w else []
        p, best = 1.0, sorted((s for *_, s in got), reverse=True)
        for r in range(1, len(best) + 1):
            y = lam * sum(best[:r]) - r * math.log(n / x * len(w))
            tail = 1 - math.exp(-math.exp(-y)) if r == 1 else math.exp(-y) * y ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) if y > r else 1.0
            p = min(p, min(tail, 1.0) * 2**r)
        for a, b, s in got:
            e = n / x * len(w) * math.exp(-lam * s)
            if p <= tox.ALPHA and (e <= 1 or s == best[0]):
                out.append((i, a, b, s, e, p))
    return out


def test_fit_and_passages_against_brute_force(spark):
    rng = random.Random(8)
    clean, bad = [f"w{k}" for k in range(60)], ["vile", "scum", "foul"]
    rows, labels = [], []
    for k in range(160):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 40))]
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif k % 17 == 0:
            w.append("foul")
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = [tuple(r) for r in tox.sampled(docs, lab, "doc_id", "text", "toxic", tox.SAMPLE).collect()]
    want = sorted(brute_force(sample, rows))
    got = sorted(tuple(r) for r in tox.passages(docs, lab).collect())
    assert len(want) > 20 and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-6, atol=1e-12)


def test_few_labels_find_most(spark):
    rows, labels = corpus()
    few = [x for x in labels if x[0] < 80]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(few, "doc_id long, quality int, toxic int")
    found = {r.doc_id for r in tox.passages(docs, lab).collect()}
    assert len(found & set(range(80, 600, 4))) > 100 and not {k for k in found if k % 4}


def test_one_class_of_labels_warns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for t in (0, 1):
        with pytest.warns(UserWarning, match="labels"):
            assert tox.passages(docs, spark.createDataFrame([(1, t), (2, t)], "doc_id long, toxic int")).count() == 0
