import random

import numpy as np
import pytest

from siftline.llm import rule_ensemble as rules


def corpus(n=800):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(20, 200))]
        bad = k % 5 == 0
        if bad:
            w = [[x.upper() + "!!" for x in w], [x + "%%%" for x in w], w[:3] * 40][k // 5 % 3]
        rows.append((k, " ".join(w), "x", 1))
        if k < 500:
            labels.append((k, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = corpus()
    extra = [(900, None, "x", 1), (901, "", "x", 1), (902, " \n", "x", 1), (None, rows[1][1], "x", 1), (1, rows[1][1], "x", 1), (903, "abc defg " * 50_000, "x", 1), (904, "hi", "x", 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, upper string, quality int").repartition(3)
    lab = spark.createDataFrame(labels + [(2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = rules.accept(docs, lab)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert not {900, 901, 902} & set(kept) and kept.count(1) == 2 and None in kept
    held = range(500, 800)
    right = sum((k in set(kept)) == bool(k % 5) for k in held)
    assert right / len(held) > 0.97
    assert {r.doc_id for r in rules.qualities(docs, lab).collect()} == set(kept)


def test_compiled_column_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    got = rules.learn(x, y, ["a", "b", "c"])
    assert got.rules and len(got.rules) < 200
    from pyspark.sql import functions as F

    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    p = [r.p for r in df.select(got.probability({k: F.col(k) for k in "abc"}).alias("p")).collect()]
    col = dict(zip("abc", x.T))
    total = np.full(400, got.intercept)
    for w, conditions in got.rules:
        total += w * np.all([col[n] > b if above else col[n] <= b for n, b, above in conditions], axis=0)
    assert np.allclose(sorted(p), sorted(1 / (1 + np.exp(-total))))
    assert ((1 / (1 + np.exp(-total)) > 0.5) == (y > 0.5)).mean() > 0.95


def test_lasso_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    r = (rng.random((300, 15)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * r[:, 0] + 1))).astype(float)
    b, w = rules.lasso_logistic(r, y, 0.02, steps=4000)
    g = r.T @ (1 / (1 + np.exp(-(b + r @ w))) - y) / 300
    assert (np.abs(g) <= 0.02 + 1e-6).all()
    on = w != 0
    assert on.any() and not on.all() and np.allclose(g[on], -0.02 * np.sign(w[on]), atol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_without_both_classes_all_texts_stay(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    assert [r.doc_id for r in rules.accept(docs, lab).collect()] == [1]
    assert rules.accept(docs.where("false"), lab).count() == 0
