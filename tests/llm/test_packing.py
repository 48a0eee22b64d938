import random

import numpy as np
import pytest

from siftline.llm import packing


def test_combinations_fill_the_window():
    got = packing.combinations(6, 3)
    assert sorted(got) == sorted([(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)])


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=(12, 20)), rng.normal(size=12)
        x = packing.nnls(a, b)
        grad = a.T @ (a @ x - b)
        assert (x >= 0).all() and (grad > -1e-6).all() and abs(x @ grad) < 1e-6


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = rng.integers(0, 50, 32) * (rng.random(32) < 0.7)
    used = np.zeros(32, int)
    for parts, n in packing.plan(hist):
        assert sum(parts) <= 32 and n > 0
        for x in parts:
            used[x - 1] += n
    assert (used == hist).all()


def rows():
    rng = random.Random(4)
    out = [(k, " ".join(["w"] * rng.choice([1, 3, 7, 20, 31, 64, 65, 90, 128, 500]))) for k in range(150)]
    return out + [(7, out[7][1]), (None, "a b c"), (None, "a b c"), (900, None), (901, ""), (902, " \n "), (903, "x\ny\tz  " * 5000)]


@pytest.mark.parametrize("slice_rows", [10, 10**6])
def test_packs_against_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(packing, "SLICE", slice_rows)
    data = rows()
    df = spark.createDataFrame([(*r, 5, 6) for r in data], "doc_id long, text string, slot int, n long").repartition(3)
    got = packing.pack(df, window=64, bins=16).collect()
    want = []
    for i, t in data:
        n = len((t or "").split())
        want += [(str(i), k, 64 * k, min(64, n - 64 * k)) for k in range(-(-n // 64))]
    assert sorted((str(r.doc_id), r.piece, r.start_word, r.n_words) for r in got) == sorted(want)
    packs = {}
    for r in got:
        packs.setdefault(r.pack_id, []).append(r)
    assert sorted(packs) == list(range(len(packs)))
    for p in packs.values():
        p.sort(key=lambda r: r.slot)
        assert [r.slot for r in p] == list(range(len(p)))
        assert [r.offset for r in p] == [sum(x.n_words for x in p[:k]) for k in range(len(p))]
        assert p[-1].offset + p[-1].n_words <= 64
    hist = np.zeros(16, int)
    for *_, n in want:
        hist[-(-n // 4) - 1] += 1
    plan = packing.plan(hist)
    assert len(packs) == sum(n for _, n in plan)
    kinds = sorted(tuple(sorted((-(-r.n_words // 4) for r in p), reverse=True)) for p in packs.values())
    assert kinds == sorted(parts for parts, n in plan for _ in range(n))


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert packing.pack(df).count() == packing.pack(df.where("false")).count() == 0
