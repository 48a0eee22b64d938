import numpy as np
import pytest

from siftline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def vectors(n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    x = (centre[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, d))).astype(np.float32)
    x[5:9] = x[4]
    x[20] = -x[21]
    return x


def brute(rows, k):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.rint(x @ x.T * 1e9)
    out = []
    for q in range(len(rows)):
        best = sorted((-s[q, v], ids[v] is None, ids[v] or 0) for v in range(len(rows)) if v != q)[:k]
        out += [(str(ids[q]), r + 1, str(None if a else v), -c / 1e9) for r, (c, a, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16, 50, 1024])
def test_every_row_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    good = [(k, v.tolist(), 0, 1) for k, v in enumerate(vectors())] + [(None, [1.0] * 8, 0, 1)]
    bad = [(900, None, 0, 1), (901, [0.0] * 8, 0, 1), (902, [float("nan")] * 8, 0, 1), (903, [1.0], 0, 1), (904, [None] * 8, 0, 1), (905, [], 0, 1), (906, [float("inf")] + [0.0] * 7, 0, 1)]
    df = spark.createDataFrame(good + bad + [good[3]], SCHEMA).repartition(3)
    got = sorted((str(r.query_id), r.rank, str(r.vec_id), r.score) for r in topk.top_k(df, 7).collect())
    want = brute(good, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    d, n = 4, 1000
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
    q = x[:40]
    top = topk._Top(40, 5)
    seen = []
    real = np.unique

    topk.search_shard(q, top, np.arange(n), x, lists, np.arange(40), own=True)
    first = top.id.copy()
    # with the answer known, the lists are read only to a shallow depth
    try:
        topk.np.unique = lambda a, *r, **k: seen.append(np.size(a)) or real(a, *r, **k)
        topk.search_shard(q, top, np.arange(n) + 10_000, x, lists, np.arange(40), own=True)
    finally:
        topk.np.unique = real
    s = q @ x.T
    s[np.arange(40), np.arange(40)] = -9
    assert (first == np.argsort(-s, axis=1)[:, :5]).all()
    assert len(seen) > 1 and min(seen[1:]) < n


@pytest.mark.parametrize("rows", [[], [(1, None, 0, 1)], [(1, [1.0, 2.0], 0, 1)]])
def test_no_neighbours(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert topk.top_k(df).count() == 0
    assert topk.top_k(df).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("near", [0.0, 1e-7])
def test_other_shards_are_ranked_in_single_precision(monkeypatch, near):
    rng = np.random.default_rng(2)
    d, n, k = 64, 500, 7
    x = rng.normal(size=(4 * n, d))
    if near:  # scores that single precision can't tell apart, in every shard
        x = x[rng.integers(0, 150, 4 * n)] + near * rng.normal(size=(4 * n, d))
        x[::50] = x[7]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(4 * n)
    whole = []
    real = topk._best
    monkeypatch.setattr(topk, "_best", lambda keys, k: whole.append(keys.shape) or real(keys, k))
    top = topk._Top(n, k)
    for s in range(4):
        part = slice(s * n, (s + 1) * n)
        lists = np.argsort(-x[part], axis=0, kind="stable").T.astype(np.int32)
        topk.search_shard(x[:n], top, ids[part], x[part], lists, np.arange(n), own=s == 0)
        if s == 0:
            first = len(whole)
    score = np.rint(np.einsum("ij,kj->ik", x[:n], x) * 1e9).astype(np.int64)
    score[np.arange(n), np.arange(n)] = -(2**62)
    want = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    assert (np.abs(top.score - np.take_along_axis(score, want, 1)) <= 1).all()
    if not near:
        assert (top.id == ids[want]).all()
        assert len(whole) == first  # after the own shard, no shard is ranked whole
