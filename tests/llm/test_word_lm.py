import json
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import ngram_lm, queries, word_lm

S, E = "<s>", ""


def brute(texts, score, leave_out, order=3):
    """Plain-Python word Kneser-Ney: log p of ``score``, whose counts are left out with ``leave_out``."""

    def tables(ts):
        top = Counter()
        for t in ts:
            w = [S] * (order - 1) + [*t.split(), E]
            top.update(zip(*(w[k:] for k in range(order))))
        out = [top]
        for _ in range(order - 1):
            out.append(Counter(g[1:] for g in out[-1]))
        return out

    def disc(t):
        cc = Counter(t.values())
        return ngram_lm.discounts(cc[1], cc[2], cc[3], cc[4])

    d = [disc(t) for t in tables(texts)]
    rest = list(texts)
    if leave_out:
        rest.remove(score)
    counts, sums = tables(rest), []
    for t, dd in zip(counts, d):
        total, left = defaultdict(int), defaultdict(float)
        for g, n in t.items():
            total[g[:-1]] += n
            left[g[:-1]] += dd[min(n, 3) - 1]
        sums.append((total, left))

    w = [S] * (order - 1) + [*score.split(), E]
    out = 0.0
    for g in zip(*(w[k:] for k in range(order))):
        p = 257.0 ** -(len(g[-1].encode()) + 1)
        for k in reversed(range(order)):
            t, (total, left), n = counts[k], sums[k], counts[k][g[k:]]
            ctx = g[k:-1]
            if total[ctx]:
                p = (max(n - d[k][min(n, 3) - 1], 0) if n else 0) / total[ctx] + left[ctx] / total[ctx] * p
        out += math.log(p)
    return out


def texts(seed=4):
    rng = random.Random(seed)
    ws = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(25)]
    out = ["", "  ", "x", "été à la mer", "Te Te Te Te", "ab " * 500]
    return out + [" ".join(rng.choice(ws) for _ in range(rng.randrange(0, 60))) for _ in range(40)]


@pytest.mark.parametrize("leave_out", [False, True])
@pytest.mark.parametrize("group,order", [(None, 3), ("lang", 3), ("lang", 2)])
def test_matches_brute_force(spark, monkeypatch, leave_out, group, order):
    monkeypatch.setattr(word_lm, "_BUCKET", 500)
    monkeypatch.setattr(word_lm, "_SHARD", 1500)
    monkeypatch.setattr(word_lm, "_RUN", 700)
    monkeypatch.setattr(word_lm, "_PIECE", 900)
    rows = [(k, t, ["en", "fr", None][k % 3]) for k, t in enumerate(texts())] + [(900, None, "en"), (1, "x", "fr"), (7, "x", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = word_lm.score(df, group_col=group, leave_out=leave_out, order=order).collect()
    want = []
    for i, t, g in rows:
        if t is not None:
            own = [x for _, x, y in rows if x is not None and (group is None or y == g)]
            want.append((i, len(t.encode()) + 1, brute(own, t, leave_out, order)))
    assert [r[:2] for r in sorted(want)] == [(r.id, r.n) for r in sorted(got, key=lambda r: (r.id, r.n))]
    assert [r[2] for r in sorted(want)] == pytest.approx([r.log_p for r in sorted(got, key=lambda r: (r.id, r.n, r.log_p))], rel=1e-6)


def test_op6_sees_shuffled_words(spark, tmp_path):
    """Words in another order are the same letters, but not the same text."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) + "ation" for _ in range(150)]  # five bytes never hold letters of two stems
    sentences = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(sentences) for _ in range(20))) for k in range(200)]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    spark.createDataFrame([*rows, (1000, " ".join(mixed))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: math.log(r.perplexity) for r in queries.op6_lm_perplexity(spark, str(tmp_path)).collect()}
    assert got[1000] > 1.3 * max(p for k, p in got.items() if k < 1000)


def test_store_keeps_large_counts(tmp_path):
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    values = rng.integers(0, 300, (len(key), 3)) ** rng.integers(1, 5, (len(key), 1))
    word_lm._save(f"{tmp_path}/x", key, values)
    store = word_lm.Store(f"{tmp_path}/x")
    at = rng.permutation(len(key))
    assert (store.values(at) == values[at]).all() and (store.find(key[at]) == at).all()
    assert store.find(key[:3] + np.uint64(1)).tolist() == [-1] * 3
    parts = [np.sort(key), key * np.uint64(3), np.zeros(len(key), np.uint64)]
    assert all((a == b).all() for a, b in zip(word_lm._dec(*word_lm._enc(parts)), parts))


def test_other_texts_by_a_trained_model(spark):
    """N-grams that the model has counted once count as unseen: Kneser-Ney with those pruned never beats the known text."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d", "a b c e", "q r s t"] * 2)], "doc_id long, text string")
    folder = word_lm.train(docs)
    new = spark.createDataFrame([(1, "a b c d"), (2, "a b c zz"), (3, "zz yy xx"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.id: r.log_p / r.n for r in word_lm.score(new, folder=folder, counted=False).collect()}
    assert set(got) == {1, 2, 3, 5} and got[1] > got[2] > got[3]


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    for leave_out in (False, True):
        assert word_lm.score(df, leave_out=leave_out).count() == word_lm.score(df.where("false"), leave_out=leave_out).count() == 0


def test_op5_leaves_a_document_out(spark, tmp_path):
    """Junk that occurs once in a small corpus is familiar only to itself."""
    rng = random.Random(8)
    ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(ws) for _ in range(rng.randrange(50, 400))), "en") for k in range(150)]
    rows += [(1000 + k, "".join(rng.choice("!#$%&QWERTZ0123456789") for _ in range(900)), "en") for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in queries.op5_perplexity_bands(spark, str(tmp_path)).collect()}
    assert not kept & set(range(1000, 1005)) and len(kept) >= 148


def _blobs_of(batches):
    return [(b, *word_lm._dec(size, data)) for batch in batches for b, size, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "data")))]


def test_passes_share_the_pairs(tmp_path, monkeypatch):
    monkeypatch.setattr(word_lm, "_HELD", 300)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 80)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(texts)], names=["grp", "text"])
    blobs = [x for x in word_lm._vocabulary(0, ["en"])([batch])]
    list(word_lm._number(str(tmp_path))(blobs))
    (tmp_path / "vocabulary.json").write_text(json.dumps({"bits": 0, "base": [0], "groups": ["en"]}))
    counted = []
    for turn in range(2):
        got = _blobs_of(word_lm._count(str(tmp_path), 2, 6, turn, 2)([batch]))
        assert got and all(b % 2 == turn for b, *_ in got)
        counted.append(Counter({}))
        for _, a, b, n in got:
            for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
                counted[-1][x, y] += k
    assert not set(counted[0]) & set(counted[1])
    assert sum(counted[0].values()) + sum(counted[1].values()) == 40 * 81
    words = word_lm.Words(str(tmp_path))
    salt = word_lm.K.U(word_lm.group_salt("en"))
    want = Counter()
    for t in texts:
        with np.errstate(over="ignore"):
            h = word_lm._sequence(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), salt)[0]
            row = np.r_[word_lm.K.mix(word_lm.START ^ salt), h]
        ids = [int(words.ids(np.array([x], np.uint64))[0]) for x in row]
        want.update(zip(ids, ids[1:]))
    assert counted[0] + counted[1] == want


def test_sums_of_a_shard_need_memory_for_one_blob(tmp_path):
    n, times = 20_000, 60
    word_lm._save(f"{tmp_path}/v-0", np.arange(n), np.zeros((n, 1), np.int64))
    (tmp_path / "vocabulary.json").write_text(json.dumps({"bits": 0, "base": [0], "groups": ["en"]}))
    blobs = [next(word_lm._split(np.zeros(n, np.int32), [np.arange(n), *([np.ones(n)] * 5)])) for _ in range(times)]
    tracemalloc.start()
    try:
        assert len(list(word_lm._unigrams(str(tmp_path))(blobs))) == 1
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
    assert (word_lm.Store(f"{tmp_path}/u-0").values(np.arange(n)) == times).all()
