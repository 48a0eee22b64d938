"""Work that once grew as the square of the input, or moved more than it had to."""

import random

from siftline.operators import rank


def _near(rng, n=60):
    """Texts of forty words, copies and near copies of them."""
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        out += [words, list(words), words[:-1] + [f"x{rng.randrange(5)}"]]
    return {k: " ".join(w) for k, w in enumerate(out)}


def test_copies_are_no_pairs_until_the_end(spark):
    from siftline.operators.setjoin import distinct_pairs

    rows = [(k, ["a", "b", None]) for k in range(500)] + [(500, ["c"]), (501, []), (502, None), (503, ["a", "b", "c", None])]
    members, pairs = distinct_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s", 0.7)
    got = {r.id: r.rep for r in members.collect()}
    assert got == {k: 0 for k in range(500)} | {500: 500, 503: 503}
    assert [tuple(r) for r in pairs.collect()] == [(0, 503, 0.75)]


def test_pairs_and_clusters_with_copies(spark):
    texts = _near(random.Random(4))
    df = spark.createDataFrame(sorted(texts.items(), reverse=True), "doc long, t string")
    sets = {k: set(t.split()) for k, t in texts.items()}
    want = {(a, b): v for a in sets for b in sets if a < b and (v := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.7}
    from pyspark.sql import functions as F

    got = rank.similar_pairs(df.select("doc", F.split("t", " ").alias("s")), "doc", "s", 0.7)
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want
    seeds, seed = [], {}
    for i in sorted(sets):
        seed[i] = next((s for s in seeds if (s, i) in want), i)
        if seed[i] == i:
            seeds.append(i)
    assert {r.id: r.seed for r in rank.clusters(df, "doc", "t", 0.7).collect()} == seed


def test_many_queries_are_no_product_of_partitions(spark):
    """2,500 queries, ties, a zero vector, other lengths, nulls and NaN."""
    import numpy as np

    from siftline.operators import vectors

    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=4)]) for k in range(2500)]
    for k in range(0, 60, 2):
        rows[k + 1] = (k + 1, rows[k][1])
    rows += [(2500, [0.0] * 4), (2501, [1.0, 2.0]), (2502, [2.0, 4.0]), (2503, [1.0, None, 1.0, 1.0]), (2504, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.batch_top_k(df, df, 3, 0.0)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = np.array([v for _, v in rows[:2501]])
    n = np.sqrt((x * x).sum(1))
    s = np.divide(x @ x.T, n[:, None] * n, out=np.zeros((2501, 2501)), where=(n[:, None] * n) > 0).round(12)
    for q in range(2501):
        best = sorted((-s[q, k], k) for k in np.argsort(-s[q], kind="stable")[:40] if k != q and s[q, k] >= 0)[:3]
        if q < 2500:
            assert [found[q][i + 1][0] for i in range(3)] == [k for _, k in best]
    assert [found[2500][i][0] for i in (1, 2, 3)] == [0, 1, 2] and found[2501][1][0] == 2502 and len(found[2501]) == 1
    assert not {2503, 2504, None} & (set(found) | {k for v in found.values() for k, _ in v.values()})
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.batch_top_k(odd, odd.where("vec_id = 1"), 2).orderBy("rank").collect()] == [2, 3]


def test_distances_all_at_once():
    from siftline.functions.fuzzy import damerau, damerau_all

    rng = random.Random(1)
    words = [["".join(rng.choice("abcé😀") for _ in range(rng.randrange(9))) for _ in range(800)] + [w] for w in ("", "ab" * 900)]
    assert damerau_all(*words).tolist() == [damerau(a, b) for a, b in zip(*words)] and damerau_all([], []).tolist() == []


def test_distances_come_after_the_distinct(spark):
    """A word that occurs often is compared once, for suggestions and for matches."""
    from siftline.functions import fuzzy

    words = spark.createDataFrame([("thing",), ("thign",), ("other",)] * 40, "word string")
    for got in (fuzzy.suggest(words, "thing"), fuzzy.match_words(words.distinct(), "thing", "damerau_levenshtein")):
        plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        calls = [k for k, x in enumerate(plan) if "EvalPython" in x]
        assert len(calls) == 1 and any("Aggregate" in x for x in plan[calls[0] :])
        assert {r.word for r in got.collect()} >= {"thing", "thign"}


def test_cosines_shuffle_no_tokens(spark):
    """TF-IDF of rows where the text lies: no exchange of (document, token) rows, whole results, repeated ids merged."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from siftline.functions import semantic

    rng = random.Random(3)
    docs = {k: [f"w{min(rng.randrange(1, 60), rng.randrange(1, 60)):02d}" for _ in range(rng.randrange(1, 30))] for k in range(230)}
    docs[7] = docs[100] = docs[0]
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(7, ""), (500, None), (501, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, freq = len(docs), Counter(w for d in docs.values() for w in set(d))
    vec = {k: {w: x for w, c in Counter(d).items() if (x := c / len(d) * math.log(n / (freq[w] + 1))) > 0} for k, d in docs.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    out = semantic.tfidf_similar(df, F.col("id") % 100 == 0, 5)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    for q in (0, 100, 200):
        s = {k: sum(x * vec[q].get(w, 0) for w, x in v.items()) / (norm[k] * norm[q]) for k, v in vec.items() if k != q and norm[k]}
        best = sorted((k for k in s if s[k] > 0), key=lambda k: (-round(s[k], 9), k))[:5]
        assert [got[q, i + 1][0] for i in range(5)] == best and all(abs(got[q, i + 1][1] - s[k]) < 1e-12 for i, k in enumerate(best))
    cos = {r.doc_id: r.cos for r in semantic.query_cosines(df, "w05 w09 absent w05").collect()}
    old = semantic.tokens(df)
    want = {r.doc_id: r.score for r in semantic.similar(semantic.tfidf(old), semantic.query_vector(semantic.idf(old), "w05 w09 absent w05")).collect()}
    assert cos.keys() == want.keys() and all(abs(cos[k] - want[k]) < 1e-12 for k in want)
