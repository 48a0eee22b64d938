from siftline import queries
from siftline.functions import semantic
from siftline.operators import graph, incremental, rank
from siftline.streaming.events import last_per_path


def test_ranked_search_has_no_row_cap(spark, tmp_path):
    text = "\n\n\n\n".join(["a motion"] * 700)
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["ranked_search"](spark, str(tmp_path)).count() == 700


def test_cycles_beyond_sixty_components(spark):
    """Pairs of nodes, each with an edge to every later pair: the least node reaches all."""
    pairs = [(2 * i, 2 * i + 1) for i in range(70)]
    edges = [e for a, b in pairs for e in ((a, b), (b, a))] + [(a, c) for k, (a, _) in enumerate(pairs) for c, _ in pairs[k + 1 :]]
    got = {(r.node, r.component) for r in graph.cycles(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == {(x, a) for a, b in pairs for x in (a, b)}


def test_longest_path_beyond_64(spark):
    assert graph.longest_path(spark.createDataFrame([(k, k + 1) for k in range(66)], "source long, target long")) == 66


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(8)
    sets = {k: {rng.randrange(60) for _ in range(rng.randrange(1, 30))} for k in range(80)}
    for k in range(80, 120):
        sets[k] = set(list(sets[k - 80])) | {rng.randrange(60)}
    sets[120] = set(sets[3])
    df = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets.items()], "id long, s array<string>")
    got = {(r.a, r.b): r.similarity for r in rank.similar_pairs(df, "id", "s", 0.8).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v >= 0.8}


def test_null_hashes_and_ties(spark):
    old = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), (None, "x")], "path string, hash string")
    new = spark.createDataFrame([("a", None), ("b", None), ("d", None)], "path string, hash string")
    assert {tuple(r) for r in incremental.changes(old, new, "path", "hash").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    rows = spark.createDataFrame([("a", "1", 5), ("a", "2", 5), ("a", "0", 4)], "path string, hash string, last_updated int")
    assert [r.hash for r in incremental.latest(rows).collect()] == ["2"]
    got = incremental.refresh(rows, new, new.select("hash"), rows).collect()
    assert {(r.path, r.action) for r in got} == {("a", "compute"), ("b", "compute"), ("d", "compute")}
    events = spark.createDataFrame([("p", "deleted", 1.0), ("p", "created", 1.0), ("q", "modified", 1.0)], "path string, event_type string, ts double")
    assert {(r.path, r.event_type) for r in last_per_path(events).collect()} == {("p", "created"), ("q", "modified")}


def test_similar_each_against_brute_force(spark):
    import math

    v = {0: {"a": 1.0, "b": 2.0}, 1: {"a": 2.0}, 2: {"b": 1.0, "c": 1.0}, 3: {"d": 1.0}, 100: {"c": 3.0, "a": 1.0}}
    df = spark.createDataFrame([(k, t, w) for k, x in v.items() for t, w in x.items()], "doc_id long, token string, weight double")
    got = {(r.query_id, r.doc_id): r.score for r in semantic.similar_each(df, df.where("doc_id % 100 = 0"), 2).collect()}
    norm = {k: math.sqrt(sum(w * w for w in x.values())) for k, x in v.items()}
    for q in (0, 100):
        s = {k: sum(w * v[q].get(t, 0) for t, w in x.items()) / norm[k] / norm[q] for k, x in v.items() if k != q}
        best = sorted((k for k in s if s[k] > 0), key=lambda k: (-round(s[k], 9), k))[:2]
        assert {k for a, k in got if a == q} == set(best) and all(abs(got[q, k] - s[k]) < 1e-12 for k in best)
