import random

import numpy as np
import pytest

from siftline.llm import simhash
from siftline.plans.components import connected_components

SCHEMA = "doc_id long, text string, fp string"


def corpus(seed=3, groups=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(60, 400))]
        for c in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(len(w) * rng.choice([0, 2, 4]) // 100):
                w[rng.randrange(len(w))] = word()
            rows.append((g * 100 + c, " ".join(w)))
    return rows


def test_pairs_recall_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus()], SCHEMA)
    fps = simhash.fingerprints(df).select("fp").distinct()
    fp = np.frombuffer(b"".join(bytes(r.fp) for r in fps.collect()), np.uint8).reshape(-1, 16)
    exact = {frozenset((bytes(fp[a]), bytes(fp[b]))) for i, j, _ in simhash.close_pairs(fp, 24) for a, b in zip(i, j)}
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.candidate_edges(fps, pairs=True).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 10


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_recursion_depth_keeps_recall(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    bits = np.unpackbits(base, axis=1)
    for k in range(400):
        bits[k, rng.choice(128, 12, replace=False)] ^= 1
    how = {"depth": depth, "weight": 9, "centres": 64}
    meets = simhash._meets(9, 64, depth, 12)
    long = []
    how["repeats"] = max(1, int(np.ceil(np.log(0.05) / np.log(1 - meets))))
    import pyarrow as pa

    lists, both = [], np.concatenate([base, np.packbits(bits, axis=1)])
    for _ in range(depth - 1):  # every list counts as long
        long.append(np.unique(simhash._walk(how, 1, long)(both)[-1][0]))
    for x in (base, np.packbits(bits, axis=1)):
        seen = [set() for _ in range(400)]
        row = {bytes(v): k for k, v in enumerate(x)}
        for b in simhash._lists(how, 1, long, {})([pa.RecordBatch.from_pydict({"fp": [bytes(v) for v in x]})]):
            for k, f in zip(b.column("list").to_pylist(), b.column("fp").to_pylist()):
                seen[row[f]].add(k)
        lists.append(seen)
    assert np.mean([bool(a & b) for a, b in zip(*lists)]) > 0.88


def settle(fps, near=simhash.NEAR):
    """(id, id of the document that stays) of the copies among sorted (id, th, fp, sketch)."""
    root = simhash._forest(np.frombuffer(b"".join(r[2] for r in fps), np.uint8).reshape(-1, 16), 24)
    stays, out = {}, set()
    for (i, _, _, sketch), r in zip(fps, root):
        for j, other in stays.setdefault(r, []):
            both = [(x, y) for x, y in zip(sketch, other) if x or y]
            if sum(x == y for x, y in both) / max(len(both), 1) >= near:
                out.add((i, j))
                break
        else:
            stays[r].append((i, sketch))
    return out


def test_groups_and_dedup(spark):
    rows = corpus()
    extra = [(9000, None), (9001, ""), (9002, "!!"), (9003, "!!"), (None, rows[0][1]), rows[1], (9004, "ab " * 200_000), (9005, "ab " * 200_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + extra], SCHEMA).repartition(3)
    got = {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(df).collect()}
    assert {(9003, 9002), (9005, 9004)} <= got and (None, rows[0][0] // 100 * 100) in got
    # brute force: components of fingerprints, settled by the sketches in order of (id, text)
    fps = [(r.id, r.th, bytes(r.fp), bytes(r.sketch)) for r in simhash.fingerprints(df).where("fp is not null").distinct().collect()]
    fps.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = settle(fps)
    assert len(got & want) >= 0.98 * len(want) and got <= want
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    gone = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {i for i, _ in rows + extra} - gone)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", ""), (2, "", "")]])
def test_no_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.dedup(df).count() == len(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(500, 560)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_texts_that_share_a_word_are_not_copies(spark):
    rows = [(1, "hello to me an ox"), (2, "we do hello by it"), (3, "hello so go up on"), (4, "Hello so go up on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(df).collect()] == [(4, 3)]
    assert simhash.dedup(df).count() == 3


def test_sketch_estimates_word_jaccard(spark):
    rng = random.Random(5)
    sets = []
    for k in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 300]))]
        sets += [set(base), set(base[: max(1, len(base) * rng.randrange(3, 11) // 10)]) | {f"x{j}" for j in range(rng.randrange(3))}]
    df = spark.createDataFrame([(k, " ".join(sorted(x))) for k, x in enumerate(sets)], "doc_id long, text string")
    got = {r.id: np.frombuffer(r.sketch, np.uint8) for r in simhash.fingerprints(df).collect()}
    off = [simhash.similarity(got[k][None], got[k + 1][None])[0, 0] - len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, 80, 2)]
    assert max(map(abs, off)) < 0.12 and abs(np.mean(off)) < 0.03


def test_chain_goes_on_with_what_is_left(spark):
    """A component whose ends differ: each copy is near the document that it names."""
    words = [f"word{k}" for k in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 130])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, distance=40).collect()
    assert {r.duplicate_of for r in got} - {0} and len(got) > 8
    text = {i: set(t.split()) for i, t in rows}
    gone = {r.doc_id for r in got}
    for r in got:
        assert r.duplicate_of not in gone
        assert len(text[r.doc_id] & text[r.duplicate_of]) / len(text[r.doc_id] | text[r.duplicate_of]) > 0.5


def test_settling_in_blocks_and_parts(spark, monkeypatch):
    """More documents than a task holds, more that stay than a round takes."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(1, 256, (37, 256), dtype=np.uint8)
    rows = []
    for k in range(900):
        x = kinds[k % 37].copy()
        x[rng.choice(256, 20, replace=False)] = 0
        rows.append((b"r" if k % 3 else b"s", False, k, k * 7 % 11, x.tobytes()))
    df = spark.createDataFrame([(bytearray(a), b, c, d, bytearray(e)) for a, b, c, d, e in rows], simhash._MEMBER)
    monkeypatch.setattr(simhash, "GROUP", 50)
    monkeypatch.setattr(simhash, "STARS", 8)
    got = {r.id: r.keep_id for r in simhash.settled(df).collect()}
    first = {}
    assert got == {k: first.setdefault((k % 3 > 0, k % 37), k) for k in range(900)}


def test_long_lists_are_refined_and_split(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    bits = np.unpackbits(np.repeat(base, 30, axis=0), axis=1)
    for k in range(len(bits)):
        bits[k, rng.choice(128, rng.integers(0, 10), replace=False)] ^= 1
    fp = np.unique(np.packbits(bits, axis=1), axis=0)
    df = spark.createDataFrame([(bytearray(v.tobytes()),) for v in fp], "fp binary")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    how = simhash.plan(len(fp))
    long, blocks = simhash.refined(df, how, 11, longest=20)
    assert how["depth"] >= 2 and len(long) == how["depth"] - 1 and len(long[0]) and blocks
    exact = {frozenset((bytes(fp[a]), bytes(fp[b]))) for i, j, _ in simhash.close_pairs(fp, 24) for a, b in zip(i, j)}
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.candidate_edges(df, pairs=True, longest=20).collect()}
    assert found <= exact and len(found) >= 0.98 * len(exact)
