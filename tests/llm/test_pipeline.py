import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siftline.llm import mixing, packing, rule_ensemble, simhash
from test_mixing import brute as brute_mix
from test_simhash import corpus as near_copies
from test_suffix import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"shared{k}" for k in range(70))
    docs, labels = [], []
    for n, (i, t) in enumerate(near_copies(seed=9, groups=120)):
        kind = n % 6
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 1:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        docs.append((i, t, "en", rng.choice(["a", "a", "a", "b", "c"]), len(t)))
        labels.append((i, int(kind != 0), 0))
    docs += [(90_000, None, "en", "a", None), (90_001, "", None, None, 0), docs[7], (90_002, "tiny text", "en", None, 9)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def statistics(t):
    n, words = len(t), len(re.findall(r"\S+", t))
    share = lambda x, of: x / of if of else 0.0
    count = lambda rx: len(re.findall(rx, t))
    return {
        "chars": math.log1p(n), "word_length": share(n, words), "upper": share(count("[A-ZÀ-ÖØ-Þ]"), n), "digits": share(count("[0-9]"), n),
        "marks": share(count(r"[!-/:-@\[-`{-~]"), n), "signs": share(count(r"[!#$%&*+<=>@^|~]"), n),
        "distinct": share(len(set(re.split(r"\s+", t))), words), "line_length": share(n, t.count("\n") + 1),
    }


def test_stages_and_run_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    step = dict(corpus_pipeline.STAGES)
    assert list(step) == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing to target weights", "packing"]

    rules = rule_ensemble.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    good = []
    for r in rows:
        if r[1] and r[1].strip():
            s = statistics(r[1])
            total = rules.intercept + sum(w for w, cs in rules.rules if all(s[n] > b if above else s[n] <= b for n, b, above in cs))
            if total >= 0:
                good.append(r)
    out = step["quality classifier"](spark, docs, tables)
    assert out.columns == columns and Counter(map(tuple, out.collect())) == Counter(good)
    assert not any("!!" in r[1] for r in good) and len(good) > 0.75 * len(rows)

    one = list(dict.fromkeys(good))
    df = spark.createDataFrame(one, SCHEMA)
    fps = {(r.id, r.th): bytes(r.fp) for r in simhash.fingerprints(df).collect()}
    keys = sorted(fps, key=lambda k: (k[0] is None, k[0], k[1]))
    root = simhash._forest(np.frombuffer(b"".join(fps[k] for k in keys), np.uint8).reshape(-1, 16), simhash.DISTANCE)
    ids = {keys[k][0] for k in range(len(keys)) if root[k] == k}
    kept = [r for r in one if r[0] in ids]
    out = step["SimHash near-dedup"](spark, spark.createDataFrame(good, SCHEMA), tables)
    got = [tuple(r) for r in out.collect()]
    gone = len(one) - len(kept)
    assert out.columns == columns and set(kept) <= set(got) and len(set(got)) == len(got)
    assert len(got) - len(kept) <= 0.1 * gone and gone > 10
    kept = got

    want = []
    by_id = {(r[0], r[1]): r for r in kept}
    for i, t, w, marked, _ in brute_repeats([(r[0], r[1]) for r in kept], 50):
        left = [x for k, x in enumerate(w) if k not in marked]
        if left or not w:
            want.append((by_id[i, t], left))
    out = step["suffix-array dedup"](spark, spark.createDataFrame(kept, SCHEMA), tables)
    clean = [tuple(r) for r in out.collect()]
    assert out.columns == columns
    assert sorted((r[0], r[1].split(), r[2], r[3]) for r in clean) == sorted((r[0], left, r[2], r[3]) for r, left in want)
    assert all(r[4] == len(r[1]) for r in clean) and sum("shared9 " in r[1] for r in clean) == 1

    out = step["mixing to target weights"](spark, spark.createDataFrame(clean, SCHEMA), tables)
    mixed = [tuple(r) for r in out.collect()]
    expected = Counter()
    for k, n in brute_mix(clean, None, mixing.ALPHA, mixing.SEED).items():
        expected[k[:-1]] += n
    assert out.columns == columns and Counter(mixed) == expected

    packs = step["packing"](spark, spark.createDataFrame(mixed, SCHEMA), tables).collect()
    check_packs(packs, mixed)
    final = corpus_pipeline.run(spark, tables).collect()
    check_packs(final, mixed)
    assert len(final) == len(packs)


def check_packs(packs, docs):
    w = packing.WINDOW
    want = Counter((r[0], k, min(w, len(r[1].split()) - k * w)) for r in docs for k in range(-(-len(r[1].split()) // w)))
    assert Counter((p.doc_id, p.piece, p.n_words) for p in packs) == want
    room = Counter()
    for p in packs:
        room[p.pack_id] += p.n_words
    assert max(room.values()) <= w
    hist = np.zeros(packing.BINS, np.int64)
    for (_, _, n), c in want.items():
        hist[-(-n // (w // packing.BINS)) - 1] += c
    assert len(room) == sum(n for _, n in packing.plan(hist))
