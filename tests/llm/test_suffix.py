import random

import pytest

from siftline.llm import suffix

SCHEMA = "doc_id long, text string, lang string, gram int"


def brute(rows, length):
    docs = sorted({(i is None, i or 0, t, i) for i, t in rows if t is not None})
    seen, words = {}, []
    for _, _, t, i in docs:
        w = t.split()
        marked, origin = set(), {}
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                for x in range(p, p + length):
                    marked.add(x)
                    origin.setdefault(x, []).append(seen[k])
            else:
                seen[k] = i
        words.append((i, t, w, marked, origin))
    return words


def runs(marked):
    out = []
    for x in sorted(marked):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "be", "gam", "délta", "e", "zeta"]) + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (12, 19, 30, 64)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(w) + 1)
            s = rng.choice(shared)
            a = rng.randrange(0, 5)
            w[at:at] = s[a : len(s) - rng.randrange(0, 5)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, "same " * 40), (101, ""), (102, None), (3, rows[3][1]), (None, rows[4][1]), (103, rows[5][1])]
    rows += [(104, " ".join(word() for _ in range(30_000)))]
    return rows


def test_spans_and_text_match_brute_force(spark):
    rows, length = corpus(), 10
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.start_word, r.end_word) for r in suffix.repeats(df, length=length, q=3).collect())
    want, texts = [], {}
    for i, t, w, marked, _ in brute(rows, length):
        want += [(str(i), a, b) for a, b in runs(marked)]
        left = [x for k, x in enumerate(w) if k not in marked]
        if left or not w:
            texts[(i, t)] = left
    assert got == sorted(want) and got
    out = suffix.dedup(df, length=length, q=3)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), (r.text or "").split()) for r in out.collect())
    assert got == sorted([(str(i), v) for (i, _), v in texts.items()] + [("102", [])])


def test_first_id_is_an_origin(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], SCHEMA)
    origin = {i: o for i, _, _, _, o in brute(rows, 10)}
    for r in suffix.repeats(df, length=10, q=3).collect():
        ids = [x for k in range(r.start_word, r.end_word) for x in origin[r.doc_id][k] if x is not None]
        assert r.first_doc_id == (min(ids) if ids else None)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")], [(1, "a b"), (1, "a b")]])
def test_nothing_to_do(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix.repeats(df).count() == 0
    assert suffix.dedup(df).count() == len(set(rows))
