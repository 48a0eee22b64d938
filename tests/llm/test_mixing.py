import hashlib
from collections import Counter

import duckdb
import pytest

from siftline.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = [(k, f"text {k}", "en", ["a", "a", "a", "b", None][k % 5], 5) for k in range(2000)]
    return out + [(None, "no id", "en", "b", 1), (5, None, None, "b", None), (5, "", None, "a", None), out[3]]


def brute(data, weights, alpha, seed):
    n = Counter(r[3] for r in data)
    w = {s: n[s] ** alpha if weights is None else weights.get(s, 0) for s in n}
    table = {s: mixing.poisson_table(w[s] / sum(w.values()) * len(data) / n[s]) for s in n}
    out = Counter()
    for r in data:
        key = str(r[0]) if r[0] is not None else "t" + hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / 2**48
        base, cdf = table[r[3]]
        for c in range(base + sum(x <= u for x in cdf)):
            out[(*r, c)] += 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1, None: 3}, {"zzz": 1}, {"b": 1, None: 1e-3, "a": 50}])
@pytest.mark.parametrize("few", [10_000, 1])
def test_counts_against_brute_force(spark, monkeypatch, weights, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    if weights == {"zzz": 1}:
        assert mixing.mix(df, weights).count() == 0
        return
    got = Counter(tuple(r) for r in mixing.mix(df, weights, seed=4).collect())
    assert got == brute(rows(), weights, mixing.ALPHA, 4)


def test_shares_meet_the_weights(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = Counter(r.source for r in mixing.mix(df, {"a": 1, "b": 1, None: 2}).collect())
    assert all(abs(got[s] / 2004 - w) < 0.05 for s, w in (("a", 0.25), ("b", 0.25), (None, 0.5)))


def test_order_is_shuffled_and_repeatable(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = [r.doc_id for r in mixing.mix(df).collect()]
    b = [r.doc_id for r in mixing.mix(df.repartition(5)).collect()]
    assert a == b and a != sorted(a, key=lambda x: x or 0)


@pytest.mark.parametrize("rate", [1e-9, 0.3, 1.0, 40.0, 5e5])
def test_table_is_the_distribution(rate):
    base, cdf = mixing.poisson_table(rate)
    mean = base + sum(1 - c for c in cdf)
    assert mean == pytest.approx(rate, rel=1e-6, abs=1e-12) and len(cdf) < 20 * rate**0.5 + 80


def test_sql(spark):
    documents = spark.createDataFrame([r for r in rows() if r[0] is not None], SCHEMA).toPandas()  # noqa: F841
    want = Counter(map(str, duckdb.sql(mixing.SQL).fetchall()))
    df = spark.createDataFrame([r for r in rows() if r[0] is not None], SCHEMA)
    got = Counter(str(tuple(r)) for r in mixing.mix(df).collect())
    assert sum(got.values()) == sum(want.values())


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df.selectExpr("*", "1 as copy"))
    assert mixing.mix(df.selectExpr("*", "1 as copy"), copy_col=None).columns == [*SCHEMA.replace(",", "").split()[::2], "copy"]
