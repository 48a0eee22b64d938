import pytest

from siftline.operators import collections
from siftline.plans import service


def test_bookmarks_and_intents(spark):
    f = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "folder string, name string")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "name string, n int")
    assert [r.name for r in collections.bookmarks_in(f, b, "a").collect()] == ["x"]
    assert tuple(collections.bookmark_stats(f, b).first()) == (2, 2, 3)
    rows = [("s", "fix bug", 1), ("s", "trace error", 2), ("t", "a", 1), ("t", "b", 2), ("u", "a", 1), ("u", "a", 2), ("v", "rename bug", 1)]
    h = spark.createDataFrame([(i, s, p, k) for i, (s, p, k) in enumerate(rows)], "event_id long, session_id string, pattern string, ts long")
    assert {r.session_id: r.intent for r in collections.intents(h).collect()} == {"s": "debug", "t": "exploration", "u": "general", "v": "exploration"}


def test_health_and_combination(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(True, "healthy"), (False, "error")], "enabled boolean, health string")
    got = collections.repository_health(r).first()
    assert (got.repositories, got.enabled, got.healthy, got.error) == (2, 1, 1, 1)
    v = spark.range(1).select(collections.health_score(F.lit(95), F.lit(75), F.lit(0.2), F.lit(6))).first()[0]
    assert v == 100 - 30 - 15 - 25 - 5
    x = spark.createDataFrame([("p", 1, 1.0, 0.5, 0.5, True), ("q", 1, 0.1, 0.1, 0.1, False)], "path string, start_line int, score double, similarity double, quality double, exact boolean")
    y = x.where("path = 'p'").withColumn("score", F.lit(0.0))
    got = collections.combined_results({"a": x, "b": y}).collect()
    assert [(r.path, r.source) for r in got] == [("p", "a"), ("q", "a")]


def test_result_cache(spark):
    now = [0.0]
    c = service.ResultCache(size=1, seconds=10, clock=lambda: now[0])
    q = lambda: spark.range(5).selectExpr("id * 2 as x")
    assert c.get(q(), "v1").count() == c.get(q(), "v1").count() == 5
    now[0] = 11
    c.get(q(), "v1")
    assert c.stats() == {"entries": 1, "hits": 1, "misses": 2, "hit_rate": pytest.approx(1 / 3)}
    assert c.get(spark.range(3), "v2").count() == 3 and c.stats()["entries"] == 1
    assert c.invalidate("v2") == 1 and c.stats()["entries"] == 0


def test_breaker_and_patterns():
    now = [0.0]
    b = service.CircuitBreaker(2, 10, lambda: now[0])

    def fail():
        raise KeyError

    for _ in range(2):
        with pytest.raises(KeyError):
            b.call(fail)
    with pytest.raises(RuntimeError):
        b.call(int)
    now[0] = 11
    assert b.call(int) == 0 and b.call(int) == 0
    assert service.check_pattern("a+") == [] and len(service.check_pattern("(a+)+")) == 1 and service.check_pattern("(")
    assert service.estimated_seconds(100, 10, regex=True) == 25.0


def test_entry_without_the_pipeline(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=100)
    n, pipeline, within = run.stdout.split()
    assert int(n) > 50 and pipeline == "False" and within == "True"
