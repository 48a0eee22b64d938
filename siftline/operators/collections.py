"""Bookmarks, sessions' intents, repositories and metrics: small tables around the searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bookmarks_in(folders: DataFrame, bookmarks: DataFrame, folder: str) -> DataFrame:
    """Bookmarks of a folder; ``folders``: (folder, name), ``bookmarks``: (name, ...)."""
    return bookmarks.join(folders.where(F.col("folder") == folder).select("name").distinct(), "name", "left_semi")


def bookmark_stats(folders: DataFrame, bookmarks: DataFrame) -> DataFrame:
    f = folders.agg(F.countDistinct("folder").alias("folders"), F.count("*").alias("filed"))
    return bookmarks.agg(F.count("*").alias("bookmarks")).crossJoin(f)


_INTENTS = {"debug": "bug error exception fail fix trace", "refactor": "class extract move refactor rename replace", "learning": "doc example help how tutorial what"}


def intents(history: DataFrame, last: int = 5) -> DataFrame:
    """(session_id, intent) of each session's last searches: the keyword group with most hits, exploration if diverse, else general."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last)
    p = F.lower("pattern")
    hits = {k: F.sum(sum((p.contains(x).cast("int") for x in words.split()), F.lit(0))).alias(k) for k, words in _INTENTS.items()}
    g = recent.groupBy("session_id").agg(*hits.values(), (F.countDistinct("pattern") / F.count("*")).alias("diversity"))
    best = F.greatest(*_INTENTS)
    alone = sum(((F.col(k) == best).cast("int") for k in _INTENTS), F.lit(0)) == 1
    named = F.when(F.lit(False), "")
    for k in _INTENTS:
        named = named.when((best > 0) & alone & (F.col(k) == best), k)
    return g.select("session_id", F.coalesce(named, F.when(F.col("diversity") > 0.7, "exploration"), F.lit("general")).alias("intent"))


def repository_health(repos: DataFrame) -> DataFrame:
    """One row: repositories by health and whether they are enabled."""
    return repos.agg(F.count("*").alias("repositories"), F.count_if("enabled").alias("enabled"), *(F.count_if(F.col("health") == h).alias(h) for h in ("healthy", "warning", "error", "unknown")))


def merged_results(results: DataFrame, limit: int = 1000) -> DataFrame:
    """Items of several repositories by file and line, the first ``limit``."""
    return results.orderBy("file", "start_line", "repo").limit(limit)


def metric_trends(metrics: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """(name, before, after, direction): means of the earlier and the later half of each metric, 10 % apart or stable."""
    w = Window.partitionBy(name)
    x = metrics.withColumns({"__r": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)})
    early = F.col("__r") <= F.floor(F.col("__n") / 2)
    g = x.groupBy(F.col(name).alias("name")).agg(F.avg(F.when(early, F.col(value))).alias("before"), F.avg(F.when(~early, F.col(value))).alias("after"))
    r = F.col("after") / F.col("before")
    return g.withColumn("direction", F.when(r > 1.1, "increasing").when(r < 0.9, "decreasing").otherwise("stable"))


def health_score(cpu: Column, memory: Column, errors: Column, seconds: Column) -> Column:
    """100 less penalties for load, memory, errors and slowness, at least 0."""
    s = F.lit(100.0) - F.when(cpu > 90, 30).when(cpu > 70, 15).otherwise(0) - F.when(memory > 90, 30).when(memory > 70, 15).otherwise(0)
    return F.greatest(F.lit(0.0), s - F.when(errors > 0.1, 25).when(errors > 0.05, 10).otherwise(0) - F.when(seconds > 10, 15).when(seconds > 5, 5).otherwise(0))


def entity_quality(named: Column, signature: Column, docstring: Column, lines: Column) -> Column:
    """Additive quality of an entity: name, signature, docstring and a sensible length."""
    s = F.when(named.isNotNull(), 0.2).otherwise(0.0) + F.when(signature.isNotNull(), 0.3).otherwise(0.0) + F.when(docstring.isNotNull(), 0.3).otherwise(0.0)
    return s + F.when(lines.between(3, 100), 0.2).otherwise(0.0)


def entity_text(name: Column, signature: Column, docstring: Column) -> Column:
    """What an entity is embedded by."""
    return F.concat_ws(" ", name, signature, docstring)


def combined_results(parts: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """Results (path, start_line, score, similarity, quality, exact) of several indexes: the first of each place, ranked."""
    every = None
    for k, (name, df) in enumerate(parts.items()):
        x = df.select("path", "start_line", "score", "similarity", "quality", "exact", F.lit(name).alias("source"), F.lit(k).alias("__k"))
        every = x if every is None else every.unionByName(x)
    w = Window.partitionBy("path", "start_line").orderBy("__k")
    one = every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__k")
    rank = 0.3 * F.col("score") + 0.4 * F.col("similarity") + 0.2 * F.col("quality") + F.when(F.col("exact"), 0.1).otherwise(0.0)
    return one.withColumn("rank", rank).orderBy(F.desc("rank"), "path", "start_line").limit(limit)
