"""Analytics over search history: totals, top patterns, trends, sessions.

A history table has the columns ts (timestamp), pattern, session_id, category,
items (long), elapsed_ms and success (double); :func:`from_events` adapts an
event table. All windows end at an ``as_of`` timestamp instead of the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """user = session owner, k of props = pattern, event type = category, value = elapsed; errors fail."""
    return events.select(
        F.col("event_id"),
        F.col("ts"),
        F.get_json_object("props", "$.k").alias("pattern"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.pmod("event_id", F.lit(60))).cast("long").alias("items"),
        F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("success"),
    )


def seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp, with or without a time zone."""
    return F.col(ts).cast("timestamp").cast("double")


def since(history: DataFrame, as_of: str, days: int) -> DataFrame:
    return history.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("searches"), F.countDistinct("pattern").alias("patterns"))


def detailed_stats(history: DataFrame) -> DataFrame:
    """One row: counts, sums, averages, range of time, and the histogram of categories as JSON."""
    total = history.agg(
        F.count("*").alias("searches"),
        F.countDistinct("pattern").alias("patterns"),
        F.sum("items").alias("items"),
        F.avg("items").alias("avg_items"),
        F.avg("elapsed_ms").alias("avg_ms"),
        F.avg("success").alias("avg_success"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    by = history.groupBy("category").agg(F.count("*").alias("n"))
    return total.crossJoin(by.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))).alias("categories")))


def frequent_patterns(history: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent patterns; ties go to the one seen first."""
    g = history.groupBy("pattern").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return g.orderBy(F.desc("n"), "first_ts", "pattern").limit(limit).select("pattern", "n")


def recent_patterns(history: DataFrame, as_of: str, days: int = 7, limit: int = 20) -> DataFrame:
    g = since(history, as_of, days).groupBy("pattern").agg(F.max("ts").alias("last_ts"))
    return g.orderBy(F.desc("last_ts"), "pattern").limit(limit)


def suggestions(history: DataFrame, partial: str, limit: int = 5) -> DataFrame:
    """Distinct patterns that hold a part, most recent first."""
    g = history.where(F.lower("pattern").contains(partial.lower())).groupBy("pattern").agg(F.max("ts").alias("last_ts"))
    return g.orderBy(F.desc("last_ts"), "pattern").limit(limit)


def sessions(history: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, start, end, searches, seconds): runs with no gap longer than ``gap``."""
    g = history.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("searches"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return g.select("session_id", "start", "end", "searches", (seconds("end") - seconds("start")).alias("seconds"))


def session_analytics(history: DataFrame) -> DataFrame:
    s = sessions(history)
    return s.agg(F.count("*").alias("sessions"), F.avg("searches").alias("avg_searches"), F.avg("seconds").alias("avg_seconds"), F.max("searches").alias("most_searches"))


def session_summary(history: DataFrame) -> DataFrame:
    """Per owner: searches, patterns, items, success and time."""
    return history.groupBy("session_id").agg(
        F.count("*").alias("searches"), F.countDistinct("pattern").alias("patterns"), F.sum("items").alias("items"),
        F.avg("success").alias("success"), F.min("ts").alias("start"), F.max("ts").alias("end"),
    )


def compare_sessions(history: DataFrame, one: str, other: str) -> DataFrame:
    """Patterns of two owners: common, and of either alone, with the difference in searches."""
    def of(s: str, name: str) -> DataFrame:
        return history.where(F.col("session_id") == s).agg(F.sort_array(F.collect_set("pattern")).alias(name), F.count("*").alias(f"n_{name}"))

    both = of(one, "a").crossJoin(of(other, "b"))
    size = lambda c: F.size(c).cast("long")
    return both.select(
        size(F.array_intersect("a", "b")).alias("common"), size(F.array_except("a", "b")).alias("only_first"),
        size(F.array_except("b", "a")).alias("only_second"), (F.col("n_a") - F.col("n_b")).alias("more_searches"),
    )


def performance(history: DataFrame) -> DataFrame:
    """Per category: searches, success, slow (over twice the average time) and empty ones."""
    avg = history.agg((2 * F.avg("elapsed_ms")).alias("limit"))
    return history.crossJoin(F.broadcast(avg)).groupBy("category").agg(  # one row
        F.count("*").alias("searches"), F.avg("success").alias("success"),
        F.count_if(F.col("elapsed_ms") > F.col("limit")).alias("slow"), F.count_if(F.col("items") == 0).alias("empty"),
    )


def usage_by_hour(history: DataFrame) -> DataFrame:
    return history.groupBy(F.hour("ts").cast("long").alias("hour"), F.weekday("ts").cast("long").alias("weekday")).agg(F.count("*").alias("searches"), F.avg("success").alias("success"))


def daily_trends(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), F.avg("success").alias("success"), F.avg("elapsed_ms").alias("avg_ms"))


def trend(history: DataFrame) -> DataFrame:
    """Mean daily searches of the earlier and the later half of the active days, and their direction (10 %)."""
    d = daily_trends(history)
    w = Window.orderBy("day")  # one row a day
    half = d.withColumn("k", F.row_number().over(w)).crossJoin(d.agg(F.floor(F.count("*") / 2).alias("half")))
    g = half.agg(F.avg(F.when(F.col("k") <= F.col("half"), F.col("searches"))).alias("before"), F.avg(F.when(F.col("k") > F.col("half"), F.col("searches"))).alias("after"))
    r = F.col("after") / F.col("before")
    return g.withColumn("direction", F.when(r > 1.1, "increasing").when(r < 0.9, "decreasing").otherwise("stable"))


def category_trends(history: DataFrame) -> DataFrame:
    """Searches by week and category, with those of the week before."""
    g = history.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "category").agg(F.count("*").alias("searches"))
    w = Window.partitionBy("category").orderBy("week")
    return g.withColumn("before", F.lag("searches").over(w)).withColumn("shifted", F.coalesce((F.col("searches") > 1.5 * F.col("before")) | (F.col("before") > 1.5 * F.col("searches")), F.lit(False)))


def failed_patterns(history: DataFrame, limit: int = 10) -> DataFrame:
    g = history.groupBy("pattern").agg(F.count("*").alias("total"), F.count_if(F.col("items") == 0).alias("failed")).where("failed > 0")
    return g.withColumn("rate", F.col("failed") / F.col("total")).orderBy(F.desc("failed"), "pattern").limit(limit)


def deduplicate(history: DataFrame, within: float = 2.0, key: str = "pattern") -> DataFrame:
    """Drops a search that repeats its pattern within ``within`` seconds of the last one kept.

    The kept ones depend on each other, so each pattern's times are folded in order.
    """
    t = seconds("ts")
    kept = history.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(t.alias("t"), "event_id"))).alias("all"))
    fold = F.aggregate(
        "all",
        F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<bigint>").alias("ids")),
        lambda a, x: F.when(x.t - a["last"] >= within, F.struct(x.t.alias("last"), F.array_append(a["ids"], x.event_id).alias("ids"))).otherwise(a),
        lambda a: a["ids"],
    )
    return history.join(kept.select(F.explode(fold).alias("event_id")), "event_id", "left_semi")


def categorize(pattern: Column, regex: Column) -> Column:
    """First of eight categories that a pattern falls into."""
    p = F.lower(pattern)
    has = lambda *w: F.lit(False) if not w else p.rlike("|".join(w))
    return (
        F.when(has("def ", "function ", "async def", "lambda"), "function")
        .when(has("class ", "interface ", "struct "), "class")
        .when(has("import ", "from ", "require", "include"), "import")
        .when(has("var ", "let ", "const ", "="), "variable")
        .when(has("#", "//", "/\\*"), "comment")
        .when(p.contains('"') | p.contains("'"), "string")
        .when(regex, "regex")
        .otherwise("general")
    )


def success_score(items: Column, files: Column, elapsed_ms: Column) -> Column:
    """0 without items; else a base, more for few items, for several files and for speed, at most 1."""
    some = 0.3 + F.when(items <= 10, 0.4).when(items <= 50, 0.2).otherwise(0.1) + F.when(files > 1, 0.2).otherwise(0.0) + F.when(elapsed_ms < 100, 0.1).otherwise(0.0)
    return F.when(items > 0, F.least(F.lit(1.0), some)).otherwise(0.0)


def correlations(history: DataFrame, last: int = 5) -> DataFrame:
    """Unordered pairs of different patterns within a session's last ``last`` searches."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    near = F.array(*(F.lag("pattern", k).over(w) for k in range(1, last)))
    p = history.withColumn("near", near).select("pattern", F.explode("near").alias("other")).where("other is not null and other <> pattern")
    return p.select(F.least("pattern", "other").alias("a"), F.greatest("pattern", "other").alias("b")).distinct()


def rate_limited(history: DataFrame, limit: int, within: int) -> DataFrame:
    """Whether each search is within ``limit`` of its session in the last ``within`` seconds."""
    w = Window.partitionBy("session_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp"))).rangeBetween(-1000 * within, Window.currentRow)
    return history.withColumn("allowed", F.count("*").over(w) <= limit)


def metric_summary(metrics: DataFrame, name: str, value: str) -> DataFrame:
    return metrics.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def by_range(history: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    out = history
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    out = out.orderBy(F.desc("ts"), F.desc("event_id"))
    return out.limit(limit) if limit else out


def containing(history: DataFrame, query: str) -> DataFrame:
    return history.where(F.lower("pattern").contains(query.lower()))


def latest_update(history: DataFrame, pattern: str, **columns: Column) -> DataFrame:
    """Sets columns of the latest row of a pattern."""
    w = Window.partitionBy("pattern").orderBy(F.desc("ts"), F.desc("event_id"))
    hit = (F.col("pattern") == pattern) & (F.col("__k") == 1)
    out = history.withColumn("__k", F.row_number().over(w))
    return out.withColumns({k: F.when(hit, v).otherwise(F.col(k) if k in history.columns else F.lit(None)) for k, v in columns.items()}).drop("__k")
