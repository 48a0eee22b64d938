"""Incremental indexing: manifest differences, tag catalogue, tables that are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, action): added, removed or changed between two listings.

    A null hash is a hash of its own. A null key is in no listing. A key that
    occurs twice in a listing gives a row for each pair that differs. Empty
    listings: everything was added, or removed.
    """
    o = old.select(F.col(key).alias("__ok"), F.col(hash_col).alias("__oh")).where("__ok is not null")
    n = new.select(F.col(key).alias("__nk"), F.col(hash_col).alias("__nh")).where("__nk is not null")
    gone, came = F.col("__nk").isNull(), F.col("__ok").isNull()
    j = n.join(o, F.col("__nk") == F.col("__ok"), "full").where(gone | came | ~F.col("__oh").eqNullSafe(F.col("__nh")))
    action = F.when(came, "added").when(gone, "removed").otherwise("changed")
    return j.select(F.coalesce("__nk", "__ok").alias(key), action.alias("action"))


def latest(catalogue: DataFrame, key: str = "path", by: str = "last_updated") -> DataFrame:
    """The last row of each key; of rows of one time, the greatest by the other columns in their order. A null time comes first, a null key is a key."""
    others = [F.desc(f"`{f.name}`") for f in catalogue.schema.fields if f.name not in (key, by) and f.dataType.typeName() != "map"]
    w = Window.partitionBy(key).orderBy(F.desc(by), *others)
    return catalogue.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def refresh(saved: DataFrame, current: DataFrame, cached: DataFrame, tags: DataFrame) -> DataFrame:
    """(path, hash, action) that bring a tag up to date.

    New or changed contents are computed, or tagged where another tag has them;
    gone ones lose the tag, or are deleted where no other row uses them. A null
    hash is a hash of its own that nothing has cached; null paths are left out.
    """
    s = latest(saved).select(F.col("path").alias("sp"), F.col("hash").alias("sh")).where("sp is not null")
    uses = tags.groupBy(F.col("hash").alias("uh")).agg(F.count("*").alias("uses"))
    have = cached.select(F.col("hash").alias("gh")).distinct()
    now = current.select("path", "hash").where("path is not null")
    differs = F.col("path").isNull() | F.col("sp").isNull() | ~F.col("hash").eqNullSafe(F.col("sh"))
    j = now.join(s, F.col("path") == F.col("sp"), "full").where(differs)
    j = j.join(have, F.col("hash") == F.col("gh"), "left").join(uses, F.col("sh") == F.col("uh"), "left")
    gone = F.col("path").isNull()
    action = F.when(gone & (F.col("uses") > 1), "remove_tag").when(gone, "delete").when(F.col("gh").isNotNull(), "add_tag").otherwise("compute")
    return j.select(F.coalesce("path", "sp").alias("path"), F.when(gone, F.col("sh")).otherwise(F.col("hash")).alias("hash"), action.alias("action"))


def merge(table: DataFrame, updates: DataFrame, key: list[str], deletes: DataFrame | None = None) -> DataFrame:
    """Table with the rows of ``updates`` in place of those of the same key, without the keys of ``deletes``."""
    kept = table.join(updates.select(*key).distinct(), key, "left_anti")
    if deletes is not None:
        kept = kept.join(deletes.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def expire(manifest: DataFrame, as_of: float, days: int = 30, uses: int = 5) -> DataFrame:
    """Manifest without entries unused for ``days`` with fewer than ``uses`` accesses."""
    return manifest.where(~((F.col("last_accessed") < as_of - days * 86400) & (F.col("access_count") < uses)))


def cache_stats(manifest: DataFrame) -> DataFrame:
    n = F.count("*")
    return manifest.agg(n.alias("total"), F.count_if(F.col("access_count") > 1).alias("hot"), F.floor(F.sum("access_count") / F.greatest(n, F.lit(1))).alias("avg_access"))


def orphans(contents: DataFrame, tags: DataFrame) -> DataFrame:
    return contents.join(tags.select("hash").distinct(), "hash", "left_anti")


def tag(directory: str, branch: str, artifact: str) -> str:
    return "::".join((directory, branch, artifact))


def parse_tag(value: str) -> tuple[str, str, str]:
    parts = value.split("::")
    if len(parts) != 3:
        raise ValueError(f"not a tag: {value}")
    return parts[0], parts[1], parts[2]


def retrieve(contents: DataFrame, tags: DataFrame, query: str, tag_value: str | None = None, limit: int = 50) -> DataFrame:
    """BM25 of a query's words over tagged contents (path, hash, text); no tag: all."""
    import re

    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    t = tags if tag_value is None else tags.where(F.col("tag") == tag_value)
    rows = contents.join(t.select("hash").distinct(), "hash", "left_semi")
    tok = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    x = rows.withColumn("__tok", tok).withColumn("__n", F.size("__tok"))

    def times(word: str):
        return F.size(F.filter("__tok", lambda y: y == word))

    x = x.withColumns({f"__f{k}": times(w) for k, w in enumerate(words)})
    agg = x.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), *(F.count_if(F.col(f"__f{k}") > 0).alias(f"__d{k}") for k in range(len(words))))
    x = x.crossJoin(F.broadcast(agg))  # one row
    total, every = F.lit(0.0), F.lit(True)
    for k in range(len(words)):
        f, d = F.col(f"__f{k}"), F.col(f"__d{k}")
        total = total + F.log(1 + (F.col("__docs") - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("__n") / F.col("__avg")))
        every = every & (f > 0)
    return x.where(every).withColumn("score", total).orderBy(F.desc("score"), "path").limit(limit).select("path", "hash", "score")
