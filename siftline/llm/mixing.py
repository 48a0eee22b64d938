"""Mixing sources to target weights by Poisson replication.

Source s gets the share ``w_s`` of the output: with ``n_s`` of N documents, each
of its documents is repeated ``Poisson(rate_s)`` times, ``rate_s = w_s N / n_s``.
The count is the inverse of the Poisson distribution at a uniform number that is
hashed from seed and document, so it doesn't depend on partitions or order. The
copies are then spread over all partitions by a hash of document and copy, and
sorted by it: a global shuffle that reads its input once.

``weights`` maps sources to weights; those of sources without documents are left
out, and documents of sources that aren't named get no copies. Without it,
``w_s`` is in proportion to ``n_s ** alpha``.

Cases: a null source is a source, named None. A null id draws by the hash of its
text; null and empty texts are documents. Rows that agree in id draw the same
count, each row on its own. Very large rates are inverted over the range of
counts that have any probability at the hash's 48 bits. Empty table: no rows.
Columns that clash with ``copy_col`` raise; others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, SEED = 0.7, 17
_BITS = 48
#: Most sources whose rates are broadcast; beyond, they are joined by shuffle.
FEW_SOURCES = 10_000
_P = "__siftline_"


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """(base, cdf): the count at u is ``base`` plus the number of ``cdf`` values that are ≤ u."""
    if rate <= 0:
        return 0, []
    eps = 2.0**-_BITS
    lo = max(0, int(rate - 9 * math.sqrt(rate) - 9))
    total, out, k = 0.0, [], lo
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        k += 1
        if total >= 1 - eps or k > rate + 9 * math.sqrt(rate) + 60:
            return lo, out


def uniform(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)


def _tables(stats: DataFrame, weights: dict | None, alpha: float) -> list[tuple] | None:
    rows = stats.limit(FEW_SOURCES + 1).collect()
    if len(rows) > FEW_SOURCES:
        return None
    n = {r.source: r.n for r in rows}
    w = {s: (n[s] ** alpha if weights is None else float(weights.get(s, 0.0))) for s in n}
    total, every = sum(w.values()), sum(n.values())
    if not total:
        return [(s, 0, []) for s in n]
    return [(s, *poisson_table(w[s] / total * every / n[s])) for s in n]


def _joined(stats: DataFrame, weights: dict | None, alpha: float) -> DataFrame:
    """The same tables for more sources than the driver takes."""
    spark = stats.sparkSession
    if weights is None:
        w = stats.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        named = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "s string, w double")
        w = stats.join(named, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    t = w.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))

    def tables(it):
        for pdf in it:
            got = [poisson_table(x) for x in pdf["rate"]]
            yield pdf[["source"]].assign(base=[b for b, _ in got], cdf=[c for _, c in got])

    rate = F.when(F.col("tw") > 0, F.col("w") / F.col("tw") * F.col("tn") / F.col("n")).otherwise(0.0)
    return w.crossJoin(t).select("source", rate.alias("rate")).mapInPandas(tables, "source string, base long, cdf array<double>")


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    copy_col: str | None = "copy",
) -> DataFrame:
    """``docs`` replicated and shuffled, with the number of each copy from 0 in ``copy_col`` (None: left out)."""
    if copy_col in docs.columns:
        raise ValueError(f"the documents have a column {copy_col}; name another copy_col")
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string")
    stats = docs.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    tables = _tables(stats, weights, alpha)
    schema = "source string, base long, cdf array<double>"
    side = _joined(stats, weights, alpha) if tables is None else F.broadcast(spark.createDataFrame(tables, schema))
    side = side.select(*(F.col(c).alias(_P + c) for c in ("source", "base", "cdf")))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    u = uniform(key, seed)
    n = F.col(_P + "base") + F.size(F.filter(_P + "cdf", lambda c: c <= F.col(_P + "u"))).cast("long")
    rows = (
        docs.withColumns({_P + "key": key, _P + "u": u})
        .join(side, source.eqNullSafe(F.col(_P + "source")))
        .withColumn(_P + "n", n)
        .where(F.col(_P + "n") > 0)
        .withColumn(_P + "copy", F.explode(F.sequence(F.lit(0), (F.col(_P + "n") - 1).cast("int"))))
        .withColumn(_P + "at", F.md5(F.concat(F.lit(f"{seed}/"), F.col(_P + "copy").cast("string"), F.lit("/"), F.col(_P + "key"))))
    )
    out = [F.col(f"`{c}`") for c in docs.columns] + ([F.col(_P + "copy").alias(copy_col)] if copy_col else [])
    return rows.repartition(F.col(_P + "at")).sortWithinPartitions(_P + "at").select(*out)


#: The same rows in DuckDB, for documents whose ids aren't null.
SQL = f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER () * sum(n) OVER () / n AS rate FROM s),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 200)) AS k)),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 12))::BIGINT / {float(1 << _BITS)!r} AS u FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.k::INTEGER AS copy
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u
"""
