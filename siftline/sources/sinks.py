"""Results, history and graphs as JSON, text, CSV and DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def item_json() -> Column:
    """A hit block as JSON; spans as [line, [start, end]]."""
    spans = F.transform("spans", lambda s: F.struct(s["line_no"].alias("line"), F.array(s["start"], s["end"]).alias("columns")))
    return F.to_json(F.struct("doc_id", "start_line", "end_line", "lines", spans.alias("spans")))


def item_text(path: str | Column = "doc_id") -> Column:
    """A hit block as numbered lines below a header."""
    p = F.col(path) if isinstance(path, str) else path
    rows = F.transform("lines", lambda x, i: F.format_string("%6d | %s", (F.col("start_line") + i).cast("int"), x))
    return F.concat(F.format_string("%s:%d-%d\n", p.cast("string"), F.col("start_line"), F.col("end_line")), F.array_join(rows, "\n"))


def write_json(items: DataFrame, path: str) -> None:
    items.select(item_json().alias("value")).write.text(path)


def edges_dot(edges: DataFrame) -> Column:
    return F.format_string('  "%s" -> "%s";', F.col("source").cast("string"), F.col("target").cast("string"))


def write_edges(edges: DataFrame, path: str, fmt: str = "dot") -> None:
    """Edges as DOT lines, JSON rows or CSV."""
    if fmt == "dot":
        edges.select(edges_dot(edges).alias("value")).write.text(path)
    elif fmt == "json":
        edges.write.json(path)
    elif fmt == "csv":
        edges.write.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_history(history: DataFrame, path: str, fmt: str = "json", start: str | None = None, end: str | None = None) -> None:
    """History within a range; arrays joined by semicolons in CSV."""
    h = history
    if start:
        h = h.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        h = h.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if fmt == "json":
        h.write.json(path)
    elif fmt == "csv":
        flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in h.dtypes]
        h.select(*flat).write.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_history(spark: SparkSession, path: str, schema, existing: DataFrame | None = None) -> DataFrame:
    """JSON history; merged, rows of an existing (ts, pattern) are left out."""
    new = spark.read.schema(schema).json(path)
    if existing is None:
        return new
    return existing.unionByName(new.join(existing.select("ts", "pattern"), ["ts", "pattern"], "left_anti"), allowMissingColumns=True)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def validate_backup(spark: SparkSession, path: str, names: list[str]) -> dict[str, int]:
    return {n: df.count() for n, df in restore(spark, path, names).items()}
