"""Chunks of texts: line windows, greedy line packing, structural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(corpus: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_line, end_line, content): every ``size`` lines, ``overlap`` of them shared with the next."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than size")
    x = corpus.select(id_col, F.split(text_col, "\n", -1).alias("l"))
    s = x.select(id_col, "l", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(size - overlap))).alias("s"))
    return s.select(id_col, F.col("s").cast("long").alias("start_line"), F.least(F.col("s") + size - 1, F.size("l")).cast("long").alias("end_line"), F.array_join(F.slice("l", F.col("s"), F.lit(size)), "\n").alias("content"))


_EDGES = {
    "python": r"^(?:async\s+def|def|class)\s|^@\w",
    "javascript": r"^(?:export\s+)?(?:async\s+)?(?:function|class)\s|^(?:const|let|var)\s+\w+\s*=",
    "java": r"^\s{0,4}(?:public|private|protected|class|interface|enum)\b",
    "": r"^\S.*[{:]\s*$",
}


def _pack(lines: list[str], size: int, edge: re.Pattern | None) -> list[tuple[int, int, str]]:
    out, start, used = [], 0, 0
    for i, line in enumerate(lines):
        over = used + len(line) + 1 > size and i > start
        if over or (edge and i > start and edge.match(line) and used > size // 4):
            cut = i
            if over and not edge:  # back to a blank line in the later half
                blank = next((k for k in range(i, start + (i - start) // 2, -1) if not lines[k - 1].strip()), None)
                cut = blank or i
            out.append((start, cut))
            start = cut
            used = sum(len(x) + 1 for x in lines[start:i])
        used += len(line) + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return [(a + 1, b, "\n".join(lines[a:b])) for a, b in out]


def greedy(corpus: DataFrame, size: int = 1500, strategy: str = "basic", language_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start_line, end_line, content, size): lines packed up to ``size`` characters.

    ``basic`` cuts back at a blank line; ``structural`` also cuts before definitions.
    Empty chunks don't occur; a longer line is a chunk of its own.
    """
    kind = corpus.schema[id_col].dataType.simpleString()
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(language_col) if language_col else F.lit("")).alias("language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = {k: re.compile(v) for k, v in _EDGES.items()}
        for pdf in batches:
            out = []
            for i, t, lang in zip(pdf["id"], pdf["text"], pdf["language"]):
                if not t:
                    continue
                edge = edges.get(lang or "", edges[""]) if strategy == "structural" else None
                out += [(i, k, a, b, c, len(c)) for k, (a, b, c) in enumerate(_pack(t.split("\n"), size, edge))]
            yield pd.DataFrame(out, columns=["id", "chunk", "start_line", "end_line", "content", "size"])

    return rows.mapInPandas(run, f"id {kind}, chunk int, start_line long, end_line long, content string, size long").withColumnRenamed("id", id_col)


def quality(size: Column, largest: int, kind: Column, named: Column, dependencies: Column) -> Column:
    """Size in range, kind of code, a named entity and dependencies; between 0 and 1."""
    r = size / float(largest)
    fit = F.when(r.between(0.3, 1.0), 0.3).when(r > 1.0, F.greatest(F.lit(0.0), 0.3 - (r - 1.0) * 0.3)).otherwise(0.0)
    code = F.when(kind.isin("function", "class", "method"), 0.4).when(kind.isin("block", "statement"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), fit + code + F.when(named, 0.2).otherwise(0.0) + F.when(dependencies, 0.1).otherwise(0.0))


def best(chunks: DataFrame, most: int, least_quality: float, id_col: str = "doc_id") -> DataFrame:
    """Chunks of enough quality (or a file's only one), the best ``most`` a file, in line order."""
    w = Window.partitionBy(id_col)
    c = chunks.withColumn("__n", F.count("*").over(w)).where((F.col("quality") >= least_quality) | (F.col("__n") == 1))
    return c.withColumn("__r", F.row_number().over(w.orderBy(F.desc("quality"), "start_line"))).where(F.col("__r") <= most).drop("__n", "__r")


def merge_similar(chunks: DataFrame, size: int, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """Neighbouring chunks join while they are similar to what was joined and fit; nothing is lost."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("start_line").itertuples(index=False):
            words = set(re.findall(r"\w+", r.content.lower()))
            if out:
                last = out[-1]
                both = last[4] | words
                if both and len(last[4] & words) / len(both) > threshold and len(last[3]) + 1 + len(r.content) <= 1.5 * size:
                    last[2], last[3], last[4] = r.end_line, last[3] + "\n" + r.content, both
                    continue
            out.append([getattr(r, id_col), r.start_line, r.end_line, r.content, words])
        return pd.DataFrame([x[:4] for x in out], columns=[id_col, "start_line", "end_line", "content"])

    return chunks.select(id_col, "start_line", "end_line", "content").groupBy(id_col).applyInPandas(run, f"`{id_col}` {kind}, start_line long, end_line long, content string")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: count, sum, mean, extremes and upper median of sizes."""
    n = F.col("chunks")
    s = chunks.agg(F.count("*").alias("chunks"), F.sum("size").alias("total"), F.avg("size").alias("mean"), F.min("size").alias("least"), F.max("size").alias("most"))
    w = Window.orderBy("size")
    ranked = chunks.groupBy("size").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w))  # a row a distinct size
    med = ranked.crossJoin(F.broadcast(s.select("chunks"))).where(F.col("upto") > F.floor(n / 2)).agg(F.min("size").alias("median"))
    return s.crossJoin(med)
