"""Lines, matches, hit blocks and context over any table of (id, text).

A corpus is a DataFrame with an id and a text column. Everything but exact
regex spans and the string/comment state stays in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def lines(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): lines numbered from 1, split on newlines only."""
    return corpus.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("p", "line")).select(
        id_col, (F.col("p") + 1).cast("long").alias("line_no"), "line"
    )


def split_lines(text: Column) -> Column:
    """Array of lines at any line boundary, without a last empty one."""
    parts = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def occurrences(line: Column, needle: str) -> Column:
    """Starts of the non-overlapping occurrences of a literal in a line."""
    parts = F.split(line, java_quote(needle), -1)
    step = F.lit(len(needle))
    fold = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a.at + F.length(x) + step).alias("at"), F.array_append(a.out, a.at + F.length(x)).alias("out")),
        lambda a: a.out,
    )
    return F.when(F.size(parts) > 1, fold).otherwise(F.array().cast("array<int>"))


def literal_matches(corpus: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, start, end) of a case-sensitive literal, columns from 0."""
    hit = lines(corpus.where(F.col(text_col).contains(needle)), id_col, text_col).where(F.col("line").contains(needle))
    return hit.select(id_col, "line_no", F.explode(occurrences(F.col("line"), needle)).alias("start")).withColumn(
        "end", F.col("start") + len(needle)
    )


def regex_matches(corpus: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, start, end) of a Unicode regex over whole texts; ^ and $ at lines, dot matches newlines.

    A hit over several lines belongs to the line it starts in; its end counts
    from that line's start.
    """

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        import regex

        rx = regex.compile(pattern, regex.MULTILINE | regex.DOTALL | regex.UNICODE)
        for pdf in batches:
            out = []
            for i, text in zip(pdf[id_col], pdf[text_col]):
                if text is None:
                    continue
                starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"] if "\n" in text else [0]
                for m in rx.finditer(text):
                    row = bisect.bisect_right(starts, m.start()) - 1
                    col = m.start() - starts[row]
                    out.append((i, row + 1, col, col + m.end() - m.start()))
            yield pd.DataFrame(out, columns=[id_col, "line_no", "start", "end"])

    kind = corpus.schema[id_col].dataType.simpleString()
    return corpus.select(id_col, text_col).mapInPandas(spans, f"`{id_col}` {kind}, line_no long, start int, end int")


@F.pandas_udf(T.StructType([T.StructField(k, T.BooleanType()) for k in ("in_string", "in_comment", "docstring")]))
def lexical_state(line: pd.Series, column: pd.Series) -> pd.DataFrame:
    """Whether a column of a line lies in a string, a # comment or a triple-quoted string, judged by that line alone."""

    def state(s: str, stop: int) -> tuple[bool, bool, bool]:
        quote, i = "", 0
        while i < min(stop, len(s)):
            here = s[i]
            if quote:
                if here == "\\":
                    i += 2
                    continue
                if s.startswith(quote, i):
                    i += len(quote)
                    quote = ""
                    continue
            elif here == "#":
                return False, True, False
            elif here in "\"'":
                quote = here * 3 if s.startswith(here * 3, i) else here
                i += len(quote)
                continue
            i += 1
        if quote:
            return True, False, len(quote) == 3
        return False, stop < len(s) and s[stop] == "#", False

    return pd.DataFrame([state(a or "", int(b)) for a, b in zip(line, column)], columns=["in_string", "in_comment", "docstring"])


def code_matches(
    matches: DataFrame, corpus: DataFrame, strings: bool = True, comments: bool = True, docstrings: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Matches outside the lexical states that are switched off."""
    if strings and comments and docstrings:
        return matches
    got = matches.join(lines(corpus, id_col, text_col), [id_col, "line_no"]).withColumn("s", lexical_state("line", "start"))
    bad = F.lit(False)
    if not comments:
        bad = bad | F.col("s.in_comment")
    if not docstrings:
        bad = bad | F.col("s.docstring")
    if not strings:
        bad = bad | (F.col("s.in_string") & ~F.col("s.docstring"))
    return got.where(~bad).select(*matches.columns)


def blocks(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, first_line, last_line, hits, spans): hits on the same or adjacent lines form one block."""
    w = Window.partitionBy(id_col).orderBy("line_no", "start", "end")
    new = F.coalesce((F.col("line_no") > F.lag("line_no").over(w) + 1).cast("int"), F.lit(1))
    return (
        matches.withColumn("new", new)
        .withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(id_col, "block")
        .agg(
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
            F.count("*").alias("hits"),
            F.sort_array(F.collect_list(F.struct("line_no", "start", "end"))).alias("spans"),
        )
        .drop("block")
    )


def with_context(hit_blocks: DataFrame, corpus: DataFrame, context: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds start_line, end_line (clamped) and the lines between them."""
    text = corpus.select(id_col, F.split(F.col(text_col), "\n", -1).alias("all_lines"))
    first = F.greatest(F.lit(1), F.col("first_line") - context)
    last = F.least(F.size("all_lines"), F.col("last_line") + context)
    return (
        hit_blocks.join(text, id_col)
        .withColumns({"start_line": first.cast("long"), "end_line": last.cast("long")})
        .withColumn("lines", F.slice("all_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")))
        .drop("all_lines")
    )


def matches(corpus: DataFrame, pattern: str, regex: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return (regex_matches if regex else literal_matches)(corpus, pattern, id_col, text_col)


def search(
    corpus: DataFrame, pattern: str, regex: bool = False, context: int = 3, max_per_file: int | None = None,
    strings: bool = True, comments: bool = True, docstrings: bool = True, restrict: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Hit blocks with context: (id, first_line, last_line, hits, spans, start_line, end_line, lines).

    ``restrict``: (id, start, end) line ranges of which one has to hold a match.
    """
    got = code_matches(matches(corpus, pattern, regex, id_col, text_col), corpus, strings, comments, docstrings, id_col, text_col)
    if restrict is not None:
        r = restrict.select(F.col(id_col).alias("r_id"), F.col("start").alias("r_s"), F.col("end").alias("r_e"))
        got = got.join(r, (F.col(id_col) == F.col("r_id")) & F.col("line_no").between(F.col("r_s"), F.col("r_e")), "left_semi")
    found = blocks(got, id_col)
    if max_per_file is not None:
        w = Window.partitionBy(id_col).orderBy("first_line")
        found = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_per_file).drop("k")
    return with_context(found, corpus, context, id_col, text_col)


def count_only(corpus: DataFrame, pattern: str, regex: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(items, files): hit blocks and documents that have any."""
    b = blocks(matches(corpus, pattern, regex, id_col, text_col), id_col)
    return b.agg(F.count("*").alias("items"), F.countDistinct(id_col).alias("files"))


def highlight(line: Column, spans: Column, left: str = "[", right: str = "]") -> Column:
    """Line with markers around sorted (start, end) spans; spans are clamped and cut where they overlap."""
    n = F.length(line)

    def add(a, s):
        start = F.greatest(a.at, F.least(s.start, n))
        end = F.least(F.greatest(s.end, start), n)
        piece = F.concat(a.out, F.substr(line, a.at + 1, start - a.at), F.lit(left), F.substr(line, start + 1, end - start), F.lit(right))
        return F.when(end > start, F.struct(end.alias("at"), piece.alias("out"))).otherwise(a)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, add, lambda a: F.concat(a.out, F.substr(line, a.at + 1, n)))


def analyze(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: total, blank, comment and code lines, functions, classes, imports, comment ratio."""
    x = lines(corpus, id_col, text_col)
    t = F.trim("line")
    count = lambda c: F.sum(c.cast("long"))
    got = x.groupBy(id_col).agg(
        F.count("*").alias("total_lines"),
        count(t == "").alias("blank_lines"),
        count(t.startswith("#")).alias("comment_lines"),
        count(F.col("line").rlike(r"^\s*(async\s+)?def\s+\w")).alias("functions"),
        count(F.col("line").rlike(r"^\s*class\s+\w")).alias("classes"),
        count(F.col("line").rlike(r"^\s*(import|from)\s+\w")).alias("imports"),
    )
    code = F.col("total_lines") - F.col("blank_lines") - F.col("comment_lines")
    return got.withColumns({"code_lines": code, "comment_ratio": F.round(F.col("comment_lines") / F.greatest(F.col("total_lines"), F.lit(1)), 3)})


def group_by_file(items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, items): each file's items by first line."""
    return items.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "hits"))).alias("items"))


def multi_pattern(corpus: DataFrame, patterns: list[str], operator: str = "OR", regex: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of any pattern (OR), or of any pattern in the texts that have all (AND)."""
    import re

    rx = [p if regex else re.escape(p) for p in patterns]
    pick = corpus
    if operator.upper() == "AND":
        for p in patterns:
            pick = pick.where(F.col(text_col).rlike(f"(?msU){p}") if regex else F.col(text_col).contains(p))
    return blocks(regex_matches(pick, "|".join(f"(?:{p})" for p in rx), id_col, text_col), id_col)
