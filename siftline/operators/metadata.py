"""Metadata predicates, complexity and statistics of files."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)))


def glob_regex(pattern: str) -> str:
    """Java regex of a gitignore-style glob, matched against a whole path or its tail."""
    out, i = "", 0
    p = pattern.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    free = "/" not in pattern.rstrip("/").lstrip("/") and not pattern.startswith("/")
    return ("^(?:.*/)?" if free or pattern.startswith("**/") else "^(?:.*/)?" if not pattern.startswith("/") else "^/?") + out.removeprefix("(?:.*/)?") + ("" if out.endswith(".*") else "(?:/.*)?") + "$"


def glob(path: str | Column, patterns: list[str]) -> Column:
    """Whether a path matches any glob; none: false."""
    if not patterns:
        return F.lit(False)
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


_UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def parse_size(size: str | int | None) -> int | None:
    """Bytes of '1.5KB' and the like (units of 1024)."""
    if size is None or isinstance(size, int):
        return size
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?B?)\s*", size.upper())
    if not m:
        raise ValueError(f"not a size: {size}")
    unit = m[2] if m[2] in _UNITS else m[2] + "B"
    return int(float(m[1]) * _UNITS[unit])


def size_bounds(lo: str | None = None, hi: str | None = None) -> tuple[int | None, int | None]:
    return parse_size(lo), parse_size(hi)


def parse_date(value: str, as_of: datetime) -> float:
    """Epoch seconds of an epoch number, an age such as 7d, 2w, 3m (30 days) or 1y (365), or a date."""
    if re.fullmatch(r"\d+(\.\d+)?", value):
        return float(value)
    if m := re.fullmatch(r"(\d+)([dwmy])", value):
        return (as_of - timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]])).timestamp()
    for form in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(value, form).replace(tzinfo=as_of.tzinfo).timestamp()
        except ValueError:
            continue
    raise ValueError(f"not a date: {value}")


def predicate(
    min_size: int | None = None, max_size: int | None = None, modified_after: float | None = None, modified_before: float | None = None,
    created_after: float | None = None, created_before: float | None = None, min_lines: int | None = None, max_lines: int | None = None,
    author: str | None = None, encoding: str | None = None, language: str | None = None, language_col: str = "lang",
) -> Column:
    """Conjunction of the bounds that are given; a null field fails its bound."""
    c = F.lit(True)
    for name, lo, hi in (("size", min_size, max_size), ("mtime", modified_after, modified_before), ("created", created_after, created_before), ("line_count", min_lines, max_lines)):
        if lo is not None:
            c = c & (F.col(name) >= lo)
        if hi is not None:
            c = c & (F.col(name) <= hi)
    for name, rx in (("author", author), ("encoding", encoding)):
        if rx is not None:
            c = c & F.col(name).rlike(f"(?i){rx}")
    return c & (F.col(language_col) == language) if language is not None else c


def _lines_with(text: Column, words: list[str]) -> Column:
    rx = rf"\b({'|'.join(words)})\b"
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rx)))


def complexity_basic(text: Column, keywords: list[str]) -> Column:
    """Mean of lines / 100 and lines with keywords / 20, each at most 1."""
    n = F.size(F.split(text, "\n", -1))
    return (F.least(F.lit(1.0), n / 100.0) + F.least(F.lit(1.0), _lines_with(text, keywords) / 20.0)) / 2


def file_complexity(text: Column) -> Column:
    """Weighted counts of lines, branches, handlers, functions and classes, at most 100."""
    full = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""))
    n = lambda *w: sum((F.regexp_count(text, F.lit(x)) for x in w[1:]), F.regexp_count(text, F.lit(w[0])))
    return F.least(F.lit(100.0), 0.1 * full + 0.5 * n("if ", "for ", "while ") + 0.3 * n("try:", "except") + 0.2 * n("def ", "function ") + 0.4 * n("class "))


def stats(files: DataFrame, by: str, size_col: str = "size") -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum(size_col).alias("size"), F.avg(size_col).alias("avg_size"))


def query_files(files: DataFrame, patterns: list[str] | None = None, where: Column | None = None, limit: int | None = None, offset: int = 0, path_col: str = "path") -> DataFrame:
    out = files if where is None else files.where(where)
    if patterns:
        out = out.where(glob(path_col, patterns))
    out = out.orderBy(path_col).offset(offset)
    return out.limit(limit) if limit is not None else out


def query_entities(entities: DataFrame, types: list[str] | None = None, names: list[str] | None = None, languages: list[str] | None = None, has_docstring: bool | None = None) -> DataFrame:
    out = entities
    if types:
        out = out.where(F.col("entity_type").isin(types))
    if names:
        out = out.where(F.exists(F.array(*map(F.lit, names)), lambda n: F.lower("name").contains(F.lower(n))))
    if languages:
        out = out.where(F.col("language").isin(languages))
    if has_docstring is not None:
        out = out.where(F.col("docstring").isNotNull() if has_docstring else F.col("docstring").isNull())
    return out
