"""python -m siftline COMMAND PATH ...: searches a folder from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftline.api import Engine
from siftline.operators import graph
from siftline.sources.sinks import item_json, item_text


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftline")
    sub = p.add_subparsers(dest="command", required=True)
    find = sub.add_parser("find", help="search text")
    find.add_argument("path")
    find.add_argument("pattern")
    mode = find.add_mutually_exclusive_group()
    for m in ("regex", "boolean", "fuzzy", "concept", "count", "semantic"):
        mode.add_argument(f"--{m}", action="store_true")
    find.add_argument("--context", type=int, default=2)
    find.add_argument("--include", action="append")
    find.add_argument("--language", action="append")
    find.add_argument("--ranking", default="hybrid", choices=("hybrid", "relevance", "frequency", "recency", "popularity"))
    find.add_argument("--limit", type=int, default=50)
    find.add_argument("--json", action="store_true")
    for name in ("deps", "symbols", "diagnostics", "analyze"):
        sub.add_parser(name).add_argument("path")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("siftline").getOrCreate()
    if a.command != "find":
        e = Engine.of_tree(spark, a.path)
        out = {"deps": lambda: graph.coupling(e.dependencies()), "symbols": e.symbols, "diagnostics": e.diagnostics, "analyze": e.analyze}[a.command]()
        out.show(200, truncate=False)
        return
    e = Engine.of_tree(spark, a.path, include=a.include, languages=a.language)
    if a.count:
        return e.count(a.pattern).show()
    if a.semantic:
        return e.semantic(a.pattern, limit=a.limit).show(a.limit, truncate=False)
    if a.boolean:
        got = e.boolean(a.pattern, a.context)
    elif a.fuzzy:
        got = e.fuzzy(a.pattern, context=a.context)
    elif a.concept:
        got = e.concept(a.pattern, a.context)
    else:
        got = e.ranked(a.pattern, a.ranking, a.regex, a.context)
    shown = got.limit(a.limit)
    for r in shown.withColumnRenamed("path", "doc_id").select((item_json() if a.json else item_text()).alias("x")).toLocalIterator():
        print(r.x)


if __name__ == "__main__":
    main()
