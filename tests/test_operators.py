import re

import duckdb
import pytest

from siftline.functions import fuzzy, languages, semantic
from siftline.operators import boolean, chunks, code, graph, history, incremental, metadata, rank, text, vectors
from siftline.sources import sinks, tree
from siftline.streaming import events

PY = '''import os
from a.b import c as d


class Base:
    pass


class Main(Base):
    """Doc."""

    def run(self, x):
        return helper(x)  # idiot "quoted"


@deco
async def helper(y):
    s = "run # not a comment"
    return y


LIMIT = 3
'''


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "src/main.py", PY, "python"), (2, "lib/x.js", "import a, {b} from 'm'\nfunction foo() {\n  return 1;\n}\nconst q = require(\"z\")\n", "javascript"), (3, "t.txt", "foo\nbar foo foo\n\nfoo", ""), (4, "e.txt", "", ""), (5, "n.txt", None, ""), (6, "bad.py", "def broken(:\nimport zz as y\nfrom .q import w\n", "python")]
    return spark.createDataFrame(rows, "doc_id long, path string, text string, language string").cache()


def test_literal_and_regex_agree(corpus):
    a = sorted(map(tuple, text.literal_matches(corpus, "foo").collect()))
    b = sorted(map(tuple, text.regex_matches(corpus, "foo").collect()))
    assert a == b and (3, 2, 4, 7) in a and (3, 2, 8, 11) in a


def test_regex_spans_lines(corpus):
    got = text.regex_matches(corpus.where("doc_id = 3"), r"^bar.*?\n\nfoo$").collect()
    assert [tuple(r) for r in got] == [(3, 2, 0, 16)]


def test_blocks_context_and_limit(corpus):
    got = {r.first_line: r for r in text.search(corpus.where("doc_id = 3"), "foo", context=1).collect()}
    assert sorted(got) == [1, 4] and got[1].hits == 3 and (got[1].start_line, got[1].end_line) == (1, 3) and got[4].lines == ["", "foo"]
    assert text.search(corpus, "foo", max_per_file=1).where("doc_id = 3").count() == 1
    r = text.count_only(corpus, "foo").first()
    assert (r["items"], r.files) == (3, 2)


def test_lexical_state(corpus):
    m = text.literal_matches(corpus, "run")
    assert text.code_matches(m, corpus, strings=False).count() == m.count() - 1
    m = text.literal_matches(corpus, "idiot")
    assert text.code_matches(m, corpus, comments=False).count() == 0 and m.count() == 1
    m = text.literal_matches(corpus, "Doc")
    assert text.code_matches(m, corpus, docstrings=False).count() == 0


def test_highlight(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hello world", [(0, 5), (3, 8), (9, 99)])], "line string, s array<struct<start:int,end:int>>")
    assert df.select(text.highlight(F.col("line"), F.col("s"))).first()[0] == "[hello][ wo]r[ld]"


def test_boolean_grammar(spark, corpus):
    from pyspark.sql import functions as F

    n = boolean.parse("foo OR bar AND NOT baz")
    assert n.kind == "or" and n.right.kind == "and" and n.right.right.kind == "not"
    assert boolean.terms(n) == ["foo", "bar", "baz"] and boolean.parse("a b").kind == "and"
    for bad in ("", "(a", "a OR", "NOT", "a )"):
        with pytest.raises(ValueError):
            boolean.parse(bad)
    got = corpus.where(boolean.predicate('FOO AND NOT ("bar foo" OR zz)', F.col("text"))).collect()
    assert [r.doc_id for r in got] == [2]


def test_distances():
    assert fuzzy.damerau("ca", "abc") == 2 and fuzzy.damerau("ab", "ba") == 1 and fuzzy.damerau("", "ab") == 2
    assert fuzzy.jaro_winkler("", "") == 1.0 and fuzzy.jaro_winkler("a", "") == 0.0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.96111, abs=1e-5)
    assert fuzzy.jaro_winkler("abcdefgh", "abzzyyxx") == pytest.approx(0.6)
    con = duckdb.connect()
    for a, b in (("kitten", "sitting"), ("teh", "the"), ("abcdef", "badcfe"), ("x", "xyzzy")):
        assert fuzzy.damerau(a, b) == con.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchall()[0][0]


def test_phonetic_codes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Robert",), ("Rupert",), ("Tymczak",), ("Pfister",), ("",), ("phone",)], "w string")
    got = {r.w: (r.s, r.m) for r in df.select("w", fuzzy.soundex(F.col("w")).alias("s"), fuzzy.metaphone(F.col("w")).alias("m")).collect()}
    assert got["Robert"][0] == got["Rupert"][0] == "R163" and got["Tymczak"][0] == "T520" and got["Pfister"][0] == "P123"
    assert got[""] == ("0000", "") and got["phone"][1] == "FN"
    assert fuzzy.phonetic_matches(df, "Robert", col="w").count() == 2


def test_fuzzy_words_and_patterns(spark):
    df = spark.createDataFrame([(w,) for w in ("thing", "think", "Thnig", "zebra")], "word string")
    assert {r.word for r in fuzzy.match_words(df, "thing").collect()} == {"thing", "think", "Thnig"}
    best = {r.word: (r.algorithm, r.similarity) for r in fuzzy.match_words_any(df, "thing").collect()}
    assert best["thing"] == ("levenshtein", 1.0) and best["Thnig"][1] > 0.8
    assert fuzzy.suggest(df, "thign").first().word == "thing"
    for d in (1, 2):
        assert re.fullmatch(fuzzy.fuzzy_pattern("test", d), "test") and re.search(fuzzy.fuzzy_pattern("test", d), "tezt")
    assert fuzzy.fuzzy_pattern("a.b", 0) == r"a\.b"


def test_semantics(corpus):
    assert len(semantic.concept_patterns("database")) == 3 and semantic.concept_patterns("widget")[1] == r"\bwidgets\b"
    got = semantic.semantic_search(corpus, "import function", threshold=0.05).collect()
    assert got and all(r.score >= 0.05 for r in got)
    names = {(r.kind, r.name) for r in semantic.extract_concepts(text.lines(corpus)).collect()}
    assert ("class", "Main") in names and ("function", "helper") in names


def test_score_components(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("src/main.py",), ("a/test_x.py",), ("README",), ("x/y.unknown",), ("lib/__init__.py",)], "p string")
    got = {r.p: (r.t, round(r.q, 6)) for r in df.select("p", rank.file_type_score(F.col("p")).alias("t"), rank.popularity(F.col("p")).alias("q")).collect()}
    assert got == {"src/main.py": (1.2, 1.0), "a/test_x.py": (1.2, 0.0), "README": (0.9, 0.0), "x/y.unknown": (0.6, 0.0), "lib/__init__.py": (1.2, 0.6)}
    row = spark.createDataFrame([("a.py", 1, 2, 1, ["def foo(x):", "  pass"], [(1, 4, 7)], 0.0)], "path string, start_line long, end_line long, hits long, lines array<string>, spans array<struct<line_no:long,start:int,end:int>>, mtime double")
    s = row.select(rank.score("foo")).first()[0]
    want = 1 + 0.7 + 0.25 + 0.3 * 0.5 + 0.2 * 1.2 + 0.3 * (1 + 1 + 0.3) + 0.4 * 0.25 - 0.1
    assert s == pytest.approx(want)
    for how in ("relevance", "frequency", "recency", "popularity", "hybrid"):
        assert rank.sorted_items(row, "foo", how).count() == 1
    assert rank.hybrid_weights("a b c d")[0] == 0.6 and rank.hybrid_weights("foo")[0] == 0.4 and rank.hybrid_weights("Foo")[0] == 0.7


def test_overlaps_and_clusters(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 9), (1, 10, 30), (1, 40, 45), (2, 2, 9)], "doc_id long, start_line long, end_line long")
    assert sorted((r.doc_id, r.start_line) for r in rank.drop_overlaps(df).collect()) == [(1, 1), (1, 10), (1, 40), (2, 2)]
    t = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d f"), (4, "x y z"), (5, "x y z w")], "id long, t string")
    got = {r.id: r.seed for r in rank.clusters(t.withColumnRenamed("id", "doc"), "doc", "t", 0.66).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_metadata_helpers(spark):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    assert metadata.parse_size("1.5KB") == 1536 and metadata.parse_size("2M") == 2 << 20 and metadata.parse_size("7") == 7
    with pytest.raises(ValueError):
        metadata.parse_size("x")
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert metadata.parse_date("7d", now) == now.timestamp() - 7 * 86400 and metadata.parse_date("2024-01-30", now) == now.timestamp() - 86400
    df = spark.createDataFrame([("src/a.py",), ("src/x/b.py",), ("a/node_modules/z.js",), ("c.txt",)], "p string")
    hit = lambda *g: sorted(r.p for r in df.where(metadata.glob("p", list(g))).collect())
    assert hit("**/*.py") == ["src/a.py", "src/x/b.py"] and hit("*.txt") == ["c.txt"] and hit("src/*.py") == ["src/a.py"]
    assert hit("**/node_modules/**") == ["a/node_modules/z.js"] and hit() == []


def test_languages(spark):
    from pyspark.sql import functions as F

    rows = [("a/x.py", ""), ("Makefile", ""), ("run", "#!/usr/bin/env python3\n"), ("s.sh", "#!/bin/bash\n"), ("h.h", "using namespace std;\nstd::x\n"), ("m.txt.zzz", "package main\nfunc main() {}\n"), ("q", "nothing"), ("A.TSX", "")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = {r.p: r.l for r in df.select("p", languages.detect(F.col("p"), F.col("t")).alias("l")).collect()}
    assert got == {"a/x.py": "python", "Makefile": "makefile", "run": "python", "s.sh": "shell", "h.h": "cpp", "m.txt.zzz": "go", "q": "unknown", "A.TSX": "typescript"}
    assert ".py" in languages.extensions("python")


def test_imports_entities_blocks(corpus):
    got = {(r.file, r.import_type, r.module, r.from_module, r.alias) for r in code.imports(corpus).collect()}
    assert {("src/main.py", "import", "os", None, None), ("src/main.py", "from", "c", "a.b", "d"), ("lib/x.js", "require", "z", None, None), ("lib/x.js", "import", "m", None, "a"), ("bad.py", "import", "zz", None, "y"), ("bad.py", "from", "w", "q", None)} <= got
    e = code.entities(corpus)
    names = {(r.name, r.entity_type, r.scope) for r in e.collect()}
    assert {("Main", "class", ""), ("run", "method", "Main"), ("helper", "function", ""), ("LIMIT", "variable", ""), ("foo", "function", "")} <= names
    kinds = sorted(r.relation_type for r in code.relations(e, corpus).collect())
    assert kinds == ["calls", "contains", "inherits"]
    assert [(r.start, r.end) for r in code.ast_blocks(corpus, func="help").collect()] == [(17, 19)]
    assert [(r.start, r.end) for r in code.ast_blocks(corpus, cls="Main", imported="^os$").orderBy("start").collect()] == [(1, 1), (9, 13)]
    only = text.search(corpus, "return", restrict=code.ast_blocks(corpus, func="helper"))
    assert [r.first_line for r in only.collect()] == [19]
    assert code.search_entities(e, "doc").first().name == "Main"
    assert {(r.source, r.target) for r in code.dependency_edges(corpus).collect()} >= {("src.main", "os"), ("src.main", "a.b"), ("lib/x", "m")}


@pytest.mark.parametrize(
    "language, line, module",
    [("java", "import static a.b.C;", "a.b.C"), ("csharp", "using A.B;", "A.B"), ("rust", "use a::b;", "a::b"), ("php", "use A\\B as C;", "A\\B"), ("ruby", "require_relative 'x'", "x"), ("kotlin", "import a.b.*", "a.b.*"), ("swift", "import class Foo.Bar", "Foo.Bar"), ("scala", "import a.b", "a.b"), ("c", '#include "x.h"', "x.h"), ("cpp", "#include <v>", "v"), ("dart", "export 'p'", "p"), ("lua", 'local x = require("y")', "y"), ("perl", "use A::B;", "A::B"), ("elixir", "alias A.B", "A.B"), ("haskell", "import qualified A.B as C", "A.B"), ("go", 'import (\n  f "fmt"\n)', "fmt"), ("typescript", "import { a } from './b'", "./b")],
)
def test_import_parsers(language, line, module):
    assert [r[2] for r in code.parse_imports(line, language)] == [module]


@pytest.mark.parametrize(
    "language, line, name",
    [("java", "public class A {", "A"), ("go", "func (r *T) Do() {", "Do"), ("rust", "pub async fn go() {", "go"), ("c", "int main(void) {", "main"), ("php", "public function f() {", "f"), ("ruby", "def x?", "x?"), ("kotlin", "data class P(", "P"), ("swift", "public func s() {", "s"), ("scala", "case class Q(", "Q"), ("dart", "abstract class D {", "D"), ("lua", "local function l()", "l"), ("perl", "sub p {", "p"), ("elixir", "defmodule A.B do", "A.B"), ("typescript", "export interface I {", "I"), ("csharp", "public sealed class S", "S")],
)
def test_entity_parsers(language, line, name):
    assert [r[0] for r in code.parse_entities(line + "\n}\n", language)] == [name]


def test_ide(corpus):
    assert code.definition(corpus, "helper").first().line_no == 17
    refs = code.references(corpus, "helper").collect()
    assert len(refs) == 2 and sum(r.is_definition for r in refs) == 1
    assert [(r.kind, r.name) for r in code.completions(corpus, "ru").collect()] == [("function", "run")]
    assert {r.name for r in code.symbols(corpus, "lim").collect()} == {"LIMIT"}
    assert text.analyze(corpus.where("doc_id = 1")).first().classes == 2


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x_main", "a"), ("y", "a"), ("z", "z")], "source string, target string")
    got = {}
    for r in graph.cycles(e).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e"]]
    assert {r.node for r in graph.dead_code(e).collect()} == {"y"}
    assert graph.has_path(e, "a", "e") and not graph.has_path(e, "e", "a") and graph.has_path(e, "q", "q")
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "source int, target int")
    assert graph.longest_path(dag) == 3
    assert {r.kind for r in graph.refactoring(e).collect()} >= {"cycle", "dead"}
    rel = spark.createDataFrame([("a", "b", "calls", 0.9), ("b", "c", "calls", 0.2), ("d", "b", "imports", 0.9)], "source_id string, target_id string, relation_type string, confidence double")
    assert {(r.node, r.depth) for r in graph.neighbours(rel, "a", hops=2, min_confidence=0.5).collect()} == {("b", 1), ("d", 2)}


def test_vectors(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r.vec_id for r in vectors.top_k(v, [0.0, 1.0], 2, "euclid").collect()] == [3, 2]
    assert vectors.top_k(v, [1.0, 0.0], 9, threshold=0.5).count() == 2
    assert vectors.batch_top_k(v, v.where("vec_id = 1"), 1).first().vec_id == 2
    assert v.select(vectors.normalize(F.col("embedding"))).collect()[3][0] == [0.0, 0.0]


def test_history_fold_and_updates(spark):
    rows = [(k, f"2024-01-01 00:00:{s:06.3f}", "p") for k, s in enumerate((0, 1.5, 2.5, 3.9, 10))]
    h = spark.createDataFrame(rows, "event_id long, ts string, pattern string").selectExpr("event_id", "cast(ts as timestamp) ts", "pattern")
    assert sorted(r.event_id for r in history.deduplicate(h).collect()) == [0, 2, 4]
    from pyspark.sql import functions as F

    got = {r.event_id: r.rating for r in history.latest_update(h, "p", rating=F.lit(5)).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 5}


def test_incremental(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    u = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    d = spark.createDataFrame([("a",)], "k string")
    assert sorted(map(tuple, incremental.merge(t, u, ["k"], d).collect())) == [("b", 3), ("c", 4)]
    assert incremental.parse_tag(incremental.tag("d", "main", "x")) == ("d", "main", "x")
    with pytest.raises(ValueError):
        incremental.parse_tag("a::b")
    c = spark.createDataFrame([("p1", "h1", "foo bar"), ("p2", "h2", "foo foo baz bar"), ("p3", "h3", "nothing")], "path string, hash string, text string")
    tags = spark.createDataFrame([("h1", "t"), ("h2", "t"), ("h3", "u")], "hash string, tag string")
    assert {r.path for r in incremental.retrieve(c, tags, "foo bar", "t").collect()} == {"p1", "p2"}


def test_chunks(spark):
    long = "\n".join(f"line {k} " + "x" * (k % 30) for k in range(200))
    df = spark.createDataFrame([(1, long, "python"), (2, PY, "python"), (3, "", ""), (4, None, "")], "doc_id long, text string, language string")
    for how in ("basic", "structural"):
        got = chunks.greedy(df, 400, how, "language").orderBy("doc_id", "chunk").collect()
        for i, t in ((1, long), (2, PY)):
            mine = [r for r in got if r.doc_id == i]
            assert "\n".join(r.content for r in mine) == t
            assert [r.start_line for r in mine[1:]] == [r.end_line + 1 for r in mine[:-1]]
            assert all(r.size <= 400 for r in mine)
    assert chunks.chunk_stats(chunks.greedy(df, 400)).first().chunks > 10
    same = spark.createDataFrame([(1, 1, 2, "a b c"), (1, 3, 4, "a b c"), (1, 5, 6, "x y")], "doc_id long, start_line long, end_line long, content string")
    assert sorted((r.start_line, r.end_line) for r in chunks.merge_similar(same, 100).collect()) == [(1, 4), (5, 6)]
    with pytest.raises(ValueError):
        chunks.windows(df, 3, 3)


def test_tree_source_and_sinks(spark, corpus, tmp_path):
    root = tmp_path / "r"
    for p, t in (("pkg/__init__.py", ""), ("pkg/sub/deep/m.py", PY), ("_x.py", "a = 1"), ("node_modules/z.js", "x"), ("bin.dat", "\0\1"), (".git/config", "x"), ("l.txt", "é")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    got = {r.path.removeprefix(str(root) + "/"): r for r in tree.read_tree(spark, str(root)).collect()}
    assert sorted(got) == ["_x.py", "l.txt", "pkg/__init__.py", "pkg/sub/deep/m.py"]
    assert got["pkg/sub/deep/m.py"].language == "python" and got["pkg/__init__.py"].line_count == 0
    assert sorted(r.path for r in tree.read_tree(spark, str(root), include=["**/*.py"], exclude=[]).collect())[0].endswith("_x.py")
    assert tree.repositories(str(tmp_path)) == [str(root)]
    items = text.search(corpus, "foo", context=0)
    sinks.write_json(items, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == items.count()
    shown = [r[0] for r in items.where("doc_id = 2").select(sinks.item_text()).collect()]
    assert shown == ["2:2-2\n     2 | function foo() {"]
    for fmt in ("dot", "json", "csv"):
        sinks.write_edges(code.dependency_edges(corpus), str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError):
        sinks.write_edges(items, "x", "yaml")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "modified", 0.0, None), ("a", "modified", 0.05, None), ("a", "deleted", 2.0, None), ("b", "created", 1.0, None), ("c", "moved", 3.0, "b")]
    df = spark.createDataFrame(rows, "path string, event_type string, ts double, old_path string")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    seen = []
    q = events.process(stream, lambda b, _: seen.extend(map(tuple, b.collect())), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert sorted(seen) == [("a", "deleted", 2.0), ("b", "deleted", 3.0), ("c", "created", 3.0)]
    q = events.debounce(stream.select("path", "event_type", "ts")).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.path, r.ts) for r in spark.table("deb").collect()) == [("a", 0.0), ("a", 2.0), ("b", 1.0), ("c", 3.0)]
