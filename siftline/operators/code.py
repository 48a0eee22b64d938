"""Structure of source code: imports, entities, syntax-tree blocks, symbols, relations."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python's parser raises on text that it cannot parse, deep nesting included.
_UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)
_NAME = r"[A-Za-z_$][\w$]*"
#: language → (import kind, regex on a stripped line, group of the module, group of the alias or 0)
IMPORTS: dict[str, list[tuple[str, str, int, int]]] = {
    "javascript": [
        ("import", rf"""^import\s+(?:type\s+)?({_NAME})\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*['"]([^'"]+)""", 2, 1),
        ("destructure", r"""^import\s+\{[^}]*\}\s*from\s*['"]([^'"]+)""", 1, 0),
        ("namespace", rf"""^import\s+\*\s+as\s+({_NAME})\s+from\s*['"]([^'"]+)""", 2, 1),
        ("effect", r"""^import\s*['"]([^'"]+)""", 1, 0),
        ("require", r"""\brequire\(\s*['"]([^'"]+)""", 1, 0),
    ],
    "java": [("import", r"^import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)\s*;", 1, 0)],
    "csharp": [("using", r"^(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", 1, 0)],
    "go": [("import", r"""^import\s+(?:([\w.]+)\s+)?"([^"]+)""", 2, 1), ("block", r"""^(?:([\w.]+)\s+)?"([\w./-]+)"$""", 2, 1)],
    "rust": [("use", r"^(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", 1, 0), ("extern", r"^extern\s+crate\s+(\w+)", 1, 0)],
    "php": [("use", r"^use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", 1, 2), ("include", r"""^(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)""", 1, 0)],
    "ruby": [("relative", r"""^require_relative\s*\(?['"]([^'"]+)""", 1, 0), ("require", r"""^require\s*\(?['"]([^'"]+)""", 1, 0)],
    "kotlin": [("import", r"^import\s+(\w+(?:\.\w+)*(?:\.\*)?)(?:\s+as\s+(\w+))?", 1, 2)],
    "swift": [("import", r"^(?:@testable\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|typealias)\s+)?([\w.]+)", 1, 0)],
    "scala": [("import", r"^import\s+([\w.]+)", 1, 0)],
    "c": [("system", r"^#\s*include\s*<([^>]+)>", 1, 0), ("local", r"""^#\s*include\s*"([^"]+)""", 1, 0)],
    "dart": [("import", r"""^import\s+['"]([^'"]+)['"](?:\s+as\s+(\w+))?""", 1, 2), ("export", r"""^export\s+['"]([^'"]+)""", 1, 0)],
    "lua": [("require", r"""\brequire\s*\(?\s*['"]([^'"]+)""", 1, 0)],
    "perl": [("use", r"^use\s+([A-Z][\w:]*)", 1, 0), ("require", r"^require\s+([\w:]+)", 1, 0)],
    "elixir": [("import", r"^import\s+([\w.]+)", 1, 0), ("use", r"^use\s+([\w.]+)", 1, 0), ("alias", r"^alias\s+([\w.]+)", 1, 0), ("require", r"^require\s+([\w.]+)", 1, 0)],
    "haskell": [("import", r"^import\s+(?:qualified\s+)?([A-Z]\w*(?:\.\w+)*)(?:\s+(?:qualified\s+)?as\s+(\w+))?", 1, 2)],
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "cpp": IMPORTS["c"]}

#: language → (entity type, regex on a line, group of the name)
ENTITIES: dict[str, list[tuple[str, str]]] = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)")],
    "java": [("class", r"^\s*(?:\w+\s+)*(?:class|interface|enum)\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "csharp": [("class", r"^\s*(?:\w+\s+)*(?:class|interface|struct|enum)\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("type", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)")],
    "c": [("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*$"), ("struct", r"^\s*(?:typedef\s+)?(?:struct|class)\s+(\w+)")],
    "php": [("function", r"^\s*(?:\w+\s+)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "kotlin": [("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|object)\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)")],
    "swift": [("function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:\w+\s+)*struct\s+(\w+)"), ("protocol", r"^\s*(?:\w+\s+)*protocol\s+(\w+)")],
    "scala": [("function", r"^\s*(?:\w+\s+)*def\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("object", r"^\s*(?:\w+\s+)*object\s+(\w+)"), ("trait", r"^\s*(?:\w+\s+)*trait\s+(\w+)")],
    "dart": [("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:[\w<>?]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")],
    "perl": [("function", r"^\s*sub\s+(\w+)"), ("package", r"^\s*package\s+([\w:]+)")],
    "elixir": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)")],
}
ENTITIES |= {"typescript": [*ENTITIES["javascript"], ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")], "cpp": ENTITIES["c"]}


def _python_imports(text: str) -> list[tuple]:
    """(line, kind, module, from_module, alias, relative) by syntax tree, or by lines where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except _UNPARSED:
        out = []
        for k, line in enumerate(text.split("\n"), 1):
            s = line.strip()
            if m := re.match(r"import\s+([A-Za-z_][\w.]*)(?:\s+as\s+(\w+))?", s):
                out.append((k, "import", m[1], None, m[2], False))
            elif m := re.match(r"from\s+(\.*)([A-Za-z_][\w.]*)\s+import\s+([\w.*]+)(?:\s+as\s+(\w+))?", s):
                out.append((k, "from", m[3], m[2], m[4], bool(m[1])))
        return out
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(n.lineno, "import", a.name, None, a.asname, False) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(n.lineno, "from", a.name, n.module or "", a.asname, bool(n.level)) for a in n.names]
    return out


def parse_imports(text: str, language: str) -> list[tuple]:
    if language == "python":
        return _python_imports(text)
    rules = IMPORTS.get(language)
    if not rules:
        return []
    out, block = [], False
    for k, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if language == "go":
            if re.match(r"import\s*\(", s):
                block = True
                continue
            if block and s.startswith(")"):
                block = False
        for kind, rx, module, alias in rules:
            if kind == "block" and not block:
                continue
            if m := re.search(rx, s):
                out.append((k, kind, m[module], None, m[alias] if alias else None, m[module].startswith(".") or kind in ("local", "relative")))
                break
    return out


_IMPORT_COLS = "line long, import_type string, module string, from_module string, alias string, is_relative boolean"


def _per_text(corpus: DataFrame, f, columns: str, path: str, text: str, language: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    kind = corpus.schema[path].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, *row) for p, t, lang in zip(pdf["p"], pdf["t"], pdf["l"]) if t for row in f(t, lang or "")]
            yield pd.DataFrame(out, columns=["file", *names])

    rows = corpus.select(F.col(path).alias("p"), F.col(text).alias("t"), F.col(language).alias("l"))
    return rows.mapInPandas(run, f"file {kind}, {columns}")


def imports(corpus: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(file, line, import_type, module, from_module, alias, is_relative) of every import."""
    return _per_text(corpus, parse_imports, _IMPORT_COLS, path, text, language)


def module_name(path: Column, language: Column) -> Column:
    stem = F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")
    dotted = F.replace(F.regexp_replace(F.regexp_replace(stem, r"/?__init__$", ""), "^/+", ""), F.lit("/"), F.lit("."))
    base = F.element_at(F.split(stem, "/"), -1)
    return F.when(language == "python", dotted).when(language.isin("javascript", "typescript"), stem).otherwise(base)


def dependency_edges(corpus: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(source, target) modules of every import; several imports of a module are several rows."""
    names = corpus.select(F.col(path).alias("file"), module_name(F.col(path), F.col(language)).alias("source"))
    got = imports(corpus, path, text, language).withColumn("target", F.when(F.col("from_module") != "", F.col("from_module")).otherwise(F.col("module")))
    return got.join(names, "file").select("source", "target")


def _python_entities(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except _UNPARSED:
        return _line_entities(text, "python")
    out = []

    def walk(node: ast.AST, scope: str, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            name = None
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = ", ".join(a.arg for a in n.args.args)
                name, kind, sig = n.name, "method" if in_class else "function", f"{n.name}({args})"
            elif isinstance(n, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in n.bases)
                name, kind, sig = n.name, "class", f"{n.name}({bases})" if bases else n.name
            elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                out.append((n.targets[0].id, "variable", n.lineno, n.end_lineno, None, None, scope, ""))
                continue
            if name is None:
                walk(n, scope, in_class)
                continue
            deco = ",".join(ast.unparse(d) for d in n.decorator_list)
            out.append((name, kind, n.lineno, n.end_lineno, sig, ast.get_docstring(n), scope, deco))
            walk(n, f"{scope}.{name}" if scope else name, isinstance(n, ast.ClassDef))

    walk(tree, "", False)
    return out


def _line_entities(text: str, language: str) -> list[tuple]:
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines, 1):
        for kind, rx in ENTITIES.get(language, ()):
            if m := re.match(rx, line):
                if m[1] in ("if", "for", "while", "switch", "return", "else"):
                    continue
                out.append((m[1], kind, k, _block_end(lines, k, language), line.strip(), None, "", ""))
                break
    return out


def _block_end(lines: list[str], start: int, language: str, most: int = 500) -> int:
    head = lines[start - 1]
    indent = len(head) - len(head.lstrip())
    if language in ("python", "ruby", "lua", "elixir"):
        for k in range(start, min(len(lines), start + most)):
            s = lines[k]
            if s.strip() and len(s) - len(s.lstrip()) <= indent:
                return k + 1 if s.strip() == "end" else k
        return min(len(lines), start + most)
    depth = 0
    for k in range(start - 1, min(len(lines), start - 1 + most)):
        depth += lines[k].count("{") - lines[k].count("}")
        if depth <= 0 and ("}" in lines[k] or lines[k].rstrip().endswith(";")):
            return k + 1
    return start


def parse_entities(text: str, language: str) -> list[tuple]:
    return _python_entities(text) if language == "python" else _line_entities(text, language)


def entities(corpus: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """Entities with a stable id: hash of file, kind, name and line."""
    cols = "name string, entity_type string, start_line long, end_line long, signature string, docstring string, scope string, decorators string"
    e = _per_text(corpus, parse_entities, cols, path, text, language).withColumnRenamed("file", "file_path")
    lang = corpus.select(F.col(path).alias("file_path"), F.col(language).alias("language"))
    i = F.sha2(F.concat_ws("\0", "file_path", "entity_type", "name", F.col("start_line").cast("string")), 256)
    return e.join(lang, "file_path").withColumn("id", i)


def ast_blocks(corpus: DataFrame, func: str | None = None, cls: str | None = None, decorator: str | None = None, imported: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): merged line ranges of Python definitions and imports that match all regexes given for their kind."""

    def ranges(t: str, _: str) -> list[tuple]:
        try:
            tree = ast.parse(t)
        except _UNPARSED:
            return []
        hit = []
        for n in ast.walk(tree):
            deco = [ast.unparse(d) for d in getattr(n, "decorator_list", [])]
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                ok = func is not None and re.search(func, n.name) or func is None and decorator is not None
            elif isinstance(n, ast.ClassDef):
                ok = cls is not None and re.search(cls, n.name) or cls is None and decorator is not None and func is None
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                names = [a.name for a in n.names] + [getattr(n, "module", None) or ""]
                if imported is not None and any(re.search(imported, x) for x in names):
                    hit.append((n.lineno, n.end_lineno))
                continue
            else:
                continue
            if ok and (decorator is None or any(re.search(decorator, d) for d in deco)):
                hit.append((n.lineno, n.end_lineno))
        out: list[list[int]] = []
        for a, b in sorted(hit):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    got = _per_text(corpus.withColumn("__l", F.lit("python")), ranges, "start long, end long", id_col, text_col, "__l")
    return got.withColumnRenamed("file", id_col)


def relations(e: DataFrame, corpus: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """(source_id, target_id, relation_type, confidence): containment, inheritance and, with texts, calls."""
    c = e.where("entity_type = 'class'")
    inner = e.where("entity_type in ('method', 'function')").alias("m")
    o = c.alias("c")
    within = (F.col("c.file_path") == F.col("m.file_path")) & (F.col("m.start_line") > F.col("c.start_line")) & (F.col("m.end_line") <= F.col("c.end_line"))
    out = o.join(inner, within).select(F.col("c.id").alias("source_id"), F.col("m.id").alias("target_id"), F.lit("contains").alias("relation_type"), F.lit(1.0).alias("confidence"))
    named = c.groupBy("name").agg(F.max_by("id", F.struct("file_path", "start_line")).alias("base_id")).withColumnRenamed("name", "base")
    bases = c.select("id", F.explode(F.split(F.regexp_extract("signature", r"\(([^)]*)\)", 1), r"\s*,\s*")).alias("base"))
    out = out.unionByName(bases.join(named, "base").select(F.col("id").alias("source_id"), F.col("base_id").alias("target_id"), F.lit("inherits").alias("relation_type"), F.lit(0.9).alias("confidence")))
    if corpus is not None:
        f = e.where("entity_type in ('method', 'function')")
        body = f.join(corpus.select(F.col(path).alias("file_path"), F.split(F.col(text), "\n", -1).alias("all")), "file_path")
        body = body.select("id", "name", F.array_join(F.slice("all", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n").alias("b"))
        calls = body.select("id", "name", F.explode(F.array_distinct(F.regexp_extract_all("b", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("called")).where("called <> name")
        to = f.select(F.col("id").alias("target_id"), F.col("name").alias("called"))
        out = out.unionByName(calls.join(to, "called").select(F.col("id").alias("source_id"), "target_id", F.lit("calls").alias("relation_type"), F.lit(0.8).alias("confidence")))
    return out


def search_entities(e: DataFrame, query: str, threshold: float = 0.0, limit: int = 50) -> DataFrame:
    """(id, name, score): 0.8 name + 0.6 docstring + 0.4 signature hits of a text."""
    q = query.lower()
    hit = lambda c, w: F.when(F.coalesce(F.lower(c).contains(q), F.lit(False)), w).otherwise(0.0)
    s = e.withColumn("score", hit("name", 0.8) + hit("docstring", 0.6) + hit("signature", 0.4))
    return s.where((F.col("score") > 0) & (F.col("score") >= threshold)).orderBy(F.desc("score"), "id").limit(limit).select("id", "name", "score")


def symbols(corpus: DataFrame, query: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kind, name) of def, class and constant lines."""
    from siftline.operators.text import lines

    rules = (("function", r"^\s*def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*="))
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", rx, 1).alias("name")) for k, rx in rules)), lambda x: x["name"] != "")
    out = lines(corpus, id_col, text_col).select(id_col, "line_no", F.explode(found).alias("s")).select(id_col, "line_no", "s.*")
    return out.where(F.lower("name").contains(query.lower())) if query else out


def definition(corpus: DataFrame, symbol: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First definition of a symbol: def before class before assignment."""
    from siftline.operators.text import lines

    q = re.escape(symbol)
    rank = F.when(F.col("line").rlike(rf"^\s*(?:async\s+)?def\s+{q}\b"), 1).when(F.col("line").rlike(rf"^\s*class\s+{q}\b"), 2).when(F.col("line").rlike(rf"^{q}\s*="), 3)
    return lines(corpus, id_col, text_col).withColumn("priority", rank).where("priority is not null").orderBy("priority", id_col, "line_no").limit(1)


def references(corpus: DataFrame, symbol: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, start, end, is_definition) of whole-word occurrences."""
    from siftline.operators.text import lines, regex_matches

    q = re.escape(symbol)
    got = regex_matches(corpus.where(F.col(text_col).contains(symbol)), rf"\b{q}\b", id_col, text_col)
    return got.join(lines(corpus, id_col, text_col), [id_col, "line_no"]).withColumn("is_definition", F.col("line").rlike(rf"^\s*(?:async\s+)?(?:def|class)\s+{q}\b")).drop("line")


def diagnostics(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kind, message) of TODO, FIXME, HACK and XXX comments."""
    from siftline.operators.text import lines

    rx = r"#\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)"
    return lines(corpus, id_col, text_col).where(F.col("line").rlike(rx)).select(id_col, "line_no", F.regexp_extract("line", rx, 1).alias("kind"), F.regexp_extract("line", rx, 2).alias("message"))


def completions(corpus: DataFrame, prefix: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    s = symbols(corpus, "", id_col, text_col).where((F.col("name").startswith(prefix)) & (F.length("name") >= 2) & (F.col("kind") != "constant"))
    return s.select("kind", "name").distinct().orderBy(F.when(F.col("kind") == "function", 0).otherwise(1), "name")
