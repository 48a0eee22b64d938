"""Language of a file by name, extension, shebang and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTENSIONS = {
    "python": "py pyw pyi pyx", "javascript": "js jsx mjs", "typescript": "ts tsx", "java": "java", "kotlin": "kt kts", "scala": "scala sc", "c": "c h",
    "cpp": "cpp cxx cc hpp hxx hh", "csharp": "cs csx", "go": "go", "rust": "rs", "php": "php php3 php4 php5 phtml", "ruby": "rb rbw rake gemspec", "swift": "swift",
    "r": "r", "matlab": "m mat", "shell": "sh bash zsh fish ksh", "powershell": "ps1 psm1 psd1", "sql": "sql mysql pgsql plsql", "html": "html htm xhtml",
    "css": "css scss sass less", "xml": "xml xsd xsl", "json": "json", "yaml": "yaml yml", "toml": "toml", "markdown": "md markdown mdown mkd rst", "lua": "lua luau",
    "perl": "pl pm pod t", "dart": "dart", "elixir": "ex exs heex", "haskell": "hs lhs", "julia": "jl", "groovy": "groovy gvy gy gsh", "objective_c": "mm", "zig": "zig",
}
_FILENAMES = {
    "dockerfile": "Dockerfile dockerfile Dockerfile.dev Dockerfile.prod", "makefile": "Makefile makefile GNUmakefile CMakeLists.txt Justfile justfile",
    "ruby": "Rakefile Gemfile Podfile Vagrantfile", "python": "SConstruct SConscript BUILD BUILD.bazel WORKSPACE",
    "groovy": "Jenkinsfile build.gradle settings.gradle", "kotlin": "build.gradle.kts settings.gradle.kts",
}
_INTERPRETERS = {
    "python": "python3 python", "javascript": "node", "shell": "bash sh zsh", "ruby": "ruby", "php": "php", "perl": "perl", "lua": "lua",
    "elixir": "elixir", "julia": "julia", "dart": "dart", "groovy": "groovy",
}
#: Marks of a language in its text, tried where several languages are possible; space-free regexes.
_MARKS = {
    "python": r"^import\s+\w ^from\s+\w+\s+import def\s+\w+\s*\( class\s+\w+\s*\( __name__\s*==",
    "javascript": r"function\s+\w+\s*\( const\s+\w+\s*= let\s+\w+\s*= require\s*\( module\.exports",
    "typescript": r"interface\s+\w type\s+\w+\s*= :\s*(?:number|string|any|boolean) import\s.*\sfrom\s",
    "java": r"public\s+class\s package\s+[\w.]+; import\s+[\w.]+; static\s+void\s+main",
    "go": r"^package\s+\w+\s*$ import\s+\( func\s+\w+\s*\( type\s+\w+\s+struct",
    "rust": r"\bfn\s+\w+\s*\( \bimpl\s+\w use\s+\w+:: let\s+mut\s #\[derive",
    "php": r"<\?php \$\w+\s*= echo\s",
    "ruby": r"^\s*def\s+\w+\s*$ ^\s*module\s+\w require\s+['\"] puts\s ^\s*end\s*$",
    "c": r"#include\s*[<\"] int\s+main\s*\( typedef\s printf\s*\(",
    "cpp": r"using\s+namespace std:: template\s*< cout\s*<< nullptr",
    "objective_c": r"#import\s*[<\"] @interface\s @implementation\s @property @end",
    "matlab": r"function\s+.*=\s*\w+\s*\( classdef\s ^%",
    "csharp": r"using\s+[A-Z][\w.]*; namespace\s+\w Console\.Write",
    "kotlin": r"\bfun\s+\w+\s*\( \bval\s+\w data\s+class",
    "swift": r"\bfunc\s+\w+\s*\( guard\s+let protocol\s+\w",
    "scala": r"object\s+\w+\s*\{ trait\s+\w case\s+class implicit\s",
    "shell": r"\w+\s*\(\)\s*\{ if\s+\[\s export\s+\w+= \$\{\w+\}",
    "sql": r"(?i)select\s.*\sfrom\s (?i)create\s+table (?i)insert\s+into",
    "lua": r"local\s+function local\s+\w+\s*= \bthen\s*$",
    "perl": r"use\s+strict use\s+warnings \bsub\s+\w my\s+\$\w",
    "haskell": r"module\s+[A-Z]\w* ::\s*\w+\s*-> where\s*$",
    "elixir": r"defmodule\s+\w \bdefp\s+\w \|>",
    "julia": r"using\s+[A-Z]\w* ^\s*struct\s+\w function\s+\w+\(.*\)\s*$",
    "groovy": r"println\s def\s+\w+\s*=",
    "dart": r"package:\w @override Widget\s+build",
    "zig": r"@import\s*\( pub\s+fn\s comptime",
    "powershell": r"Write-Host Get-\w param\s*\(",
    "r": r"<-\s*function library\s*\(",
}
_AMBIGUOUS = {"h": ("c", "cpp", "objective_c"), "m": ("matlab", "objective_c"), "mm": ("objective_c", "cpp")}


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    """Language whose words hold the value, by one literal map."""
    pairs = [F.lit(x) for language, words in table.items() for w in words.split() for x in (w, language)]
    return F.try_element_at(F.create_map(*pairs), value)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"[^.]\.([^.]+)$", 1))


def by_extension(path: Column) -> Column:
    return _lookup(_extension(path), _EXTENSIONS)


def by_filename(path: Column) -> Column:
    return _lookup(_name(path), _FILENAMES)


def by_shebang(text: Column) -> Column:
    names = "|".join(n for v in _INTERPRETERS.values() for n in v.split())
    return _lookup(F.regexp_extract(text, rf"^#!\s*(?:/usr)?/bin/(?:env\s+)?({names})\b", 1), _INTERPRETERS)


def _marks(rx: str) -> str:
    return "(?mi)" + rx[4:] if rx.startswith("(?i)") else "(?m)" + rx


def by_content(text: Column, candidates: Column | None = None) -> Column:
    """Language with the most marks in the text; ties go to the name that sorts first; null without marks.

    ``candidates``: array of the languages that may win, or null for all.
    """
    votes = F.array(
        *(F.struct(F.size(F.filter(F.array(*(text.rlike(_marks(rx)) for rx in _MARKS[x].split())), lambda y: y)).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(sorted(_MARKS)))
    )
    may = F.filter(votes, lambda v: (v["n"] > 0) if candidates is None else (v["n"] > 0) & (candidates.isNull() | F.array_contains(candidates, v["x"])))
    return F.array_max(may)["x"]


def detect(path: Column, text: Column | None = None) -> Column:
    """Filename, then shebang, extension (content decides ambiguous ones), content; else unknown."""
    ext = by_extension(path)
    if text is None:
        return F.coalesce(by_filename(path), ext, F.lit("unknown"))
    pairs = [c for e, choices in _AMBIGUOUS.items() for c in (F.lit(e), F.array(*map(F.lit, choices)))]
    choices = F.try_element_at(F.create_map(*pairs), _extension(path))
    return F.coalesce(by_filename(path), by_shebang(text), F.when(choices.isNull(), ext), by_content(text, choices), ext, F.lit("unknown"))


def extensions(language: str) -> list[str]:
    return ["." + e for e in _EXTENSIONS.get(language, "").split()]


def is_text(path: Column) -> Column:
    known = {e for v in _EXTENSIONS.values() for e in v.split()} | set("txt log csv tsv ini cfg conf env lock gitignore editorconfig svg vue".split())
    ext = F.lower(F.regexp_extract(_name(path), r"\.([^.]+)$", 1))
    bare = {n for v in _FILENAMES.values() for n in v.split()} | {"LICENSE", "README", "CHANGELOG", "AUTHORS"}
    return ext.isin(*sorted(known)) | _name(path).isin(*sorted(bare))
