"""One object for all searches over a corpus of (id, path, text, language, mtime)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import fuzzy, semantic
from siftline.functions.fuzzy import ALGORITHMS
from siftline.operators import boolean, code, graph, metadata, rank, text


class Engine:
    """Searches a corpus; each method returns a DataFrame and runs nothing by itself."""

    def __init__(self, corpus: DataFrame, id_col: str = "path", text_col: str = "text"):
        self.id, self.text, self.corpus = id_col, text_col, corpus

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, **how) -> Engine:
        from siftline.sources.tree import read_tree

        return cls(read_tree(spark, root, **how))

    def filtered(self, where=None, globs: list[str] | None = None) -> Engine:
        """The same engine over fewer files."""
        c = self.corpus if where is None else self.corpus.where(where)
        return Engine(c.where(metadata.glob(self.id, globs)) if globs else c, self.id, self.text)

    def search(self, pattern: str, regex: bool = False, context: int = 3, **how) -> DataFrame:
        return text.search(self.corpus, pattern, regex, context, id_col=self.id, text_col=self.text, **how)

    def ranked(self, pattern: str, strategy: str = "hybrid", regex: bool = False, context: int = 3, **how) -> DataFrame:
        """Hits with their score, best first, without overlapping ones."""
        items = self.search(pattern, regex, context, **how)
        if "mtime" in self.corpus.columns:
            items = items.join(self.corpus.select(self.id, "mtime"), self.id)
        else:
            items = items.withColumn("mtime", F.lit(0.0))
        return rank.sorted_items(rank.drop_overlaps(items, key=self.id), pattern, strategy, self.id)

    def count(self, pattern: str, regex: bool = False) -> DataFrame:
        return text.count_only(self.corpus, pattern, regex, self.id, self.text)

    def boolean(self, query: str, context: int = 3) -> DataFrame:
        """Blocks of a boolean query's terms in the files that satisfy it; without terms in them, no block."""
        import re

        node = boolean.parse(query)
        files = self.corpus.where(boolean.predicate(node, F.col(self.text)))
        rx = "(?i)" + "|".join(re.escape(t) for t in boolean.terms(node))
        return text.search(files, rx, True, context, id_col=self.id, text_col=self.text)

    def multi(self, patterns: list[str], operator: str = "OR", regex: bool = False) -> DataFrame:
        return text.multi_pattern(self.corpus, patterns, operator, regex, self.id, self.text)

    def fuzzy(self, pattern: str, max_distance: int = 2, context: int = 3) -> DataFrame:
        return self.search("(?i)" + fuzzy.fuzzy_pattern(pattern, max_distance), True, context)

    def fuzzy_words(self, pattern: str, algorithms: tuple = ALGORITHMS, max_distance: int = 2, min_similarity: float = 0.6) -> DataFrame:
        """(id, word, similarity, algorithm) of every word near the pattern."""
        return fuzzy.match_words_any(fuzzy.words(self.corpus, self.id, self.text), pattern, algorithms, max_distance, min_similarity)

    def phonetic(self, pattern: str, algorithm: str = "soundex") -> DataFrame:
        return fuzzy.phonetic_matches(fuzzy.words(self.corpus, self.id, self.text), pattern, algorithm)

    def suggest(self, word: str, limit: int = 5, algorithm: str = "damerau_levenshtein") -> DataFrame:
        return fuzzy.suggest(fuzzy.words(self.corpus, self.id, self.text, r"[A-Za-z_]\w{2,}"), word, limit, algorithm)

    def concept(self, concept: str, context: int = 3) -> DataFrame:
        return self.search("(?i)" + semantic.semantic_pattern(concept), True, context)

    def semantic(self, query: str, threshold: float = 0.1, limit: int = 100) -> DataFrame:
        return semantic.semantic_search(self.corpus, query, threshold, limit, self.id, self.text)

    def syntax(self, pattern: str, func: str | None = None, cls: str | None = None, decorator: str | None = None, imported: str | None = None, **how) -> DataFrame:
        """Hits inside the Python definitions that match."""
        ranges = code.ast_blocks(self.corpus, func, cls, decorator, imported, self.id, self.text)
        return self.search(pattern, restrict=ranges, **how)

    def dependencies(self) -> DataFrame:
        return graph.weighted(code.dependency_edges(self.corpus, self.id, self.text))

    def entities(self) -> DataFrame:
        return code.entities(self.corpus, self.id, self.text)

    def knowledge_graph(self) -> tuple[DataFrame, DataFrame]:
        e = self.entities()
        return e, code.relations(e, self.corpus, self.id, self.text)

    def definition(self, symbol: str) -> DataFrame:
        return code.definition(self.corpus, symbol, self.id, self.text)

    def references(self, symbol: str) -> DataFrame:
        return code.references(self.corpus, symbol, self.id, self.text)

    def symbols(self, query: str = "") -> DataFrame:
        return code.symbols(self.corpus, query, self.id, self.text)

    def completions(self, prefix: str) -> DataFrame:
        return code.completions(self.corpus, prefix, self.id, self.text)

    def diagnostics(self) -> DataFrame:
        return code.diagnostics(self.corpus, self.id, self.text)

    def analyze(self) -> DataFrame:
        return text.analyze(self.corpus, self.id, self.text)


def union_repositories(engines: dict[str, Engine]) -> Engine:
    """One engine over several repositories, told apart by a column repo."""
    out = None
    for name, e in engines.items():
        c = e.corpus.withColumn("repo", F.lit(name))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    first = next(iter(engines.values()))
    return Engine(out, first.id, first.text)
