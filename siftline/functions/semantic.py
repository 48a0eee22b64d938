"""Concept patterns and TF-IDF."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans import terms
from siftline.plans.best import ROWS, Best, blocks

#: Words of each concept, one regex a line; a space separates alternatives.
_CONCEPTS = {
    "database": ["conn connection cursor database db delete execute insert query select update", "mongodb mysql postgres redis sql sqlite", "commit rollback session transaction"],
    "web": ["delete get http https patch post put request response", "bottle django fastapi flask tornado", "api endpoint json rest route xml", "auth cookie cors middleware session"],
    "testing": ["assert fixture mock patch setUp tearDown test", "doctest nose pytest unittest", "check expect should validate verify"],
    "async": ["async asyncio await coroutine future task", r"async\sdef await\s+\w+", "create_task gather get_event_loop run"],
    "logging": ["critical debug error info log logger logging warn warning", "basicConfig formatter getLogger handler"],
    "file": [r"close file open os\.path path pathlib read write", r"with\s+open \w+\.read \w+\.write", "exists isdir isfile mkdir rmdir"],
    "error": ["catch error except exception finally raise throw try", "AttributeError IndexError KeyError TypeError ValueError", "fail failure handle recover rescue"],
    "config": ["config configuration options parameters params settings", "ENV dotenv env environment", "cfg ini json toml yaml"],
    "security": ["auth authentication authorization jwt login password token", "cipher decrypt encrypt hash https ssl tls", "access deny grant permission role user"],
    "data": ["array csv data dataframe dataset dict json list xml", "deserialize format numpy pandas parse serialize", "filter map process reduce transform"],
}


def _regex(words: str) -> str:
    return rf"\b({'|'.join(words.split(' '))})\b"


def concept_patterns(concept: str) -> list[str]:
    """Regexes of a concept; of all concepts that share a substring with it; else of the word and its variants."""
    c = concept.lower()
    if c in _CONCEPTS:
        return [_regex(w) for w in _CONCEPTS[c]]
    near = [_regex(w) for k, ws in _CONCEPTS.items() if c in k or k in c for w in ws]
    if near:
        return near
    forms = [concept, concept + "s", concept + "ed", concept + "ing", concept.replace("_", ""), concept.replace("-", "")]
    return [rf"\b{re.escape(f)}\b" for k, f in enumerate(forms) if k == 0 or f != concept]


def expand_query(query: str) -> list[str]:
    """Patterns of every word, each once, in order."""
    return list(dict.fromkeys(p for w in re.findall(r"\w+", query.lower()) for p in concept_patterns(w)))


def concept_score(text: Column, concept: str) -> Column:
    """Share of a concept's patterns that occur, ignoring case."""
    ps = concept_patterns(concept)
    return reduce(lambda a, b: a + b, [text.rlike(f"(?i){p}").cast("int") for p in ps]) / F.lit(float(len(ps)))


def semantic_pattern(concept: str) -> str:
    """One alternation of a concept's patterns."""
    return "|".join(f"(?:{p})" for p in concept_patterns(concept))


def tokens(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"(?U)\b\w{3,}\b", stop: tuple = ()) -> DataFrame:
    """(id, token, n): counts of lower-case tokens."""
    w = corpus.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("token"))
    if stop:
        w = w.where(~F.col("token").isin(*stop))
    return w.groupBy(id_col, "token").agg(F.count("*").alias("n"))


def code_tokens(text: Column) -> Column:
    """Identifiers with their camel and snake parts, lower case, longer than two."""
    ids = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    camel = F.flatten(F.transform(ids, lambda x: F.regexp_extract_all(x, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0))))
    snake = F.flatten(F.transform(F.filter(ids, lambda x: x.contains("_")), lambda x: F.split(x, "_")))
    return F.filter(F.transform(F.concat(ids, camel, snake), F.lower), lambda x: F.length(x) > 2)


def idf(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(token, df, idf = ln(N / (df + 1)))."""
    n = counts.agg(F.countDistinct(id_col).alias("n_docs"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n_docs") / (F.col("df") + 1)).alias("idf"))  # n is one row


def tfidf(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, weight) with positive weights only."""
    total = counts.groupBy(id_col).agg(F.sum("n").alias("total"))
    w = counts.join(total, id_col).join(idf(counts, id_col), "token")
    return w.select(id_col, "token", (F.col("n") / F.col("total") * F.col("idf")).alias("weight")).where("weight > 0")


def similar(weights: DataFrame, query: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, score): cosine of each document with one query vector (token, weight)."""
    q = query.select("token", F.col("weight").alias("q"))
    qn = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qn"))
    d = weights.join(q, "token", "left").groupBy(id_col).agg(F.sum(F.col("weight") * F.col("q")).alias("d"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    return d.where("d is not null").crossJoin(F.broadcast(qn)).select(id_col, (F.col("d") / (F.col("n") * F.col("qn"))).alias("score"))


def hashed(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"(?U)\b\w{3,}\b") -> DataFrame:
    """(id, h): hashes of the lower-case tokens of each document that has some, a row an id."""
    h = corpus.where(F.col(id_col).isNotNull() & F.lower(text_col).rlike(pattern)).select(id_col, text_col)
    n, ids = h.agg(F.count("*"), F.countDistinct(id_col)).first()
    h = h.select(F.col(id_col).alias("id"), terms.hashes(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("h"))
    if n > ids:
        h = h.groupBy("id").agg(F.flatten(F.collect_list("h")).alias("h"))
    h._n = ids
    return h


def _weights(freq, n_docs: int, b) -> tuple[np.ndarray, ...]:
    """Rows (id, h) → (row, term, weight) of positive TF-IDF weights, by row and term."""
    h = b.column("h")
    n = np.diff(h.offsets.to_numpy()).astype(np.int64)
    v, of = h.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
    o = np.lexsort((v, of))
    v, of = v[o], of[o]
    at = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (of[1:] != of[:-1])][: len(v)])
    k = np.diff(np.r_[at, len(v)])
    v, of = v[at], of[at]
    w = k / n[of] * np.log(n_docs / (freq(v) + 1))
    ok = w > 0
    return of[ok], v[ok], w[ok]


def vectors(h: DataFrame, counts: str, n_docs: int) -> DataFrame:
    """(id, terms, weights) of rows of :func:`hashed`; documents without weights have no row."""

    def run(batches):
        freq = terms.Counts(counts)
        for b in batches:
            of, v, w = _weights(freq, n_docs, b)
            ends = np.cumsum(np.r_[0, np.bincount(of, minlength=b.num_rows)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (v, w)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *lists], ["id", "terms", "weights"]).filter(pa.array(np.diff(ends) > 0))

    kind = h.schema["id"].dataType.simpleString()
    return h.mapInArrow(run, f"id {kind}, terms array<long>, weights array<double>")


class _Queries:
    """A file of query vectors: products with terms that many have are taken densely, others by lists."""

    def __init__(self, path: str, k: int):
        pdf = pd.read_pickle(path)
        self.best, n = Best(pdf["id"].to_numpy(), k), len(pdf)
        size = pdf["terms"].map(len).to_numpy()
        q, w = np.repeat(np.arange(n), size), np.concatenate(pdf["weights"].to_numpy())
        self.terms, t = np.unique(np.concatenate(pdf["terms"].to_numpy()), return_inverse=True)
        self.norm = np.sqrt(np.bincount(q, w * w, n))
        many = np.bincount(t)
        self.slot = np.where(many * 16 > n, np.cumsum(many * 16 > n) - 1, -1)
        dense = self.slot[t] >= 0
        self.dense = np.zeros((int((self.slot >= 0).sum()), n))
        self.dense[self.slot[t[dense]], q[dense]] = w[dense]
        o = np.argsort(t, kind="stable")
        self.q, self.w, self.start, self.many = q[o], w[o], np.cumsum(many) - many, many

    def scores(self, n: int, of: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Products of ``n`` documents with all queries."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        of, at, w = of[hit], at[hit], w[hit]
        slot = self.slot[at]
        x = np.zeros((n, len(self.dense)))
        x[of[slot >= 0], slot[slot >= 0]] = w[slot >= 0]
        out = x @ self.dense
        of, at, w = (y[slot < 0] for y in (of, at, w))
        m = self.many[at]
        each = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.start[at], m)
        np.add.at(out.reshape(-1), np.repeat(of, m) * out.shape[1] + self.q[each], np.repeat(w, m) * self.w[each])
        return out


def similar_vectors(vecs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """:func:`similar_each` of rows (id, terms, weights): all documents against all queries, of which a task keeps the best k."""
    kind = vecs.schema["id"].dataType.simpleString()
    _, files = blocks(queries, "id")

    def run(batches):
        held = [_Queries(f, k) for f in files]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                t = part.column("terms")
                of = np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy()))
                term, w = t.flatten().to_numpy(), part.column("weights").flatten().to_numpy()
                ids, norm = part.column("id").to_pandas().to_numpy(), np.sqrt(np.bincount(of, w * w, len(t)))
                for h in held:
                    s = h.scores(len(t), of, term, w)
                    s /= norm[:, None] * h.norm
                    s[s == 0] = -np.inf
                    i, j = h.best.candidates(s, 2e-9)
                    v = s[i, j]
                    i, j, v = (y[v != -np.inf] for y in (i, j, v))
                    h.best.add(j, ids[i], np.round(v, 9), v)
        for h in held:
            if (got := h.best.found(id_col)) is not None:
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    s = vecs.mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_each(weights: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): the k best cosines of each query document, whose own id is left out.

    ``queries`` are rows of ``weights``. Ties at nine decimals go to the lesser
    id; documents that share no weighted token with a query have no row.
    """

    def vecs(df):
        x = F.collect_list(F.struct(F.xxhash64("token").alias("t"), F.col("weight").cast("double").alias("w")))
        return df.where(F.col("weight") != 0).groupBy(F.col(id_col).alias("id")).agg(x.alias("x")).where("id is not null").select("id", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))

    return similar_vectors(vecs(weights), vecs(queries), k, id_col)


def tfidf_similar(corpus: DataFrame, queries: Column, k: int, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"(?U)\b\w{3,}\b") -> DataFrame:
    """:func:`similar_each` of the corpus' TF-IDF weights; tokens are counted, weighed and compared where the text lies."""
    h = hashed(corpus, id_col, text_col, pattern)
    counts = terms.store(h.select(F.explode(F.array_distinct("h")).alias("term")))
    return similar_vectors(vectors(h, counts, h._n), vectors(h.where(queries), counts, h._n), k, id_col)


def query_cosines(corpus: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cos): TF-IDF cosine with a query text, of documents that share a weighted token with it."""
    words = re.findall(r"\w{3,}", query.lower())
    h = hashed(corpus, id_col, text_col)
    names = list(dict.fromkeys(words))
    codes = list(corpus.sparkSession.range(1).select(*(F.xxhash64(F.lit(w)) for w in names)).first()) if names else []
    counts = terms.store(h.select(F.explode(F.array_distinct("h")).alias("term")), codes)
    n_docs, kind = h._n, h.schema["id"].dataType.simpleString()
    df = terms.Counts(counts)(np.array(codes, np.int64), 0)
    q = {c: words.count(w) / len(words) * math.log(n_docs / (f + 1)) for c, w, f in zip(codes, names, df.tolist()) if f}
    q = {c: x for c, x in q.items() if x > 0}
    qn = math.sqrt(sum(x * x for x in q.values()))

    def run(batches):
        freq = terms.Counts(counts)
        for b in batches:
            of, v, w = _weights(freq, n_docs, b)
            d = np.zeros(b.num_rows)
            for c, x in q.items():
                d[of[v == c]] += w[v == c] * x
            norm = np.sqrt(np.bincount(of, w * w, b.num_rows))
            hit = np.flatnonzero(d > 0)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(hit)), pa.array(d[hit] / (norm[hit] * qn))], ["id", "cos"])

    return h.mapInArrow(run, f"id {kind}, cos double").withColumnRenamed("id", id_col)


def query_vector(weights_idf: DataFrame, query: str) -> DataFrame:
    """(token, weight) of a query text under a corpus' idf."""
    words = [w for w in re.findall(r"\w{3,}", query.lower())]
    spark = weights_idf.sparkSession
    q = spark.createDataFrame([(w, words.count(w) / len(words)) for w in dict.fromkeys(words)], "token string, tf double")
    return weights_idf.join(F.broadcast(q), "token").select("token", (F.col("tf") * F.col("idf")).alias("weight")).where("weight > 0")  # as many rows as the query has words


#: Categories of concepts for ranking, by the words that name them.
CATEGORIES = {
    "database": "database sql query table",
    "web": "http request response api",
    "testing": "test assert mock",
    "file": "file read write path",
    "error": "error exception raise",
    "config": "config settings options",
}

_CONCEPT_LINES = (
    ("function", r"^\s*(?:async\s+)?def\s+(\w+)", 0.9),
    ("class", r"^\s*class\s+(\w+)", 0.9),
    ("import", r"^\s*(?:from\s+(?:[\w.]+)\s+)?import\s+([\w.]+)", 0.7),
    ("variable", r"^\s*([A-Za-z_]\w*)\s*=[^=]", 0.6),
    ("function", r"^\s*function\s+(\w+)", 0.8),
    ("comment", r"(?:#|//)\s*(.{11,})$", 0.5),
)


def extract_concepts(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, kind, name, confidence) of definitions, imports, assignments and comments."""
    found = F.filter(
        F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", rx, 1).alias("name"), F.lit(c).alias("confidence")) for kind, rx, c in _CONCEPT_LINES)),
        lambda x: x["name"] != "",
    )
    return lines.select(id_col, "line_no", F.explode(found).alias("c")).select(id_col, "line_no", "c.*")


def concept_similarity(concepts: DataFrame, query: str, id_col: str = "doc_id") -> DataFrame:
    """(id, score): confidence-weighted name and category hits of a query's words, at most 1."""
    words = re.findall(r"\w+", query.lower()) or [""]
    name = F.lower("name")
    hit = reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    same = [c for c, ws in CATEGORIES.items() if any(w in ws.split() for w in words)]
    cat = reduce(lambda a, b: a | b, [name.contains(w) for c in same for w in CATEGORIES[c].split()]) if same else F.lit(False)
    s = F.when(hit, 0.8).otherwise(0.0) + F.when(cat, 0.4).otherwise(0.0)
    return concepts.groupBy(id_col).agg(F.least(F.lit(1.0), F.sum(s * F.col("confidence")) / F.sum("confidence")).alias("score"))


def semantic_search(corpus: DataFrame, query: str, threshold: float = 0.1, limit: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0.5 concept share + 0.3 TF-IDF cosine + 0.2 named concepts, at least ``threshold``."""
    from siftline.operators.text import lines

    words = re.findall(r"\w+", query.lower()) or [query]
    share = reduce(F.greatest, [concept_score(F.col(text_col), w) for w in words], F.lit(0.0)) if len(words) > 1 else concept_score(F.col(text_col), words[0])
    base = corpus.select(id_col, share.alias("share"))
    cos = query_cosines(corpus, query, id_col, text_col)
    named = concept_similarity(extract_concepts(lines(corpus, id_col, text_col), id_col), query, id_col).withColumnRenamed("score", "named")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = base.join(cos, id_col, "left").join(named, id_col, "left").select(id_col, (0.5 * zero("share") + 0.3 * zero("cos") + 0.2 * zero("named")).alias("score"))
    return s.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(limit)
