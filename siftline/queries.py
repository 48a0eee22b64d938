"""Queries over the test tables, each with the DuckDB SQL that gives the same rows.

``documents`` stands for a corpus of files (source = directory), ``events`` for
search history, ``embeddings`` for a vector store, and the keys of the order
tables for graph edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import fuzzy, semantic
from siftline.operators import boolean, chunks, code, collections, graph, history, incremental, metadata, rank, text, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of a table getter; ``sql`` is its DuckDB twin."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: _t(spark, sf_dir, name))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents)"
_ISLANDS = """
h AS (SELECT doc_id, line_no, (length(line) - length(replace(line, '{0}', ''))) // {1} AS n FROM l WHERE contains(line, '{0}')),
b AS (SELECT *, CASE WHEN line_no > lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 THEN 1 ELSE 0 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM b),
blocks AS (SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, sum(n)::BIGINT AS hits FROM k GROUP BY doc_id, block)
"""


@query(f"""WITH {_LINES}, {_ISLANDS.format("tion", 4)}
SELECT b.doc_id, first_line, last_line, hits, greatest(1, first_line - 2)::BIGINT AS start_line,
       least(len(string_split(text, chr(10))), last_line + 2)::BIGINT AS end_line,
       array_to_string(string_split(text, chr(10))[greatest(1, first_line - 2):least(len(string_split(text, chr(10))), last_line + 2)], chr(10)) AS block
FROM blocks b JOIN documents d USING (doc_id)""")
def literal_search(t):
    got = text.search(t("documents"), "tion", context=2)
    return got.select("doc_id", "first_line", "last_line", "hits", "start_line", "end_line", F.array_join("lines", "\n").alias("block"))


@query(f"""WITH {_LINES}, {_ISLANDS.format("the", 3)}
SELECT doc_id, sum(hits)::BIGINT AS hits, count(*) AS blocks FROM blocks GROUP BY doc_id ORDER BY hits DESC, doc_id LIMIT 20""")
def top_documents(t):
    b = text.blocks(text.literal_matches(t("documents"), "the"))
    return b.groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("blocks")).orderBy(F.desc("hits"), "doc_id").limit(20)


@query(f"""WITH {_LINES}, {_ISLANDS.format("and", 3)} SELECT count(*) AS items, count(DISTINCT doc_id) AS files FROM blocks""")
def count_only(t):
    return text.count_only(t("documents"), "and")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+ing'))::BIGINT AS hits FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ [a-z]+ing')""")
def regex_count(t):
    n = F.regexp_count("text", F.lit("[A-Z][a-z]+ [a-z]+ing")).cast("long")
    return t("documents").select("doc_id", n.alias("hits")).where("hits > 0")


@query(rf"""WITH {_LINES}, h AS (SELECT doc_id, line_no, len(regexp_extract_all(line, '[a-z]+ing[a-z]')) AS n FROM l)
SELECT doc_id, line_no, n::BIGINT AS hits FROM h WHERE n > 0""")
def regex_spans(t):
    return text.regex_matches(t("documents"), "[a-z]+ing[a-z]").groupBy("doc_id", "line_no").agg(F.count("*").alias("hits"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(text), 'that') AND NOT contains(lower(text), 'idiot')) OR contains(lower(text), 'la la')""")
def boolean_search(t):
    return t("documents").where(boolean.predicate('that AND NOT idiot OR "la la"', F.col("text"))).select("doc_id")


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 1024 AND n_chars <= 10240 AND len(string_split(text, chr(10))) >= 3 AND lang = 'en' AND source SIMILAR TO 'src1.*'""")
def metadata_filter(t):
    d = t("documents").withColumns({"size": F.col("n_chars"), "line_count": metadata.line_count(F.col("text")), "path": F.col("source")})
    lo, hi = metadata.size_bounds("1KB", "10KB")
    return d.where(metadata.predicate(min_size=lo, max_size=hi, min_lines=3, language="en")).where(metadata.glob("path", ["src1*"])).select("doc_id", "lang", "source", "n_chars")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
SELECT word, levenshtein(lower(word), 'thing')::INTEGER AS distance, round(1 - levenshtein(lower(word), 'thing') / greatest(length(word), 5)::DOUBLE, 9) AS similarity
FROM w WHERE levenshtein(lower(word), 'thing') <= 2 AND 1 - levenshtein(lower(word), 'thing') / greatest(length(word), 5)::DOUBLE >= 0.6""")
def fuzzy_levenshtein(t):
    w = fuzzy.words(t("documents"), pattern="[A-Za-z]+").select("word").distinct()
    return fuzzy.match_words(w, "thing").withColumn("similarity", F.round("similarity", 9))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
SELECT word, damerau_levenshtein(lower(word), 'theer')::INTEGER AS distance FROM w WHERE damerau_levenshtein(lower(word), 'theer') <= 2 AND 1 - damerau_levenshtein(lower(word), 'theer') / greatest(length(word), 5)::DOUBLE >= 0.6""")
def fuzzy_damerau(t):
    w = fuzzy.words(t("documents"), pattern="[A-Za-z]+").select("word").distinct()
    return fuzzy.match_words(w, "theer", "damerau_levenshtein").select("word", "distance")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents),
s AS (SELECT word, 1 - damerau_levenshtein(lower(word), 'thaton') / greatest(length(word), 6)::DOUBLE AS similarity FROM w)
SELECT word, round(similarity, 9) AS similarity FROM s WHERE similarity > 0.3 ORDER BY s.similarity DESC, word LIMIT 5""")
def suggest_corrections(t):
    w = fuzzy.words(t("documents"), pattern="[A-Za-z]+")
    return fuzzy.suggest(w, "thaton").withColumn("similarity", F.round("similarity", 9))


@query(r"""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS u FROM documents),
d AS (SELECT u, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(substr(u, 2), '[^BFPVCGJKQSXZDTLMNR]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS c FROM w)
SELECT u AS word, substr(substr(u, 1, 1) || c || '000', 1, 4) AS code FROM d""")
def soundex_codes(t):
    w = fuzzy.words(t("documents"), pattern="[A-Za-z]+").select(F.upper("word").alias("word")).distinct()
    return w.select("word", fuzzy.soundex(F.col("word")).alias("code"))


@query(r"""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS u FROM documents),
r AS (SELECT u, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(u, 'PH', 'F'), 'GH', 'F'), 'CK', 'K'), 'SCH', 'SK'), 'QU', 'KW'), 'TH', 'T'), 'SH', 'S'), 'CH', 'K'), 'WH', 'W'), 'X', 'KS') AS m FROM w)
SELECT u AS word, substr(substr(m, 1, 1) || regexp_replace(substr(m, 2), '[AEIOU]', '', 'g'), 1, 4) AS code FROM r""")
def metaphone_codes(t):
    w = fuzzy.words(t("documents"), pattern="[A-Za-z]+").select(F.upper("word").alias("word")).distinct()
    return w.select("word", fuzzy.metaphone(F.col("word")).alias("code"))


@query()
def jaro_winkler_pairs(t):
    n = t("nation").select("n_name")
    return n.crossJoin(F.broadcast(t("region").select("r_name"))).select(  # five regions
        "n_name", "r_name", F.round(fuzzy.jaro_winkler_similarity("n_name", "r_name"), 9).alias("similarity")
    )


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents),
n AS (SELECT count(DISTINCT doc_id) AS n FROM w), df AS (SELECT token, count(DISTINCT doc_id) AS df FROM w GROUP BY token)
SELECT token, df, round(ln(n / (df + 1)::DOUBLE), 9) AS idf FROM df, n""")
def tfidf_idf(t):
    w = semantic.tokens(t("documents"), pattern="[a-z]{3,}")
    return semantic.idf(w).withColumn("idf", F.round("idf", 9))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents),
n AS (SELECT count(DISTINCT doc_id) AS n FROM w), df AS (SELECT token, ln((SELECT n FROM n) / (count(DISTINCT doc_id) + 1)::DOUBLE) AS idf FROM w GROUP BY token),
tf AS (SELECT doc_id, token, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS tf FROM w GROUP BY doc_id, token),
v AS (SELECT doc_id, token, tf * idf AS x FROM tf JOIN df USING (token) WHERE tf * idf > 0),
nn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id),
s AS (SELECT q.doc_id AS query_id, v.doc_id, sum(v.x * q.x) AS d FROM v JOIN v q USING (token) WHERE q.doc_id % 100 = 0 AND q.doc_id <> v.doc_id GROUP BY ALL),
c AS (SELECT query_id, s.doc_id, d / (a.n * b.n) AS score FROM s JOIN nn a ON a.doc_id = s.doc_id JOIN nn b ON b.doc_id = query_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10""")
def tfidf_similar(t):
    s = semantic.tfidf_similar(t("documents"), F.col("id") % 100 == 0, 10, pattern="[a-z]{3,}")
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id, round((regexp_matches(text, '(?i)\b(array|csv|data|dataframe|dataset|dict|json|list|xml)\b')::INT + regexp_matches(text, '(?i)\b(deserialize|format|numpy|pandas|parse|serialize)\b')::INT + regexp_matches(text, '(?i)\b(filter|map|process|reduce|transform)\b')::INT) / 3.0::DOUBLE, 9) AS score FROM documents""")
def concept_score(t):
    return t("documents").select("doc_id", F.round(semantic.concept_score(F.col("text"), "data"), 9).alias("score"))


@query()
def jaccard_pairs(t):
    d = t("documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    return rank.similar_pairs(d, "doc_id", "s", 0.8).withColumn("similarity", F.round("similarity", 9))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


@query(f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings
ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 9) DESC, vec_id LIMIT 10""")
def vector_top_k(t):
    e = t("embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("score"))  # one query vector
    return s.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(10).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p WHERE s >= 0.2)
SELECT query_id, vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def vector_batch(t):
    e = t("embeddings")
    return vectors.batch_top_k(e, e.where("vec_id % 100 = 0"), 5, 0.2).withColumn("score", F.round("score", 6))


@query("""SELECT label, count(*) AS n, max(len(embedding))::BIGINT AS dims, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label""")
def vector_stats(t):
    return vectors.collection_stats(t("embeddings"), "label").withColumn("mean_norm", F.round("mean_norm", 6))


_HIST = """h AS (SELECT event_id, ts, json_extract_string(props, '$.k') AS pattern, user_id::VARCHAR AS session_id, event_type AS category,
CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 60 END::BIGINT AS items, value AS elapsed_ms, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS success FROM events)"""


def _history(t):
    return history.from_events(t("events"))


@query(f"WITH {_HIST} SELECT count(*) AS searches, count(DISTINCT pattern) AS patterns FROM h")
def history_stats(t):
    return history.stats(_history(t))


@query(f"WITH {_HIST} SELECT pattern, count(*) AS n FROM h GROUP BY pattern ORDER BY n DESC, min(ts), pattern LIMIT 10")
def history_frequent(t):
    return history.frequent_patterns(_history(t))


@query(f"WITH {_HIST} SELECT pattern, max(ts) AS last_ts FROM h WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY pattern ORDER BY last_ts DESC, pattern LIMIT 20")
def history_recent(t):
    return history.recent_patterns(_history(t), "2024-01-30")


@query(f"""WITH {_HIST}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g)
SELECT session_id, min(ts) AS start, max(ts) AS "end", count(*) AS searches, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM s GROUP BY session_id, k""")
def history_sessions(t):
    return history.sessions(_history(t)).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH {_HIST} SELECT ts::DATE::VARCHAR AS day, count(*) AS searches, round(avg(success), 6) AS success, round(avg(elapsed_ms), 6) AS avg_ms FROM h GROUP BY ts::DATE""")
def history_daily(t):
    return history.daily_trends(_history(t)).withColumns({"day": F.col("day").cast("string"), "success": F.round("success", 6), "avg_ms": F.round("avg_ms", 6)})


@query(f"""WITH {_HIST}, d AS (SELECT ts::DATE AS day, count(*) AS n, row_number() OVER (ORDER BY ts::DATE) AS k, count(*) OVER () // 2 AS half FROM h GROUP BY ts::DATE),
g AS (SELECT avg(CASE WHEN k <= half THEN n END) AS before, avg(CASE WHEN k > half THEN n END) AS after FROM d)
SELECT round(before, 6) AS before, round(after, 6) AS after, CASE WHEN after / before > 1.1 THEN 'increasing' WHEN after / before < 0.9 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
def history_trend(t):
    return history.trend(_history(t)).withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query(f"""WITH {_HIST}, g AS (SELECT date_trunc('week', ts)::DATE AS week, category, count(*) AS searches FROM h GROUP BY ALL),
l AS (SELECT *, lag(searches) OVER (PARTITION BY category ORDER BY week) AS before FROM g)
SELECT week::VARCHAR AS week, category, searches, before, coalesce(searches > 1.5 * before OR before > 1.5 * searches, false) AS shifted FROM l""")
def history_categories(t):
    return history.category_trends(_history(t)).withColumn("week", F.col("week").cast("string"))


@query(f"""WITH {_HIST} SELECT pattern, count(*) AS total, count(*) FILTER (items = 0) AS failed, round(count(*) FILTER (items = 0) / count(*)::DOUBLE, 6) AS rate FROM h GROUP BY pattern HAVING count(*) FILTER (items = 0) > 0 ORDER BY failed DESC, pattern LIMIT 10""")
def history_failed(t):
    return history.failed_patterns(_history(t)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_HIST} SELECT category, count(*) AS searches, round(avg(success), 6) AS success, count(*) FILTER (elapsed_ms > (SELECT 2 * avg(elapsed_ms) FROM h)) AS slow, count(*) FILTER (items = 0) AS "empty" FROM h GROUP BY category""")
def history_performance(t):
    return history.performance(_history(t)).withColumn("success", F.round("success", 6))


@query(f"""WITH {_HIST} SELECT hour(ts)::BIGINT AS hour, isodow(ts)::BIGINT - 1 AS weekday, count(*) AS searches, round(avg(success), 6) AS success FROM h GROUP BY 1, 2""")
def history_usage(t):
    return history.usage_by_hour(_history(t)).withColumn("success", F.round("success", 6))


@query(f"""WITH {_HIST}, n AS (SELECT session_id, pattern, unnest([lag(pattern, 1) OVER w, lag(pattern, 2) OVER w, lag(pattern, 3) OVER w, lag(pattern, 4) OVER w]) AS other FROM h WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
SELECT DISTINCT least(pattern, other) AS a, greatest(pattern, other) AS b FROM n WHERE other IS NOT NULL AND other <> pattern""")
def history_correlations(t):
    return history.correlations(_history(t))


@query(f"""WITH {_HIST}, c AS (SELECT session_id, count(*) AS n, list_sort(list_distinct(list(pattern))) AS p FROM h WHERE session_id IN ('1', '2') GROUP BY session_id)
SELECT len(list_intersect(a.p, b.p))::BIGINT AS common, (len(a.p) - len(list_intersect(a.p, b.p)))::BIGINT AS only_first, (len(b.p) - len(list_intersect(a.p, b.p)))::BIGINT AS only_second, a.n - b.n AS more_searches FROM c a, c b WHERE a.session_id = '1' AND b.session_id = '2'""")
def history_compare(t):
    return history.compare_sessions(_history(t), "1", "2")


@query(f"""WITH {_HIST} SELECT count(*) FILTER (n <= 3) AS allowed, count(*) FILTER (n > 3) AS refused FROM (SELECT count(*) OVER (PARTITION BY session_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM h)""")
def history_rate_limit(t):
    return history.rate_limited(_history(t), 3, 86400).agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query()
def history_deduplicate(t):
    return history.deduplicate(_history(t), 3600.0)


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def _edges(t):
    li = t("lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))


@query("SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, count(*) AS weight FROM lineitem GROUP BY ALL")
def graph_weights(t):
    li = t("lineitem")
    return graph.weighted(li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")))


@query(f"""WITH {_EDGES}, n AS (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e)
SELECT node, sum(i)::BIGINT AS afferent, sum(o)::BIGINT AS efferent, round(sum(o) / (sum(i) + sum(o))::DOUBLE, 9) AS instability, (sum(i) + sum(o))::BIGINT AS total FROM n GROUP BY node""")
def graph_coupling(t):
    return graph.coupling(_edges(t)).withColumn("instability", F.round("instability", 9))


@query(f"""WITH {_EDGES}, n AS (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e), c AS (SELECT node, sum(i) AS i, sum(o) AS o FROM n GROUP BY node)
SELECT count(*) AS modules, sum(o)::BIGINT AS edges, round(avg(o), 6) AS avg_dependencies, count(*) FILTER (i = 0) AS without_dependents, count(*) FILTER (i + o > 2 * (SELECT avg(i + o) FROM c)) AS highly_coupled FROM c""")
def graph_metrics(t):
    return graph.metrics(_edges(t)).withColumn("avg_dependencies", F.round("avg_dependencies", 6))


@query(f"WITH {_EDGES} SELECT DISTINCT source AS node FROM e")
def graph_dead_code(t):
    return graph.dead_code(_edges(t))


_CHAIN = "e AS (SELECT o_custkey AS source, (o_custkey * 7 + 3) % 500 AS target FROM orders UNION SELECT o_custkey, o_custkey // 2 FROM orders)"


def _chain(t):
    o = t("orders").select(F.col("o_custkey").alias("source"))
    return o.select("source", ((F.col("source") * 7 + 3) % 500).alias("target")).union(o.select("source", F.floor(F.col("source") / 2))).distinct()


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT target AS node, 1 AS depth FROM e WHERE source = 1234 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 6)
SELECT node, min(depth)::BIGINT AS depth FROM r WHERE node <> 1234 GROUP BY node""")
def graph_transitive(t):
    e = _chain(t)
    return graph.reach(e, e.sparkSession.createDataFrame([(1234,)], "node long"), 6).select("node", "depth")


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT source AS node, 1 AS depth FROM e WHERE target = 10 AND source <> 10 UNION SELECT e.source, r.depth + 1 FROM r JOIN e ON e.target = r.node WHERE r.depth < 3),
m AS (SELECT node, min(depth) AS depth FROM r WHERE node <> 10 GROUP BY node), n AS (SELECT count(*) AS n FROM (SELECT source FROM e UNION SELECT target FROM e))
SELECT 10::BIGINT AS start, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, round(least(1.0, (2 * count(*) FILTER (depth = 1) + count(*) FILTER (depth > 1)) / (3.0 * (SELECT n FROM n))::DOUBLE), 9) AS score FROM m""")
def graph_impact(t):
    e = _chain(t)
    return graph.impact(e, e.sparkSession.createDataFrame([(10,)], "node long"), 3).withColumn("score", F.round("score", 9))


@query()
def graph_cycles(t):
    return graph.cycles(_chain(t))


@query("""WITH old AS (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS action
FROM new n FULL JOIN old o ON n.doc_id = o.doc_id WHERE o.hash IS DISTINCT FROM n.hash""")
def manifest_diff(t):
    d = t("documents")
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("hash"))
    new = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    return incremental.changes(old, new, "doc_id", "hash")


@query("""WITH s AS (SELECT doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 3 <> 0),
g AS (SELECT md5(text) AS hash FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT md5(text) AS hash, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL THEN s.hash ELSE c.hash END AS hash,
CASE WHEN c.path IS NULL AND n.n > 1 THEN 'remove_tag' WHEN c.path IS NULL THEN 'delete' WHEN g.hash IS NOT NULL THEN 'add_tag' ELSE 'compute' END AS action
FROM c FULL JOIN s ON c.path = s.path LEFT JOIN g ON g.hash = c.hash LEFT JOIN n ON n.hash = s.hash WHERE c.hash IS DISTINCT FROM s.hash""")
def refresh_actions(t):
    d = t("documents")
    saved = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.lit(1).alias("last_updated"))
    now = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    cached = d.where("doc_id % 2 = 0").select(F.md5("text").alias("hash"))
    return incremental.refresh(saved, now, cached, saved)


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), s AS (SELECT doc_id, x, unnest(generate_series(1, len(x), 6)) AS start FROM l)
SELECT doc_id, start::BIGINT AS start_line, least(start + 7, len(x))::BIGINT AS end_line, array_to_string(x[start:least(start + 7, len(x))], chr(10)) AS content FROM s""")
def line_windows(t):
    return chunks.windows(t("documents"), 8, 2)


@query("""WITH n AS (SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS size, round(avg(n_chars), 6) AS avg_size FROM documents GROUP BY source) SELECT * FROM n""")
def corpus_stats(t):
    return metadata.stats(t("documents"), "source", "n_chars").withColumn("avg_size", F.round("avg_size", 6))


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, round((least(1.0, len(l) / 100.0) + least(1.0, len(list_filter(l, lambda s: regexp_matches(s, '\b(if|for|while|is|and)\b'))) / 20.0)) / 2, 9) AS complexity FROM x""")
def basic_complexity(t):
    return t("documents").select("doc_id", F.round(metadata.complexity_basic(F.col("text"), ["if", "for", "while", "is", "and"]), 9).alias("complexity"))


@query("""SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS size FROM documents""")
def content_addresses(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="[^"]*"'))::BIGINT AS links FROM pages""")
def page_titles(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="[^"]*"')).cast("long").alias("links"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (contains(lower(text), 'the')) AS hits FROM conversations GROUP BY conv_id""")
def conversation_hits(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.lower("text").contains("the")).alias("hits"))


@query("""WITH i AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, n_chars, (length(text) - length(replace(text, 'tion', ''))) // 4 AS hits FROM documents WHERE contains(text, 'tion'))
SELECT doc_id, round(2.0 * hits + 0.5 * (1.0 * hits), 6) AS score FROM i ORDER BY score DESC, path LIMIT 50""")
def rank_by_frequency(t):
    i = text.literal_matches(t("documents"), "tion").groupBy("doc_id").agg(F.count("*").alias("hits"))
    d = t("documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    s = i.join(d, "doc_id").withColumn("score", rank.frequency_score(F.col("hits"), 1.0 * F.col("hits")))
    return s.orderBy(F.desc("score"), "path").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query()
def ranked_search(t):
    d = t("documents").withColumns({"path": F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), "mtime": F.col("doc_id").cast("double")})
    items = text.search(d, "tion", context=1).join(d.select("doc_id", "path", "mtime"), "doc_id")
    return rank.sorted_items(rank.drop_overlaps(items), "tion", "hybrid").select("doc_id", "start_line", "end_line", F.round("score", 6).alias("score"))


@query()
def chunk_documents(t):
    return chunks.greedy(t("documents"), 1000)


@query("""SELECT doc_id, (length(text) - length(replace(text, 'thing', ''))) // 5 + (length(text) - length(replace(text, 'shing', ''))) // 5 AS hits FROM documents WHERE contains(text, 'thing') AND contains(text, 'shing')""")
def multi_pattern_and(t):
    b = text.multi_pattern(t("documents"), ["thing", "shing"], "AND")
    return b.groupBy("doc_id").agg(F.sum("hits").alias("hits"))


@query(f"""WITH {_LINES} SELECT doc_id, line_no, replace(line, 'tion', '[tion]') AS shown FROM l WHERE contains(line, 'tion') AND NOT contains(line, 'tiontion')""")
def highlighted_lines(t):
    x = text.lines(t("documents")).where(F.col("line").contains("tion") & ~F.col("line").contains("tiontion"))
    spans = F.transform(text.occurrences(F.col("line"), "tion"), lambda s: F.struct(s.alias("start"), (s + 4).alias("end")))
    return x.select("doc_id", "line_no", text.highlight(F.col("line"), spans).alias("shown"))


@query(f"""WITH {_LINES}, {_ISLANDS.format("ing", 3)} SELECT doc_id, string_agg(first_line || '-' || last_line || ':' || hits, ',' ORDER BY first_line) AS items FROM blocks GROUP BY doc_id""")
def grouped_by_file(t):
    b = text.blocks(text.literal_matches(t("documents"), "ing")).withColumnsRenamed({"first_line": "start_line", "last_line": "end_line"})
    g = text.group_by_file(b)
    return g.select("doc_id", F.array_join(F.transform("items", lambda x: F.concat(x.start_line, F.lit("-"), x.end_line, F.lit(":"), x.hits)), ",").alias("items"))


@query(f"""WITH {_HIST} SELECT session_id, count(*) AS searches, count(DISTINCT pattern) AS patterns, sum(items)::BIGINT AS items, round(avg(success), 6) AS success, min(ts) AS start, max(ts) AS "end" FROM h GROUP BY session_id""")
def history_by_session(t):
    return history.session_summary(_history(t)).withColumn("success", F.round("success", 6))


@query(f"""WITH {_HIST} SELECT category AS name, count(*) AS n, round(sum(elapsed_ms), 4) AS total, min(elapsed_ms) AS least, max(elapsed_ms) AS most, round(avg(elapsed_ms), 6) AS mean FROM h GROUP BY category""")
def metric_summary(t):
    m = history.metric_summary(_history(t), "category", "elapsed_ms")
    return m.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(f"""WITH {_HIST}, x AS (SELECT category, elapsed_ms, row_number() OVER (PARTITION BY category ORDER BY event_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM h),
g AS (SELECT category AS name, avg(elapsed_ms) FILTER (r <= n // 2) AS before, avg(elapsed_ms) FILTER (r > n // 2) AS after FROM x GROUP BY category)
SELECT name, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN after / before > 1.1 THEN 'increasing' WHEN after / before < 0.9 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
def metric_trends(t):
    m = collections.metric_trends(_history(t), "category", "elapsed_ms", "event_id")
    return m.withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query(f"""WITH {_HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS k FROM h)
SELECT session_id, CASE WHEN count(DISTINCT pattern) / count(*)::DOUBLE > 0.7 THEN 'exploration' ELSE 'general' END AS intent FROM r WHERE k <= 5 GROUP BY session_id""")
def session_intents(t):
    return collections.intents(_history(t))


@query(f"""WITH {_HIST} SELECT event_id, pattern FROM h WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def history_range(t):
    return history.by_range(_history(t), "2024-01-10", "2024-01-12", 100).select("event_id", "pattern")


@query("""WITH m AS (SELECT o_orderkey AS path, epoch(o_orderdate) AS last_accessed, o_custkey % 9 AS access_count FROM orders) SELECT path FROM m WHERE NOT (last_accessed < epoch(TIMESTAMP '1998-01-01') - 30 * 86400 AND access_count < 5)""")
def manifest_expire(t):
    m = t("orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").cast("double").alias("last_accessed"), (F.col("o_custkey") % 9).alias("access_count"))
    return incremental.expire(m, 883612800.0).select("path")


@query("""SELECT count(*) AS total, count(*) FILTER (o_custkey % 9 > 1) AS hot, floor(sum(o_custkey % 9) / count(*))::BIGINT AS avg_access FROM orders""")
def manifest_stats(t):
    return incremental.cache_stats(t("orders").select((F.col("o_custkey") % 9).alias("access_count")))


@query("""SELECT s_suppkey, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 3 = 0""")
def merged_table(t):
    s = t("supplier").select("s_suppkey", "s_acctbal")
    return incremental.merge(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"], s.where("s_suppkey % 7 = 0 and s_suppkey % 3 <> 0"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+') AS k FROM documents WHERE doc_id % 4 <> 3),
f AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda y: y = 'the')) AS f0, len(list_filter(k, lambda y: y = 'from')) AS f1 FROM w),
a AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
s AS (SELECT doc_id, ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) AS score FROM f, a WHERE f0 > 0 AND f1 > 0)
SELECT doc_id AS path, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 30""")
def full_text_retrieve(t):
    d = t("documents")
    c = d.select(F.col("doc_id").alias("path"), F.col("doc_id").alias("hash"), "text")
    tags = d.select(F.col("doc_id").alias("hash"), F.when(F.col("doc_id") % 4 == 3, "other").otherwise("main").alias("tag"))
    return incremental.retrieve(c, tags, "the from", "main", 30).select("path", F.round("score", 6).alias("score"))


@query("""SELECT label, vec_id, round(s, 6) AS reranked FROM (SELECT label, vec_id, (label / 10.0)::DOUBLE + 0.2::DOUBLE * 0.5 + 0.1::DOUBLE * (1 - 2 * abs(0.25::DOUBLE - 0.5)) + CASE WHEN vec_id % 2 = 0 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN vec_id % 5 = 0 THEN 0.2 ELSE 0 END::DOUBLE + 0.15::DOUBLE * 0.4 AS s FROM embeddings)""")
def vector_rerank(t):
    r = t("embeddings").select("label", "vec_id", (F.col("label") / 10.0).alias("score"), F.lit(0.5).alias("quality"), F.lit(0.25).alias("complexity"), (F.col("vec_id") % 2 == 0).alias("exact"), (F.col("vec_id") % 5 == 0).alias("name_hit"), F.lit(0.4).alias("cross_similarity"))
    return vectors.rerank(r).select("label", "vec_id", F.round("reranked", 6).alias("reranked"))


@query("""SELECT vec_id FROM embeddings WHERE label IN (SELECT r_regionkey FROM region)""")
def vectors_without_orphans(t):
    return vectors.without_orphans(t("embeddings"), t("region").select(F.col("r_regionkey").alias("label")), "label").select("vec_id")


@query("""WITH x AS (SELECT doc_id, n_chars, n_chars / 2000.0 AS r, lang FROM documents)
SELECT doc_id, round(least(1.0, CASE WHEN r BETWEEN 0.3 AND 1.0 THEN 0.3 WHEN r > 1.0 THEN greatest(0.0, 0.3 - (r - 1.0) * 0.3) ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.4 WHEN lang = 'de' THEN 0.2 ELSE 0.0 END + 0.2)::DOUBLE, 6) AS quality FROM x""")
def chunk_quality(t):
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "de", "block").otherwise("other")
    return t("documents").select("doc_id", F.round(chunks.quality(F.col("n_chars"), 2000, kind, F.lit(True), F.lit(False)), 6).alias("quality"))


@query("""WITH s AS (SELECT n_chars AS size FROM documents), o AS (SELECT size, row_number() OVER (ORDER BY size) AS k, count(*) OVER () AS n FROM s)
SELECT count(*) AS chunks, sum(size)::BIGINT AS total, round(avg(size), 6) AS mean, min(size) AS least, max(size) AS most, (SELECT size FROM o WHERE k = n // 2 + 1) AS median FROM s""")
def chunk_statistics(t):
    return chunks.chunk_stats(t("documents").select(F.col("n_chars").alias("size"))).withColumn("mean", F.round("mean", 6))


@query()
def greedy_clusters(t):
    return rank.clusters(t("documents"), "doc_id", "text", 0.8)


@query()
def graph_refactoring(t):
    return graph.refactoring(_edges(t))


@query()
def document_concepts(t):
    return semantic.extract_concepts(text.lines(t("documents")))


@query()
def python_entities(t):
    d = t("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text", F.lit("python").alias("language"))
    return code.entities(d)


@query()
def detected_languages(t):
    from siftline.functions.languages import detect

    return t("documents").select("doc_id", detect(F.concat("source", F.lit("/file")), F.col("text")).alias("language"))


@query()
def semantic_ranking(t):
    return semantic.semantic_search(t("documents"), "from with", 0.01).withColumn("score", F.round("score", 6))
