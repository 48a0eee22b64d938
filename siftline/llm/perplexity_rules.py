"""Quality rule: bands of n-gram perplexity for each language, of letters and of words.

Each language gets two models counted over all its documents: a byte n-gram
model (:mod:`siftline.llm.ngram_lm`) and a model of word pairs
(:mod:`siftline.llm.word_lm`), which scores a document with its own counts left
out. One pass scores a document by both. Its rate is its log perplexity a byte.
The band of a language reaches from ``below`` to ``above`` interquartile ranges
beyond the lower and upper quartile of its documents' rates, by a histogram of
all rates in steps of 0.0001; a short document's rate varies more, so its band
widens by ``1 + short / n`` for n bytes. A document stays if it is inside both
bands.

Cases: null texts are no documents and are not kept; an empty text is an end
mark alone, whose rate is judged like any other. A null language is a language
of its own, a null id an id like any other. Repeated rows count as often as they
occur and are kept or rejected together. The bounds belong to the band. Texts of
any length are scored whole. Further columns are ignored. An empty table keeps
nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import ngram_lm, word_lm
from siftline.plans.scratch import cut

BELOW, ABOVE, SHORT = 5.0, 4.0, 200
#: Of the word model, above: the usual fence for outliers.
WORDS_ABOVE = 1.5
WORDS_ORDER = 2
_STEP = 10_000
_RATES = "id long, grp string, n long, letters double, words double"


def _score(letters_folder: str, order: int, words_folder: str):
    letters, words = ngram_lm._score(letters_folder, order), word_lm._score(words_folder, True, True)

    def run(batches):
        for batch in batches:
            (a,), (b,) = letters([batch]), words([batch])
            yield pa.RecordBatch.from_arrays([*(a.column(c) for c in ("id", "grp", "n", "log_p")), b.column("log_p")], names=["id", "grp", "n", "letters", "words"])

    return run


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ngram_lm.ORDER) -> DataFrame:
    """(id, grp, n, letters, words): bytes with the end mark, and the log perplexity a byte under both models."""
    rows = ngram_lm._rows(docs, text_col, lang_col, F.col(f"`{id_col}`").cast("long").alias("id"))
    folders = ngram_lm.train(docs, text_col, lang_col, order), word_lm.train(docs, text_col, lang_col, WORDS_ORDER)
    if None in folders:
        return docs.sparkSession.createDataFrame([], _RATES)
    got = rows.mapInArrow(_score(folders[0], order, folders[1]), _RATES)
    return cut(got.withColumns({c: -F.col(c) / F.col("n") for c in ("letters", "words")}), "rates")


def quartiles(rated: DataFrame, rate: str) -> DataFrame:
    """(g, low, high): the least step of each group that a quarter, and three quarters, of its rates don't exceed."""
    steps = rated.groupBy(F.col("grp").alias("g"), F.ceil(F.col(rate) * _STEP).alias("step")).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("g").orderBy("step"))
    steps = steps.withColumns({"up_to": up_to, "all": F.sum("n").over(Window.partitionBy("g"))})
    return steps.groupBy("g").agg(*(F.min(F.when(F.col("up_to") >= q * F.col("all"), F.col("step") / _STEP)).alias(c) for c, q in (("low", 0.25), ("high", 0.75))))


def _inside(rate: Column, n: Column, low: Column, high: Column, below: float, above: float, short: int) -> tuple[Column, Column]:
    wide = (1 + F.lit(float(short)) / n) * (high - low)
    return low - below * wide, high + above * wide


def banded(rated: DataFrame, rate: str, below: float, above: float, short: int = SHORT) -> DataFrame:
    """``rated`` with the columns low_, high_ and keep_ of one model's band."""
    q = quartiles(rated, rate).select(F.col("g"), F.col("low").alias("q1"), F.col("high").alias("q3"))
    low, high = _inside(F.col(rate), F.col("n"), F.col("q1"), F.col("q3"), below, above, short)
    out = rated.join(q, F.col("grp").eqNullSafe(F.col("g"))).withColumns({f"low_{rate}": low, f"high_{rate}": high})
    return out.withColumn(f"keep_{rate}", F.col(rate).between(F.col(f"low_{rate}"), F.col(f"high_{rate}"))).drop("g", "q1", "q3")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    below: float = BELOW,
    above: float = ABOVE,
    words_above: float = WORDS_ABOVE,
    short: int = SHORT,
    order: int = ngram_lm.ORDER,
) -> DataFrame:
    """(id, grp, n, letters, words, and low_, high_ and keep_ of both) of every document."""
    return banded(banded(rates(docs, id_col, text_col, lang_col, order), "letters", below, above, short), "words", below, words_above, short)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity) of the documents inside both of their language's bands; perplexity is that of the words."""
    got = judged(docs, id_col, text_col, lang_col, **how).where("keep_letters and keep_words")
    return got.select(F.col("id").alias("doc_id"), F.col("grp").alias("lang"), F.col("n").alias("n_tokens"), F.exp("words").alias("perplexity"))
