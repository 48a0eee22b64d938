import random

import numpy as np
import pytest

from siftline.llm import ngram_lm, word_lm
from siftline.llm import perplexity_rules as rules


def corpus():
    rng = random.Random(8)
    ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(ws) for _ in range(rng.randrange(50, 400))), "en" if k % 2 else None) for k in range(300)]
    rows += [(1000 + k, "".join(rng.choice("!#$%&QWERTZ0123456789") for _ in range(900)), "en") for k in range(5)]
    rows += [(2000 + k, "b" * 3000, None) for k in range(5)]
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    rows = corpus() + [(3000, None, "en"), (3001, "", "en"), (3002, "", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, keep double")
    judged = rules.judged(df).collect()
    assert len(judged) == len(rows) - 1
    kept = {r.id for r in judged if r.keep_letters and r.keep_words}
    assert not kept & {*range(2000, 2005), *range(1000, 1005)} and len(kept & set(range(300))) >= 297
    assert kept == {r.doc_id for r in rules.kept(df).collect()}
    # the bands against sorted rates, in steps of 0.0001
    for lang in ("en", None):
        for c, above in (("letters", rules.ABOVE), ("words", rules.WORDS_ABOVE)):
            rate = np.array([r[c] for r in judged if r.grp == lang])
            q1, q3 = np.ceil(np.quantile(rate, [0.25, 0.75], method="inverted_cdf") * 10_000) / 10_000
            for r in judged:
                if r.grp == lang:
                    wide = (q3 - q1) * (1 + rules.SHORT / r.n)
                    assert r[f"high_{c}"] == pytest.approx(q3 + above * wide, rel=1e-9)
                    assert r[f"low_{c}"] == pytest.approx(q1 - rules.BELOW * wide, rel=1e-9)
                    assert r[f"keep_{c}"] == (r[f"low_{c}"] <= r[c] <= r[f"high_{c}"])


def test_rates_are_those_of_both_models(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in corpus()[::7]], "doc_id long, text string, lang string, keep double")
    got = {r.id: r for r in rules.rates(df).collect()}
    letters = ngram_lm.score(df, ngram_lm.train(df, "text", "lang"), group_col="lang").collect()
    words = word_lm.score(df, group_col="lang", leave_out=True, order=2).collect()
    for c, rows in (("letters", letters), ("words", words)):
        assert len(rows) == len(got)
        for r in rows:
            assert got[r.id][c] == pytest.approx(-r.log_p / r.n, rel=1e-6) and got[r.id].n == r.n


def test_repeated_rows_null_ids_and_a_long_text(spark):
    rows = corpus()[:120]
    rows += [rows[1], (None, "b" * 3000, "en"), (None, rows[3][1], "en"), (4000, (rows[5][1] + " ") * 2500, "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, keep double")
    judged = rules.judged(df).collect()
    assert len(judged) == len(rows) and max(r.n for r in judged) > 1 << 21
    kept = [r.doc_id for r in rules.kept(df).collect()]
    assert kept.count(1) == 2 and kept.count(None) == 1


def test_empty(spark):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert rules.kept(df).count() == rules.kept(df.where("false")).count() == 0
