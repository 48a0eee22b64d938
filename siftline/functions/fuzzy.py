"""Edit distances, phonetic codes and fuzzy patterns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("levenshtein", "damerau_levenshtein", "jaro_winkler", "soundex", "metaphone")


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[x] = i
    return d[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity plus a tenth of the rest for each of up to four common leading characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = list(range(len(b))), []
    for i, x in enumerate(a):
        j = next((j for j in free if i - reach <= j <= i + reach and b[j] == x), None)
        if j is not None:
            free.remove(j)
            mine.append((i, j))
    if not mine:
        return 0.0
    m = len(mine)
    theirs = sorted(j for _, j in mine)
    off = sum(a[i] != b[j] for (i, _), j in zip(mine, theirs))
    jaro = (m / len(a) + m / len(b) + (m - off / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * (1 - jaro) / 10


#: Cells of the distance tables that are filled at a time.
_CELLS = 1 << 22


def _letters(words: list[str]) -> np.ndarray:
    """Code points, a row a word, 0 beyond its end."""
    x = np.array(words, dtype=np.str_)
    return x.view(np.uint32).reshape(len(words), -1) if x.dtype.itemsize else np.zeros((len(words), 0), np.uint32)


def damerau_all(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`damerau` of each pair; the tables of many pairs are filled cell by cell together."""
    la, lb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    out, order, at = np.empty(len(a), np.int32), np.lexsort((lb, la)), 0
    while at < len(order):
        size, cells = 1, (la[order[at]] + 2) * (lb[order[at]] + 2)
        if cells > _CELLS // 4:
            out[order[at]] = damerau(a[order[at]], b[order[at]])
            at += 1
            continue
        size = max(1, _CELLS // max(cells, 64))
        who = order[at : at + size]
        while (m := (la[who].max() + 2) * (lb[who].max() + 2) * len(who)) > 2 * _CELLS and len(who) > 1:
            who = who[: max(1, len(who) // 2)]
        at += len(who)
        x, y = _letters([a[i] for i in who]), _letters([b[i] for i in who])
        n, w, h = len(who), x.shape[1], y.shape[1]
        far, each = la[who] + lb[who], np.arange(n)
        d = np.empty((w + 2, h + 2, n), np.int32)
        d[:] = far
        d[1:, 1] = np.arange(w + 1)[:, None]
        d[1, 1:] = np.arange(h + 1)[:, None]
        last = np.zeros((h, n), np.int32)  # the last row with the letter of each column
        for i in range(1, w + 1):
            seen = np.zeros(n, np.int32)
            for j in range(1, h + 1):
                same, k = x[:, i - 1] == y[:, j - 1], last[j - 1]
                swap = d[k, seen, each] + (i - k - 1) + 1 + (j - seen - 1)
                step = np.minimum(d[i + 1, j], d[i, j + 1]) + 1
                d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, step), swap)
                seen[same] = j
            for j in range(1, h + 1):
                last[j - 1][x[:, i - 1] == y[:, j - 1]] = i
        out[who] = d[la[who] + 1, lb[who] + 1, each]
    return out


@F.pandas_udf(T.IntegerType())
def _damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="Int64")
    some = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    if len(some):
        out.iloc[some] = damerau_all(a.iloc[some].tolist(), b.iloc[some].tolist())
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)])


# Else Spark would call them below a distinct, on every occurrence of a word, and again for each use of the result.
damerau_levenshtein = _damerau.asNondeterministic()
jaro_winkler_similarity = _jaro_winkler.asNondeterministic()


_CODES = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def soundex(word: Column) -> Column:
    """Simplified soundex: uncoded letters vanish without separating equal codes; the first letter's code isn't compared."""
    u = F.upper(word)
    letters = "".join(_CODES.values())
    digits = "".join(d * len(v) for d, v in _CODES.items())
    rest = F.translate(F.regexp_replace(F.substring(u, 2, 1 << 30), f"[^{letters}]", ""), letters, digits)
    rest = F.regexp_replace(rest, r"(\d)\1+", "$1")
    return F.when(word == "", F.lit("0000")).otherwise(F.substring(F.concat(F.substring(u, 1, 1), rest, F.lit("000")), 1, 4))


_SOUNDS = "PH F,GH F,CK K,SCH SK,QU KW,TH T,SH S,CH K,WH W,X KS"


def metaphone(word: Column) -> Column:
    """Simplified metaphone: ten replacements in turn, then no vowels after the first character, four characters."""
    u = F.upper(word)
    for old, new in (p.split() for p in _SOUNDS.split(",")):
        u = F.replace(u, F.lit(old), F.lit(new))
    return F.substring(F.concat(F.substring(u, 1, 1), F.translate(F.substring(u, 2, 1 << 30), "AEIOU", "")), 1, 4)


def distance(a: Column, b: Column, algorithm: str) -> Column:
    return F.levenshtein(a, b) if algorithm == "levenshtein" else damerau_levenshtein(a, b)


def similarity(a: Column, b: Column, algorithm: str = "levenshtein") -> Column:
    """1 - distance / longer length, Jaro-Winkler, or equality of phonetic codes."""
    if algorithm in ("levenshtein", "damerau_levenshtein"):
        longer = F.greatest(F.length(a), F.length(b))
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - distance(a, b, algorithm) / longer)
    if algorithm == "jaro_winkler":
        return jaro_winkler_similarity(a, b)
    code = {"soundex": soundex, "metaphone": metaphone}[algorithm]
    return (code(a) == code(b)).cast("double")


def words(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"(?U)\w+") -> DataFrame:
    """(id, word): each word of each text."""
    return corpus.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("word"))


def match_words(table: DataFrame, pattern: str, algorithm: str = "levenshtein", max_distance: int = 2, min_similarity: float = 0.6, col: str = "word") -> DataFrame:
    """Rows whose word is near the pattern, with distance and similarity; one comparison a distinct word."""
    p = F.lit(pattern.lower())
    one = table.select(col).distinct().withColumn("w", F.lower(col))
    if algorithm in ("levenshtein", "damerau_levenshtein"):  # most words differ too much in length
        one = one.where(F.abs(F.length("w") - len(pattern)) <= max_distance)
    if algorithm in ("levenshtein", "damerau_levenshtein"):
        longer = F.greatest(F.length("w"), F.length(p))
        one = one.withColumn("distance", distance(F.col("w"), p, algorithm)).where(F.col("distance") <= max_distance)
        one = one.withColumn("similarity", F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / longer))
    else:
        one = one.withColumn("similarity", similarity(F.col("w"), p, algorithm))
        one = one.withColumn("distance", ((1 - F.col("similarity")) * F.greatest(F.length(col), F.lit(len(pattern)))).cast("int"))
    one = one.where(F.col("similarity") >= min_similarity).select(col, "distance", "similarity")
    return table.join(one, col)


def match_words_any(table: DataFrame, pattern: str, algorithms: tuple = ALGORITHMS, max_distance: int = 2, min_similarity: float = 0.6) -> DataFrame:
    """Best similarity of each word over several algorithms; ties go to the earlier algorithm."""
    one = table.select("word").distinct()
    every = None
    for k, a in enumerate(algorithms):
        got = match_words(one, pattern, a, max_distance, min_similarity).withColumns({"algorithm": F.lit(a), "k": F.lit(k)})
        every = got if every is None else every.unionByName(got)
    w = Window.partitionBy("word").orderBy(F.desc("similarity"), "k")
    best = every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "k")
    return table.join(best, "word")


def suggest(dictionary: DataFrame, word: str, limit: int = 5, algorithm: str = "damerau_levenshtein", col: str = "word") -> DataFrame:
    """(word, similarity): the nearest words of similarity above 0.3."""
    s = similarity(F.lower(col), F.lit(word.lower()), algorithm)
    one = dictionary.select(col).distinct()
    if algorithm in ("levenshtein", "damerau_levenshtein"):  # the distance is at least the difference in length
        short, long = F.least(F.length(col), F.lit(len(word))), F.greatest(F.length(col), F.lit(len(word)))
        one = one.where(short > 0.3 * long)
    return one.withColumn("similarity", s).where("similarity > 0.3").orderBy(F.desc("similarity"), col).limit(limit)


_ALIKE = "a@4 e3 i1l! o0 s5$z t7+ l1i! g9q b6 ck kc fph vw wv yi zs xks".split()


def fuzzy_pattern(pattern: str, max_distance: int = 2) -> str:
    """Regex with look-alike classes, optional characters and room for insertions."""
    if max_distance <= 0:
        return re.escape(pattern)
    alike = {g[0]: "[" + "".join(dict.fromkeys(g)) + "]" for g in _ALIKE}
    pieces = [alike.get(c, re.escape(c)) for c in pattern.lower()]
    gap = r"[a-zA-Z0-9_]"
    if max_distance == 1:
        return f"{gap}?".join(f"(?:{p})?{p}" for p in pieces)
    return (gap + "{0,2}").join(p if k % 2 else f"(?:{p})?" for k, p in enumerate(pieces))


def phonetic_matches(table: DataFrame, pattern: str, algorithm: str = "soundex", col: str = "word") -> DataFrame:
    """Rows whose word sounds like the pattern."""
    code = {"soundex": soundex, "metaphone": metaphone}[algorithm]
    return table.where(code(F.col(col)) == code(F.lit(pattern)))
