"""Identity of document rows.

A row is the pair (id, th): th hashes the text and whether the id is null, so
rows of one id with different texts differ, and rows that agree in id and text
are one document. ``key`` is the id with 0 for null, which makes (key, th) a
plain equi-join and grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, TH = "__siftline_key", "__siftline_th"


def identity(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """(id, th, text) as columns."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return i, F.xxhash64(t, i.isNull()), t


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    i, th, t = identity(id_col, text_col)
    return docs.select(i.alias("id"), th.alias("th"), t.alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns KEY and TH added."""
    i, th, _ = identity(id_col, text_col)
    return docs.withColumns({KEY: F.coalesce(i, F.lit(0)), TH: th})
