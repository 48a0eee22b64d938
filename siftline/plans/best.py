"""Best rows of many queries, kept a task at a time."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.scratch import new_folder

#: Queries of a file, and rows that are compared with them at a time.
BLOCK, ROWS = 4096, 1024


def blocks(queries: DataFrame, id_col: str) -> tuple[str, list[str]]:
    """Queries, as they come, in files of about ``BLOCK`` → folder, names."""
    folder = new_folder(queries.sparkSession, "queries")
    n = max(1, -(-queries.count() // BLOCK))

    def write(key, pdf):
        pdf.to_pickle(tmp := f"{folder}/{key[0]}-{os.getpid()}.tmp")
        os.replace(tmp, f"{folder}/{key[0]}")
        return pd.DataFrame({"block": [key[0]]})

    done = queries.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block")).applyInPandas(write, "block int")
    return folder, [f"{folder}/{r.block}" for r in done.collect()]  # a row for 4096 queries


class Best:
    """The ``k`` best (key, id) of each query of a block: greatest key, then least id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.rows = ids, k, None
        self.least = np.full(len(ids), -np.inf)

    def candidates(self, s: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) that may be among the best; NaN may."""
        least = self.least - slack
        if len(s) > self.k + 1:  # one of them may be the query itself
            some = ~(s < least)
            if some.sum() > 16 * s.shape[1]:
                cut = np.partition(s, len(s) - self.k - 1, axis=0)[len(s) - self.k - 1]
                least = np.fmax(least, cut - slack)
        return np.nonzero(~(s < least))

    def add(self, q: np.ndarray, ids: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        new = pd.DataFrame({"q": q, "key": -key, "id": ids, "score": score})
        new = new[new["id"].to_numpy() != self.ids[q]]
        if not len(new):
            return
        rows = new if self.rows is None else pd.concat([self.rows, new], ignore_index=True)
        rows = rows.sort_values(["q", "key", "id"])
        self.rows = rows[rows.groupby("q").cumcount() < self.k]
        n = np.bincount(self.rows["q"], minlength=len(self.ids))
        last = self.rows.groupby("q")["key"].max()
        full = last.index[n[last.index] >= self.k]
        self.least[full] = -last[full]

    def found(self, id_col: str) -> pd.DataFrame | None:
        return None if self.rows is None else pd.DataFrame({"query_id": self.ids[self.rows["q"]], id_col: self.rows["id"], "score": self.rows["score"]})
