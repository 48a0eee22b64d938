"""A directory tree as a corpus: every file, hidden and underscored names too."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline.functions.languages import detect
from siftline.operators.metadata import glob, glob_regex

SKIP = "**/.git/** **/.venv/** **/venv/** **/node_modules/** **/__pycache__/** **/dist/** **/build/** **/.tox/** **/.mypy_cache/**".split()
_PRUNE = {"." + x for x in ("git", "venv", "tox", "mypy_cache")} | {"venv", "node_modules", "__pycache__", "dist", "build"}


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    """One partition for the root's own files and one for each folder of the first two levels."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.links = options.get("followlinks", "false").lower() == "true"
        self.limit = int(options.get("maxbytes", 2_000_000))

    def partitions(self):
        out = [_Part(self.root, False)]
        for a in self._folders(self.root):
            out.append(_Part(a, False))
            out += [_Part(b, True) for b in self._folders(a)]
        return out

    def _folders(self, folder: str) -> list[str]:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=self.links) and e.name not in _PRUNE)

    def read(self, part: _Part) -> Iterator[tuple]:
        for folder, folders, files in os.walk(part.folder, followlinks=self.links):
            folders[:] = sorted(d for d in folders if d not in _PRUNE) if part.deep else []
            for name in sorted(files):
                path = os.path.join(folder, name)
                try:
                    st = os.stat(path)
                    data = None
                    if st.st_size <= self.limit:
                        with open(path, "rb") as f:
                            data = f.read()
                except OSError:
                    continue
                yield path, st.st_size, st.st_mtime, data


class TreeDataSource(DataSource):
    """``spark.read.format("tree").load(folder)``; options followLinks and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, mtime double, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text, used = [], []
        for data in pdf["content"]:
            t = e = None
            if data is not None:
                for e in ("utf-8-sig", "latin-1"):
                    try:
                        t = bytes(data).decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                head = t[:8192] if t else ""
                if "\0" in head or head and sum(c.isprintable() or c in "\n\r\t\f" for c in head) / len(head) <= 0.7:
                    t = e = None
            text.append(t)
            used.append(e)
        yield pdf[["path", "size", "mtime"]].assign(text=text, encoding=used)


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, follow_links: bool = False, max_bytes: int = 2_000_000) -> DataFrame:
    """(path, size, mtime, text, encoding, language, line_count, sha1) of the text files below a folder."""
    spark.dataSource.register(TreeDataSource)
    raw = spark.read.format("tree").option("followLinks", str(follow_links)).option("maxBytes", str(max_bytes)).load(root)
    if include:
        raw = raw.where(glob("path", include))
    raw = raw.where(~glob("path", exclude if exclude is not None else SKIP))
    files = raw.mapInPandas(_decoded, "path string, size long, mtime double, text string, encoding string").where("text is not null")
    files = files.withColumns({"language": detect(F.col("path"), F.col("text")), "line_count": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))), "sha1": F.sha1(F.encode("text", "utf-8"))})
    return files.where(F.col("language").isin(languages)) if languages else files


def repositories(root: str, depth: int = 3) -> list[str]:
    """Folders with a .git within ``depth`` levels; doesn't descend into one, nor into hidden or build folders."""
    out: list[str] = []

    def walk(folder: str, left: int) -> None:
        if os.path.exists(os.path.join(folder, ".git")):
            out.append(folder)
            return
        if left:
            for e in sorted(os.scandir(folder), key=lambda x: x.name):
                if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in _PRUNE:
                    walk(e.path, left - 1)

    walk(root, depth)
    return out


__all__ = ["TreeDataSource", "glob_regex", "read_tree", "repositories"]
