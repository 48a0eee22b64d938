"""Interpolated modified Kneser-Ney language model over UTF-8 bytes.

Spark counts the n-grams of every document: a task sorts the packed bytes of its
texts and emits (group, n-gram, count) once per distinct n-gram. The highest
order keeps those counts; each lower order counts the distinct left extensions
of its n-grams. Discounts come from the counts of counts of each group and
order. Every n-gram gets its fully interpolated probability, and every context
the weight left for shorter ones, so a lookup of a known n-gram is one probe.

The model is a folder of shards, each a sorted array of 63-bit hashes with a
radix index over their leading bits and two float32 arrays. Workers map the
files into memory. An n-gram is at most seven bytes, its hash covers group,
order and bytes.

A text is its UTF-8 bytes, preceded by ``order - 1`` start bytes and followed by
an end byte. ``group_col`` gives each value of a column (null is a group too) a
model of its own; without it there is one model.

Cases: null texts are not documents and get no score. An empty text is an end
byte alone. Repeated rows count and score as often as they occur. Texts of any
length are counted and scored whole. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import kernels as K
from siftline.plans.scratch import cut, drop, new_path, release

ORDER = 5
START, END = 2, 3
VOCABULARY = 257
_SHARD_ROWS = 1 << 21
#: Bytes of text counted or scored at once.
_PIECE = 1 << 18
#: Most groups whose discounts are broadcast.
_FEW_GROUPS = 10_000


def _grams(b: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram ending at each byte and end byte; first position of each document."""
    n = len(off) - 1
    first = off + np.arange(n + 1)
    body = np.full(int(first[-1]), END, np.uint8)
    inner = np.ones(len(body), bool)
    inner[first[1:] - 1] = False
    body[inner] = b
    key = body.astype(np.uint64)
    starts = first[:-1]
    size = np.diff(first)
    for back in range(1, order):
        prev = np.empty_like(body)
        prev[back:] = body[:-back]
        prev[:back] = START
        for k in range(back):
            prev[starts[size > k] + k] = START
        key |= prev.astype(np.uint64) << K.U(8 * back)
    return key, first


def _pieces(buf: np.ndarray, off: np.ndarray):
    for i, j in K.runs(off, _PIECE):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def _by_group(batch):
    """(group, bytes, offsets, rows) for each group of the batch."""
    names = batch.column("grp")
    text = batch.column("text")
    some = text.is_valid()
    if text.null_count:
        names, text = names.filter(some), text.filter(some)
    rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    if not len(text):
        return
    code = names.dictionary_encode()
    idx = code.indices.fill_null(-1).to_numpy()
    for g in np.unique(idx):
        name = None if g < 0 else code.dictionary[int(g)].as_py()
        if (idx == g).all():
            yield name, *K.utf8(text), rows
        else:
            at = np.flatnonzero(idx == g)
            yield name, *K.utf8(text.take(pa.array(at))), rows[at]


def _merge(parts):
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    o = np.argsort(key, kind="stable")
    key, n = key[o], n[o]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(n, at)


def _count(order: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            for name, buf, off, _ in _by_group(batch):
                parts = held.setdefault(name, [])
                for _, _, b, o in _pieces(buf, off):
                    key = np.sort(_grams(b, o, order)[0])
                    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    parts.append((key[at], np.diff(at, append=len(key))))
                    if sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                        parts[:] = [_merge(parts)]
        for name, parts in held.items():
            key, n = _merge(parts)
            for i in range(0, len(key), 1 << 17):
                k = key[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 17)].astype(np.int64))],
                    names=["grp", "gram", "n"],
                )

    return run


def _rows(docs: DataFrame, text_col: str, group_col: str | None, *more) -> DataFrame:
    group = F.col(f"`{group_col}`").cast("string") if group_col else F.lit("")
    return docs.select(*more, group.alias("grp"), F.col(f"`{text_col}`").cast("string").alias("text"))


def counts(docs: DataFrame, text_col: str = "text", group_col: str | None = None, order: int = ORDER) -> DataFrame:
    """(grp, gram, n): occurrences of every n-gram of the highest order."""
    return (
        _rows(docs, text_col, group_col)
        .mapInArrow(_count(order), "grp string, gram long, n long")
        .groupBy("grp", "gram")
        .agg(F.sum("n").alias("n"))
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more.

    Where a count of counts is missing they fall back to 0.5, 1 and 1.5; each
    stays between 0.01 and its count, so that every byte keeps some probability.
    """
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), float(k)) for k, d in enumerate(raw, 1))


def _discounted(table: DataFrame) -> DataFrame:
    """(grp, gram, n) → + discount d, computed from the table's counts of counts."""
    c = [F.sum((F.col("n") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    none = F.least("n1", "n2", "n3") == 0
    one = [1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), 3 - 4 * y * F.col("n4") / F.col("n3")]
    d = [
        F.when(none, F.lit(0.5 * k)).otherwise(F.least(F.greatest(x, F.lit(0.01)), F.lit(float(k)))).alias(f"d{k}")
        for k, x in enumerate(one, 1)
    ]
    per = table.groupBy("grp").agg(*c).select(F.col("grp").alias("g"), *d)
    few = per.limit(_FEW_GROUPS + 1).collect()
    if len(few) <= _FEW_GROUPS:  # beyond that, a shuffled join
        per = F.broadcast(table.sparkSession.createDataFrame(few, per.schema))
    at = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return table.join(per, F.col("grp").eqNullSafe(F.col("g"))).withColumn("d", at).select("grp", "gram", "n", "d")


def estimate(top: DataFrame, order: int = ORDER, held: list[DataFrame] | None = None) -> DataFrame:
    """Counts of the highest order → (grp, size, gram, p, rest).

    ``p`` is the interpolated probability of the n-gram's last byte after the
    others; ``rest`` the weight of shorter contexts after it (null unless it
    occurs as a context). Written tables that it reads are added to ``held``.
    """
    held = [] if held is None else held
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        tables[k] = tables[k + 1].groupBy("grp", low.alias("gram")).agg(F.count("*").alias("n"))
        if k <= order - 1:
            tables[k] = cut(tables[k], f"order{k}")
            held.append(tables[k])
    shorter, out = None, []
    for k in range(1, order + 1):
        t = _discounted(tables[k]).withColumn("ctx", F.shiftright("gram", 8))
        ctx = t.groupBy("grp", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        ctx = ctx.select(F.col("grp").alias("cg"), F.col("ctx").alias("cc"), F.col("total").cast("double").alias("total"), (F.col("left") / F.col("total")).alias("rest"))
        t = t.join(ctx, F.col("grp").eqNullSafe(F.col("cg")) & (F.col("ctx") == F.col("cc")))
        if shorter is None:
            t = t.withColumn("q", F.lit(1.0 / VOCABULARY))
        else:
            low = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
            s = shorter.select(F.col("grp").alias("sg"), F.col("gram").alias("sk"), F.col("p").alias("q"))
            t = t.join(s, F.col("grp").eqNullSafe(F.col("sg")) & (low == F.col("sk")))
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("q")
        shorter = cut(t.select("grp", F.lit(k).alias("size"), "gram", p.alias("p")), f"p{k}")
        held.append(shorter)
        out.append((shorter, ctx.select("cg", "cc", F.col("rest").alias("rest"))))
    model = None
    for k, (probs, _) in enumerate(out, 1):
        if k < order:  # the contexts of order k + 1 are n-grams of size k
            rest = out[k][1]
            probs = probs.join(rest, F.col("grp").eqNullSafe(F.col("cg")) & (F.col("gram") == F.col("cc")), "full").select(
                F.coalesce("grp", "cg").alias("grp"), F.lit(k).alias("size"), F.coalesce("gram", "cc").alias("gram"), "p", "rest"
            )
        else:
            probs = probs.withColumn("rest", F.lit(None).cast("double"))
        model = probs if model is None else model.unionByName(probs)
    empty = out[0][1].select(F.col("cg").alias("grp"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("gram"), F.lit(None).cast("double").alias("p"), "rest")
    return model.unionByName(empty)


def group_salt(name: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\0" if name is None else b"\1" + name.encode())


def _hash(gram: np.ndarray, size, salt) -> np.ndarray:
    return K.mix(K.mix(gram + (np.asarray(size, np.uint64) << K.U(56))) ^ salt) >> K.U(1)


def _hashed(shards: int):
    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            names = batch.column("grp").dictionary_encode()
            salts = np.array([group_salt(x) for x in names.dictionary.to_pylist()] + [group_salt(None)], np.uint64)
            h = _hash(batch.column("gram").to_numpy().view(np.uint64), batch.column("size").to_numpy(), salts[names.indices.fill_null(len(salts) - 1).to_numpy()])
            logs = [np.log(batch.column(c).cast(pa.float64()).fill_null(1.0).to_numpy()) for c in ("p", "rest")]
            known = batch.column("p").is_valid().to_numpy(zero_copy_only=False)
            logs[0][~known] = np.nan
            shard = (h >> K.U(63 - shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), *(pa.array(x.astype(np.float32)) for x in logs)], names=["shard", "h", "p", "rest"])

    return run


def _store(folder: str):
    def save(shard, parts):
        h, p, rest = (np.concatenate(x) for x in zip(*parts))
        bits = max(1, int(len(h)).bit_length() - 1)
        lead = (h >> np.int64(63 - _lead(folder) - bits)) & np.int64((1 << bits) - 1)
        radix = np.zeros((1 << bits) + 1, np.uint32)
        radix[1:] = np.cumsum(np.bincount(lead, minlength=1 << bits))
        for name, x in (("h", np.r_[h, np.int64(2**63 - 1)]), ("p", np.r_[p, np.float32(np.nan)]), ("rest", np.r_[rest, np.float32(0)]), ("radix", radix)):
            tmp = f"{folder}/{shard}.{name}.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                np.save(f, x)
            os.replace(tmp, f"{folder}/{shard}.{name}.npy")
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    def run(batches):
        now, parts = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cols = [batch.column(c).to_numpy() for c in ("h", "p", "rest")]
            cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if now is not None and shard[s] != now:
                    yield save(now, parts)
                    parts = []
                now = int(shard[s])
                parts.append([c[s:e] for c in cols])
        if parts:
            yield save(now, parts)

    return run


def _lead(folder: str) -> int:
    return int(folder.rstrip("/").rsplit("-b", 1)[1])


def local_path(uri: str) -> str:
    """Path of a file: URI; the shared folder has to be mounted on every worker."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError("the model's folder must be a mounted path that workers can map, got " + uri)
    return uri.removeprefix("file://")


def store(model: DataFrame, n: int) -> str:
    """Write the arrays below the shared folder; returns the folder."""
    spark = model.sparkSession
    bits = max(0, (n // _SHARD_ROWS).bit_length())
    folder = local_path(new_path(spark, "lm")) + f"-b{bits}"
    os.makedirs(folder, exist_ok=True)
    done = (
        model.select("grp", F.col("size").cast("long").alias("size"), "gram", "p", "rest")
        .mapInArrow(_hashed(bits), "shard int, h long, p float, rest float")
        .repartition(max(1, min(1 << bits, 4096)), "shard")
        .sortWithinPartitions("shard", "h")
        .mapInArrow(_store(folder), "shard int, n long")
        .collect()  # one row a shard
    )
    with open(f"{folder}/shards.json", "w") as f:
        json.dump({str(r.shard): r.n for r in done}, f)
    return folder


class Model:
    """Memory-mapped reader of a stored model."""

    _open: dict[str, Model] = {}

    @classmethod
    def at(cls, folder: str) -> Model:
        if folder not in cls._open:
            cls._open.clear()
            cls._open[folder] = cls(folder)
        return cls._open[folder]

    def __init__(self, folder: str):
        self.bits = _lead(folder)
        with open(f"{folder}/shards.json") as f:
            names = json.load(f)
        self.shards = {int(k): tuple(np.load(f"{folder}/{k}.{x}.npy", mmap_mode="r") for x in ("h", "p", "rest", "radix")) for k in names}
        self.salts: dict = {}

    def salt(self, name):
        if name not in self.salts:
            self.salts[name] = K.U(group_salt(name))
        return self.salts[name]

    def _in_shard(self, shard: int, h: np.ndarray) -> np.ndarray:
        keys, _, _, radix = self.shards[shard]
        bits = (len(radix) - 1).bit_length() - 1
        keys, radix = np.asarray(keys), np.asarray(radix)
        i = radix[(h >> K.U(63 - self.bits - bits)) & K.U((1 << bits) - 1)].astype(np.int64)
        h = h.view(np.int64)
        at = keys[i]
        todo = np.flatnonzero(at < h)
        while len(todo):
            i[todo] += 1
            todo = todo[keys[i[todo]] < h[todo]]
        i[keys[i] != h] = len(keys) - 1
        return i

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p (NaN where unknown) and log weight of shorter contexts (0 where unknown)."""
        p, rest = np.full(len(h), np.nan, np.float32), np.zeros(len(h), np.float32)
        if not self.bits:
            if 0 in self.shards:
                i = self._in_shard(0, h)
                return np.asarray(self.shards[0][1])[i], np.asarray(self.shards[0][2])[i]
            return p, rest
        shard = (h >> K.U(63 - self.bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for k in self.shards:
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                i = self._in_shard(k, h[at])
                p[at], rest[at] = self.shards[k][1][i], self.shards[k][2][i]
        return p, rest

    def score(self, key: np.ndarray, order: int, name) -> np.ndarray:
        """log p of the last byte of each packed n-gram."""
        salt = self.salt(name)
        out = self.lookup(_hash(key, order, salt))[0].astype(np.float64)
        todo = np.flatnonzero(np.isnan(out))
        lost = np.zeros(len(todo))
        for k in range(order - 1, 0, -1):
            if not len(todo):
                return out
            mask = K.U((1 << (8 * k)) - 1)
            lost += self.lookup(_hash((key[todo] >> K.U(8)) & mask, k, salt))[1]
            got = self.lookup(_hash(key[todo] & mask, k, salt))[0].astype(np.float64)
            known = ~np.isnan(got)
            out[todo[known]] = got[known] + lost[known]
            todo, lost = todo[~known], lost[~known]
        if len(todo):
            lost += self.lookup(_hash(np.zeros(len(todo), np.uint64), 0, salt))[1]
            out[todo] = lost - np.log(VOCABULARY)
        return out


def _score(folder: str, order: int):
    def run(batches):
        np.seterr(over="ignore")
        model = Model.at(folder)
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for name, buf, off, rows in _by_group(batch):
                for i, j, b, o in _pieces(buf, off):
                    key, first = _grams(b, o, order)
                    total[rows[i:j]] = np.add.reduceat(model.score(key, order, name), first[:-1])
                    size[rows[i:j]] = np.diff(first)
            keep = pa.array(size > 0)
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.array(size), pa.array(total)], names=["id", "grp", "n", "log_p"])
            yield out.filter(keep)

    return run


def train(docs: DataFrame, text_col: str = "text", group_col: str | None = None, order: int = ORDER) -> str | None:
    """Count, estimate and store a model of all documents; None for no documents."""
    top = cut(counts(docs, text_col, group_col, order), "grams")
    n = top.count()
    if not n:
        return None
    held = [top]
    folder = store(estimate(top, order, held), 2 * n)
    for table in held:
        drop(table)
    release(docs.sparkSession)
    return folder


def score(docs: DataFrame, folder: str | None, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, order: int = ORDER) -> DataFrame:
    """(id, grp, n, log_p): bytes with the end byte, and their natural log probability."""
    rows = _rows(docs, text_col, group_col, F.col(f"`{id_col}`").cast("long").alias("id"))
    if folder is None:
        return rows.where("false").select("id", "grp", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("log_p"))
    return rows.mapInArrow(_score(folder, order), "id long, grp string, n long, log_p double")


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every document under the corpus' own model."""
    got = score(docs, train(docs, text_col, group_col, order), id_col, text_col, group_col, order)
    return got.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("log_p").alias("log_prob"), F.exp(-F.col("log_p") / F.col("n")).alias("perplexity")
    )
