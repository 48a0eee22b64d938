"""Interpolated modified Kneser-Ney language model over words, counted in full.

Words are the bytes between ASCII white space, named by 64-bit hashes that are
salted with the group, so groups share the arrays but no n-gram. Each document
has ``order - 1`` start marks before it and an end mark behind it. No word is
out of vocabulary: the lowest order falls back to the word's spelling, each byte
and the word's end with probability 1 / 257.

Counting takes one pass for the vocabulary, whose sorted hashes number the
words, and one for the n-grams (word pairs: ``_PASSES``, each over its share of
the buckets, so that the disk holds one share at a time): a task sorts the
trigrams of a run of texts and
sends the distinct ones with their counts, as compressed columns of numbers, to
the bucket of their first two words. There they are added up, and the distinct
bigrams with the number of their left extensions go on to buckets of their own;
words get their numbers of left extensions and their sums as a context from
there. Equal n-grams are merged before every shuffle, and no key gathers more
than its distinct followers.

The model is a folder of stores, each the sorted 64-bit hashes of a bucket's
n-grams with their counts in a byte each and a sorted list of those that need
more; workers map them into memory. N-grams and contexts that occur once, most
of them, are not stored: absence means a count of one. Hence every document that
was counted is scored exactly. In other texts an n-gram that isn't stored counts
as unseen (``counted=False``), as if n-grams of count one had been pruned.

A document is scored where its text lies. ``leave_out`` scores each document by
the counts of all others: its own occurrences are taken from the counts, totals
and weights of every order, and what only it extends to the left from the lower
orders. Discounts are those of the whole corpus. ``order`` is 3, or 2 for a
smaller model of word pairs.

Cases: null texts are not documents and get no score; an empty text is an end
mark alone. Repeated rows count and score as often as they occur. A null group
is a group of its own. Texts of any length are counted and scored whole. Ids are
cast to long and may be null. Further columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import kernels as K
from siftline.llm.ngram_lm import _by_group, _rows, discounts, group_salt, local_path
from siftline.plans.scratch import cut, drop, new_path, release

START, END = K.U(0x5354415254), K.U(0x454E44)
SPELLED = np.log(257.0)
#: Bytes of text a run of counting, of scoring, a bucket of n-grams and a shard of the vocabulary.
_RUN, _PIECE, _BUCKET, _SHARD = 4 << 20, 4 << 20, 8 << 20, 64 << 20
#: Distinct pairs that a task adds up before it sends them, and passes over the texts that count pairs.
_HELD, _PASSES = 1 << 19, 2
_BLOB = "bucket int, size long, data binary"


def _enc(arrays: list[np.ndarray], level: int = 1) -> tuple[int, bytes]:
    """Unsigned integers of equal length as compressed byte planes, differences in the first; the inverse is :func:`_dec`."""
    head, body = [len(arrays), len(arrays[0])], []
    for k, x in enumerate(arrays):
        x = np.ascontiguousarray(x, dtype=np.uint64)
        if not k:
            x = np.diff(x, prepend=K.U(0))
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        head.append(width)
        body.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw), pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _dec(size: int, data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True), np.uint8)
    n_arrays, n = raw[:16].view(np.int64)
    at, out = 16 + 8 * int(n_arrays), []
    for width in raw[16:at].view(np.int64):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(x.view(np.uint64)[:, 0])
        at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _blobs(rows: list[tuple[int, int, bytes]]):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "size", "data"])


def _split(bucket: np.ndarray, arrays: list[np.ndarray], level: int = 1):
    """Arrays sorted by bucket → a blob for each bucket."""
    if len(bucket):
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        yield _blobs([(int(bucket[s]), *_enc([x[s:e] for x in arrays], level)) for s, e in zip(cuts[:-1], cuts[1:])])


def _gathered(batches):
    """(bucket, concatenated arrays) of rows sorted by bucket."""
    now, parts = None, []
    for batch in batches:
        for bucket, size, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "data"))):
            if parts and bucket != now:
                yield now, [np.concatenate(x) for x in zip(*parts)]
                parts = []
            now = bucket
            parts.append(_dec(size, data))
    if parts:
        yield now, [np.concatenate(x) for x in zip(*parts)]


def _save(path: str, key: np.ndarray, values: np.ndarray) -> None:
    """Sorted keys and an (n, c) array of counts: a byte each, and the list of those from 255 up."""
    flat = values.reshape(-1)
    more = np.flatnonzero(flat >= 255)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.array([len(key), len(values), values.shape[1], len(more)], np.int64).tofile(f)
        np.ascontiguousarray(key, dtype=np.uint64).tofile(f)
        more.astype(np.int64).tofile(f)
        flat[more].astype(np.int64).tofile(f)
        np.minimum(flat, 255).astype(np.uint8).tofile(f)
    os.replace(tmp, path)


class Store:
    """Memory-mapped counts written by :func:`_save`."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        keys, n, c, more = (int(x) for x in raw[:32].view(np.int64))
        at = 32 + 8 * keys
        self.key, self.at, self.more = raw[32:at].view(np.uint64), raw[at : at + 8 * more].view(np.int64), raw[at + 8 * more : at + 16 * more].view(np.int64)
        self.small = raw[at + 16 * more :].reshape(n, c)

    def values(self, i: np.ndarray) -> np.ndarray:
        out = self.small[i].astype(np.int64)
        r, c = np.nonzero(out == 255)
        if len(r):
            out[r, c] = self.more[np.searchsorted(self.at, i[r] * out.shape[1] + c)]
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        if not len(self.key):
            return np.full(len(key), -1)
        order = np.argsort(key)
        i = np.empty(len(key), np.int64)
        i[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return np.where(self.key[i] == key, i, -1)


class Words:
    """The numbered vocabulary: sorted hashes in shards by leading bits, and each word's group."""

    def __init__(self, folder: str):
        with open(f"{folder}/vocabulary.json") as f:
            v = json.load(f)
        self.bits, self.base, self.groups = v["bits"], np.array(v["base"], np.int64), v["groups"]
        self.shards = [Store(f"{folder}/v-{k}") for k in range(1 << self.bits)]

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> K.U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 for unknown ones."""
        out, cuts = np.empty(len(h), np.int64), np.searchsorted(self.shard(h), np.arange((1 << self.bits) + 1))
        for k, store in enumerate(self.shards):
            s = slice(cuts[k], cuts[k + 1])
            i = store.find(h[s])
            out[s] = np.where(i < 0, -1, i + self.base[k])
        return out

    def values(self, stores: list[Store], ids: np.ndarray, columns: int) -> np.ndarray:
        """Rows of stores that run parallel to the vocabulary."""
        out = np.zeros((len(ids), columns), np.int64)
        of = np.searchsorted(self.base, ids, "right") - 1
        for k in np.unique(of):
            at = np.flatnonzero(of == k)
            out[at] = stores[k].values(ids[at] - self.base[k])
        return out

    def group(self, ids: np.ndarray) -> np.ndarray:
        return self.values(self.shards, ids, 1)[:, 0]


def _sequence(b: np.ndarray, off: np.ndarray, salt) -> tuple[np.ndarray, ...]:
    """Hash and byte length of each word and end mark, and each document's first."""
    starts, ends, first = K.tokens(b, off, K.NOT_SPACE)
    at = first + np.arange(len(first))
    h, size = np.full(int(at[-1]), END), np.zeros(int(at[-1]), np.int64)
    inner = np.ones(len(h), bool)
    inner[at[1:] - 1] = False
    h[inner], size[inner] = K.word_hash(b, starts, ends), ends - starts
    return K.mix(h ^ salt), size, at


def _texts(batch, limit: int):
    """(group, salt, rows, hashes, sizes, first of each document) of runs of texts."""
    for name, buf, off, rows in _by_group(batch):
        salt = K.U(group_salt(name))
        for i, j in K.runs(off, limit):
            yield name, salt, rows[i:j], *_sequence(buf[off[i] : off[j]], off[i : j + 1] - off[i], salt)


def _grams(words: Words, h: np.ndarray, at: np.ndarray, salt, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the distinct words, and which of them each n-gram has, the last word last."""
    u, code = np.unique(np.r_[K.mix(START ^ salt), h], return_inverse=True)
    start, last = code[0], code[1:]
    out = [last]
    for back in range(1, order):
        w = np.r_[np.full(min(back, len(last)), start), last[: len(last) - back]]
        for k in range(back):
            some = at[:-1][np.diff(at) > k] + k
            w[some] = start
        out.insert(0, w)
    return words.ids(u), out


def _vocabulary(bits: int, groups: list):
    """Texts → blobs of (hash, group) for each shard."""

    def run(batches):
        np.seterr(over="ignore")
        code, held = {g: k for k, g in enumerate(groups)}, {}
        for batch in batches:
            for name, salt, _, h, _, _ in _texts(batch, _RUN):
                mine = held.setdefault(name, [])
                mine.append(np.unique(np.r_[K.mix(START ^ salt), h]))
                if sum(map(len, mine[1:])) > max(1 << 20, len(mine[0])):
                    mine[:] = [np.unique(np.concatenate(mine))]
        for name, mine in held.items():
            h = np.unique(np.concatenate(mine))
            shard = (h >> K.U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            yield from _split(shard, [h, np.full(len(h), code[name])])

    return run


def _number(folder: str):
    """Blobs of a shard → its store."""

    def run(batches):
        for shard, (h, g) in _gathered(batches):
            h, at = np.unique(h, return_index=True)
            _save(f"{folder}/v-{shard}", h, g[at][:, None].astype(np.int64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    return run


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct key in their order, and each row's key."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    code = np.empty(len(key), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[new], code


def _code(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct pair, and each row's pair; in order of the pairs while numbers are below 2 ** 32."""
    big = max(int(a.max()), int(b.max())) >= 1 << 32 if len(a) else False
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return _distinct(K.pair(a, b) if big else (a << K.U(32)) | b)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(key) % K.U(buckets)).astype(np.int64)


def _merged(code: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, sum of n) of each distinct (code, last), sorted by code."""
    at, inv = _code(code, last)
    return at, np.bincount(inv, n, len(at)).astype(np.int64)


def _count(folder: str, order: int, buckets: int, turn: int = 0, turns: int = 1):
    """Texts → blobs of distinct n-grams by the bucket of their leading words (trigrams), or of the pair; of pairs, those of every ``turns``-th bucket."""

    def run(batches):
        np.seterr(over="ignore")
        words, held = Words(folder), []

        def merged():
            a, b, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows, n = _merged(a, b, n)
            a, b = a[rows], b[rows]
            to = _bucket(K.pair(a.astype(np.uint64), b.astype(np.uint64)), buckets)
            o = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
            return _split(to[o], [a[o], b[o], n[o]], 3)

        for batch in batches:
            for _, salt, _, h, _, at in _texts(batch, _RUN // 4 if order == 2 else _RUN):
                ids, w = _grams(words, h, at, salt, order)
                w = [ids[x] for x in w]
                first, code = _code(w[0], w[1])
                if order == 2:
                    a, b, n = w[0][first], w[1][first], np.bincount(code, minlength=len(first))
                    mine = _bucket(K.pair(a.astype(np.uint64), b.astype(np.uint64)), buckets) % turns == turn
                    held.append((a[mine], b[mine], n[mine]))
                    if sum(len(x[0]) for x in held) > _HELD:
                        yield from merged()
                    continue
                b = _bucket(K.pair(w[0][first].astype(np.uint64), w[1][first].astype(np.uint64)), buckets)
                rank = np.empty(len(first), np.int64)
                rank[np.argsort(b, kind="stable")] = np.arange(len(first))
                rows, n = _merged(rank[code], w[2], np.ones(len(code)))
                yield from _split(b[code[rows]], [w[0][rows], w[1][rows], w[2][rows], n])
        if held:
            yield from merged()

    return run


def _tally(folder: str, order: int, part: int, words: Words, ids: np.ndarray, n: np.ndarray) -> None:
    """Counts of counts 1 to 4 of each group in a bucket, as a file."""
    g = words.group(ids)
    out = np.stack([np.bincount(g[n == k], minlength=len(words.groups)) for k in (1, 2, 3, 4)], 1)
    _save(f"{folder}/c{order}-{part}", np.empty(0, np.uint64), out)


def _sums(code: np.ndarray, size: int, n: np.ndarray) -> np.ndarray:
    """(total, followers of count 1, 2, 3 or more) of each context."""
    return np.stack([np.bincount(code, n, size), *(np.bincount(code[np.minimum(n, 3) == k], minlength=size) for k in (1, 2, 3))], 1).astype(np.int64)


def _trigrams(folder: str, buckets: int):
    """Blobs of trigrams → their stores, and blobs of the distinct bigrams with their left extensions."""

    def run(batches):
        np.seterr(over="ignore")
        words = Words(folder)
        for bucket, (a, b, c, n) in _gathered(batches):
            first, code = _code(a, b)
            rows, n = _merged(code, c, n)
            code, c = code[rows], c[rows]
            ctx = K.pair(a[first], b[first])
            many = n > 1
            key = K.pair(ctx[code[many]], c[many])
            o = np.argsort(key)
            _save(f"{folder}/g3-{bucket}", key[o], n[many][o][:, None])
            sums = _sums(code, len(first), n)
            many = sums[:, 0] > 1
            o = np.argsort(ctx[many])
            _save(f"{folder}/x3-{bucket}", ctx[many][o], sums[many][o])
            _tally(folder, 3, bucket, words, c.astype(np.int64), n)
            b = b[rows]
            at, inv = _code(b, c)
            left = np.bincount(inv, minlength=len(at))
            to = _bucket(K.pair(b[at], c[at]), buckets)
            o = np.argsort(to, kind="stable")
            yield from _split(to[o], [b[at][o], c[at][o], left[o]])

    return run


def _bigrams(folder: str):
    """Blobs of bigrams → their stores, and blobs of (word, left extensions, sums as a context) by vocabulary shard."""

    def run(batches):
        np.seterr(over="ignore")
        words = Words(folder)
        for bucket, (a, b, n) in _gathered(batches):
            rows, n = _merged(a, b, n)
            a, b = a[rows], b[rows]
            many = n > 1
            key = K.pair(a[many], b[many])
            o = np.argsort(key)
            _save(f"{folder}/g2-{bucket}", key[o], n[many][o][:, None])
            _tally(folder, 2, bucket, words, b.astype(np.int64), n)
            left, seen = np.unique(a, return_inverse=True)
            right, extended = np.unique(b, return_counts=True)
            ids = np.union1d(left, right)
            out = np.zeros((len(ids), 5), np.int64)
            out[np.searchsorted(ids, right), 0] = extended
            out[np.searchsorted(ids, left), 1:] = _sums(seen, len(left), n)
            ids = ids.astype(np.int64)
            shard = np.searchsorted(words.base, ids, "right") - 1
            yield from _split(shard, [ids, *out.T])

    return run


def _added(words: Words, batches):
    """(shard, sums of its words) of rows sorted by shard, one blob at a time; a blob has each word once."""
    now, out = None, None
    for batch in batches:
        for shard, size, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "data"))):
            if shard != now:
                if out is not None:
                    yield now, out
                now, out = shard, np.zeros((len(words.shards[shard].key), 5), np.int64)
            ids, *cols = _dec(size, data)
            out[ids.astype(np.int64) - words.base[shard]] += np.stack(cols, 1).astype(np.int64)
    if out is not None:
        yield now, out


def _unigrams(folder: str):
    """Blobs of a vocabulary shard → its store of left extensions and sums."""

    def run(batches):
        words = Words(folder)
        for shard, out in _added(words, batches):
            _save(f"{folder}/u-{shard}", np.empty(0, np.uint64), out)
            seen = np.flatnonzero(out[:, 0])
            _tally(folder, 1, shard, words, seen + words.base[shard], out[seen, 0])
            g = words.group(seen + words.base[shard])
            total = np.stack([np.bincount(g, out[seen, 0], len(words.groups)), *(np.bincount(g[np.minimum(out[seen, 0], 3) == k], minlength=len(words.groups)) for k in (1, 2, 3))], 1)
            _save(f"{folder}/t-{shard}", np.empty(0, np.uint64), total.astype(np.int64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    return run


def train(docs: DataFrame, text_col: str = "text", group_col: str | None = None, order: int = 3) -> str | None:
    """Count all documents and store the model; returns its folder, None for no documents."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    rows = _rows(docs, text_col, group_col)
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("text").alias("n")).first()
    if not size.n:
        return None
    groups = [r.grp for r in rows.where("text is not null").select("grp").distinct().collect()]  # a row a group
    folder = local_path(new_path(spark, "wordlm"))
    os.makedirs(folder, exist_ok=True)
    bits = max(0, ((size.b or 0) // _SHARD).bit_length())
    buckets = max(2, (size.b or 0) // _BUCKET + 1)

    def sent(df: DataFrame, parts: int) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    shards = sent(rows.mapInArrow(_vocabulary(bits, groups), _BLOB), 1 << bits).mapInArrow(_number(folder), "shard int, n long").collect()
    size = {r.shard: r.n for r in shards}
    for k in set(range(1 << bits)) - set(size):
        _save(f"{folder}/v-{k}", np.empty(0, np.uint64), np.empty((0, 1), np.int64))
    base = np.cumsum([0] + [size.get(k, 0) for k in range((1 << bits) - 1)]).tolist()
    with open(f"{folder}/vocabulary.json", "w") as f:
        json.dump({"bits": bits, "base": base, "groups": groups}, f)
    release(spark)
    turns, sums = _PASSES if order == 2 else 1, []
    for turn in range(turns):
        grams = sent(rows.mapInArrow(_count(folder, order, buckets, turn, turns), _BLOB), buckets)
        if order == 3:
            grams = sent(grams.mapInArrow(_trigrams(folder, buckets), _BLOB), buckets)
        sums.append(grams.mapInArrow(_bigrams(folder), _BLOB))
        if turns > 1:
            sums[turn] = cut(sums[turn], "sums")
            del grams
            release(spark)
    sent(reduce(DataFrame.union, sums), 1 << bits).mapInArrow(_unigrams(folder), "shard int").collect()
    for table in sums:
        drop(table)
    release(spark)
    for k in set(range(1 << bits)) - {k for k in range(1 << bits) if os.path.exists(f"{folder}/u-{k}")}:
        _save(f"{folder}/u-{k}", np.empty(0, np.uint64), np.zeros((size.get(k, 0), 5), np.int64))

    def added(what: str) -> np.ndarray:
        # a row a group from each bucket
        files = [f"{folder}/{what}-{k}" for k in range(max(buckets, 1 << bits)) if os.path.exists(f"{folder}/{what}-{k}")]
        return sum(s.values(np.arange(len(groups))) for s in map(Store, files))

    d = [[discounts(*map(int, r)) for r in added(f"c{k}")] for k in range(1, order + 1)]
    total = added("t")
    out = [{"d": [x[g] for x in d], "total": int(total[g, 0]), "left": float(np.dot(d[0][g], total[g, 1:]))} for g in range(len(groups))]
    with open(f"{folder}/model.json", "w") as f:
        json.dump({"order": order, "buckets": buckets, "groups": out}, f)
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
        with open(f"{folder}/model.json") as f:
            m = json.load(f)
        self.words, self.order, self.buckets = Words(folder), m["order"], m["buckets"]
        self.info = dict(zip(self.words.groups, m["groups"]))
        self.folder, self.stores = folder, {}
        self.uni = [Store(f"{folder}/u-{k}") for k in range(1 << self.words.bits)]

    def find(self, what: str, bucket: np.ndarray, key: np.ndarray, columns: int, absent: list[int]) -> np.ndarray:
        """(n, columns) counts; ``absent`` where the store doesn't hold the key."""
        out = np.empty((len(key), columns), np.int64)
        out[:] = absent
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            if (what, k) not in self.stores:
                path = f"{self.folder}/{what}-{k}"
                self.stores[what, k] = Store(path) if os.path.exists(path) else None
            if store := self.stores[what, k]:
                at = order[cuts[k] : cuts[k + 1]]
                i = store.find(key[at])
                out[at[i >= 0]] = store.values(i[i >= 0])
        return out


def _level(n, share, d, ctx, doc, sums):
    """Own part and weight of the rest of each (document, n-gram), less the document's shares.

    ``sums`` are the context's (total, followers by count) in each row, ``share``
    what is left out of ``n``, or None.
    """
    total, left = sums[:, 0].astype(np.float64), sums[:, 1:] @ d[1:]
    if share is not None:
        _, pair = np.unique(K.pair(ctx, doc.astype(np.uint64)), return_inverse=True)
        total = total - np.bincount(pair, share)[pair]
        left = left - np.bincount(pair, d[np.minimum(n, 3)] - d[np.minimum(n - share, 3)])[pair]
        n = n - share
    some = total > 0
    total = np.where(some, total, 1.0)
    return np.where(some, np.maximum(n - d[np.minimum(n, 3)], 0) / total, 0.0), np.where(some, np.clip(left / total, 0.0, 1.0), 1.0)


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _piece(m: Model, name, salt, h, size, at, leave_out: bool, counted: bool) -> np.ndarray:
    """log p of each word and end mark."""
    one = 1 if counted else 0
    info = m.info[name]
    d = [np.r_[0.0, x] for x in info["d"]]
    ids, w = _grams(m.words, h, at, salt, m.order)
    seen = np.zeros((len(ids), 5), np.int64)  # left extensions and sums as a context of each distinct word
    seen[ids >= 0] = m.words.values(m.uni, ids[ids >= 0], 5)
    ids = ids.astype(np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    row = np.arange(len(doc))  # position → row of the current order
    p, rest, share = np.zeros(len(doc)), np.ones(len(doc)), None
    if leave_out:
        key = w[-1].astype(np.uint64)
        for x in reversed(w[:-1]):
            key = K.pair(x.astype(np.uint64), key)
        first, row = _distinct(K.pair(key, doc.astype(np.uint64)))
        own = np.bincount(row, minlength=len(first))
        w, doc, share = [x[first] for x in w], doc[first], own
    for k in range(m.order, 1, -1):
        if k == 3:
            ctx = K.pair(ids[w[0]], ids[w[1]])
            b = _bucket(ctx, m.buckets)
            n = m.find("g3", b, K.pair(ctx, ids[w[2]]), 1, [one])[:, 0]
            sums = m.find("x3", b, ctx, 4, [one, one, 0, 0])
        else:
            ctx = w[-2].astype(np.uint64)
            key = K.pair(ids[w[-2]], ids[w[-1]])
            n = m.find("g2", _bucket(key, m.buckets), key, 1, [one])[:, 0]
            sums = seen[w[-2], 1:]
        own, weight = _level(n, share, d[k - 1], ctx, doc, sums)
        p, rest = p + rest * own[row], rest * weight[row]
        # the next order: distinct (document, shorter n-gram), of which those extensions go that only the document has
        if share is not None:
            gone = (n == share).astype(np.int64)
            w = w[1:] if k == 3 else [w[-1]]
            key = w[-1].astype(np.uint64)
            first, down = _distinct(K.pair(K.pair(w[0].astype(np.uint64), key) if len(w) == 2 else key, doc.astype(np.uint64)))
            share = np.bincount(down, gone, len(first)).astype(np.int64)
            w, doc, row = [x[first] for x in w], doc[first], down[row]
        else:
            w = w[1:]
    n = seen[w[0], 0]
    total, left, d1 = float(info["total"]), info["left"], d[0]
    if share is not None:
        total = total - np.bincount(doc, share)[doc]
        left = left - np.bincount(doc, d1[np.minimum(n, 3)] - d1[np.minimum(n - share, 3)])[doc]
        n = n - share
    some = np.asarray(total) > 0
    total = np.where(some, total, 1.0)
    own = np.where(some, np.maximum(n - d1[np.minimum(n, 3)], 0) / total, 0.0)
    weight = np.broadcast_to(np.where(some, np.clip(left / total, 1e-12, 1.0), 1.0), own.shape)
    return np.logaddexp(_log(p + rest * own[row]), _log(np.maximum(rest * weight[row], 1e-300)) - SPELLED * (size + 1.0))


def _score(folder: str, leave_out: bool, counted: bool):
    def run(batches):
        np.seterr(over="ignore")
        m = Model.at(folder)
        for batch in batches:
            total, n = np.zeros(batch.num_rows), pa.compute.binary_length(batch.column("text")).fill_null(-1).to_numpy().astype(np.int64) + 1
            for name, salt, rows, h, size, at in _texts(batch, _PIECE // 4 if leave_out else _PIECE):
                total[rows] = np.add.reduceat(_piece(m, name, salt, h, size, at, leave_out, counted), at[:-1])
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.array(n), pa.array(total)], names=["id", "grp", "n", "log_p"])
            yield out.filter(pa.array(n > 0))

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, leave_out: bool = False, order: int = 3, folder: str | None = None, counted: bool = True
) -> DataFrame:
    """(id, grp, n, log_p): bytes with the end mark, and the natural log probability under the model of the group.

    ``folder`` is a trained model; without it the documents' own is trained.
    ``counted`` says that the model has counted these documents; groups must be
    ones that it knows.
    """
    rows = _rows(docs, text_col, group_col, F.col(f"`{id_col}`").cast("long").alias("id"))
    folder = folder or train(docs, text_col, group_col, order)
    if folder is None:
        return rows.where("false").select("id", "grp", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("log_p"))
    return rows.mapInArrow(_score(folder, leave_out, counted), "id long, grp string, n long, log_p double")


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every document under the corpus' own model; tokens and perplexity count bytes, so that texts of other words compare."""
    got = score(docs, id_col, text_col, group_col)
    return got.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("log_p").alias("log_prob"), F.exp(-F.col("log_p") / F.col("n")).alias("perplexity")
    )
