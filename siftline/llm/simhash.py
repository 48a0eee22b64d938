"""SimHash near-duplicate search by a May-Ozerov recursion.

A document's fingerprint is the 128-bit SimHash of its distinct words and word
pairs. Fingerprints within ``distance`` bits are candidates. To find them
without comparing all pairs, each repetition draws a random order of the
coordinates and cuts it into strips. On the first strip, random centres filter
the fingerprints by partial weight: a list keeps those whose strip, XORed with
the centre, weighs at most ``weight`` bits. The lists are counted; one that is
longer than ``LONG`` is filtered again on the next strip by further centres, and
so on by their real sizes down to the depth of the plan, after which lists are
searched by brute force (a list that is still long in blocks, one task for each
pair of blocks). :func:`plan` picks weights, centres, depth and repetitions so that a
pair at the full distance meets in a final list with probability ``recall`` at
the greatest depth; closer pairs, and pairs in lists that end earlier, meet
more often.

Candidates link documents to components. A component is settled by the texts:
each document carries a sketch of its word set (the least hash of each of 256
bins), whose share of equal bins estimates the Jaccard similarity of two word
sets (standard error 0.03; exact up to shared bins for short texts). The least
document of a component stays, all that are at least ``near`` similar to it are
its copies, and the rest goes on in the same way, up to 256 staying documents a
round. So no document goes that isn't near the one that stays.

Cases: a null or empty text, or one without any word byte, has no fingerprint
unless it has other characters (then the whole text is its one feature); null
and empty texts are never near copies. Rows that agree in id and text are one
document. A null id is an id of its own, ordered last. Ties: the document with
the least (id, text hash) stays. Ids are cast to long, so an id that is no
number is an error. Further columns are ignored by the search and kept by
:func:`dedup`. An empty table has no copies.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import product
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import kernels as K
from siftline.llm.identity import KEY, TH, identified, keyed
from siftline.plans.components import connected_components
from siftline.plans.scratch import cut, drop

BITS, STRIP = 128, 32
DISTANCE = 24
RECALL = 0.98
#: Least similarity of word sets of a copy and the document that stays.
NEAR = 0.6
BINS = 256
#: Longer lists are filtered again, by centres of a plan's weight and number, or else these.
LONG, FINE = 1024, (9, 1024)
CLUSTERED = 5
#: Rows of a block of a final list, documents that may stay a round, and documents of a group a task.
BLOCK, STARS, GROUP = 8192, 256, 20_000


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sorted distinct (document, leading 44 bits of a hash)."""
    key = np.sort((doc.astype(np.uint64) << K.U(44)) | (h >> K.U(20)))
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def _fingerprints(batches):
    np.seterr(over="ignore")
    low = K.U((1 << 44) - 1)
    for batch in batches:
        buf, off = K.utf8(batch.column("text"))
        fp, sketch = np.zeros((len(off) - 1, 16), np.uint8), np.zeros((len(off) - 1, BINS), np.uint8)
        for i, j in K.runs(off):
            o = off[i : j + 1] - off[i]
            b = K.LOWER[buf[off[i] : off[j]]]
            s, e, first = K.tokens(b, o, K.WORD)
            h = K.token_hash(b, s, e)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            none = np.flatnonzero((np.diff(first) == 0) & (np.diff(o) > 0))
            for k in none:  # the whole text is the one feature
                one = b[o[k] : o[k + 1]]
                h, doc = np.r_[h, K.token_hash(one, np.array([0]), np.array([len(one)]))], np.r_[doc, k]
            two = np.flatnonzero(doc[1:] == doc[:-1])
            words, pairs = _distinct(doc, h), _distinct(doc[two], K.pair(h[two], h[two + 1]))
            # the least hash of each bin comes first
            bins = (words >> K.U(36)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]][: len(bins)])
            sketch[i + (bins[at] >> 8), bins[at] & 255] = (K.mix(words[at] & low) >> K.U(56)).astype(np.uint8) % 255 + 1
            both = np.concatenate([words, pairs])
            both = both[np.argsort(both >> K.U(44), kind="stable")]
            doc = (both >> K.U(44)).astype(np.int64)
            fp[i:j] = K.simhash128(K.mix(both & low), np.searchsorted(doc, np.arange(j - i + 1)))
        none = np.diff(off) == 0
        data = _binary(fp)
        if none.any():
            data = pa.compute.if_else(pa.array(~none), data, pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), data, _binary(sketch)], names=["id", "th", "fp", "sketch"])


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _bytes(col: pa.Array, width: int) -> np.ndarray:
    """The inverse of :func:`_binary`."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp BINARY(16), sketch BINARY(256)); fp is null for null and empty texts."""
    return identified(docs, id_col, text_col).mapInArrow(_fingerprints, "id long, th long, fp binary, sketch binary")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of word sets: sketches (n, 256) against (m, 256) → (n, m)."""
    out = np.empty((len(a), len(b)))
    for k, y in enumerate(b):
        some = (a | y) != 0
        out[:, k] = ((a == y) & some).sum(1) / np.maximum(some.sum(1), 1)
    return out


def _p_both(weight: int, apart: int) -> float:
    """Chance that a random centre keeps both of two strips that differ in ``apart`` bits."""
    return (
        sum(
            comb(apart, k) * comb(STRIP - apart, m)
            for k in range(apart + 1)
            for m in range(STRIP - apart + 1)
            if k + m <= weight and apart - k + m <= weight
        )
        / 2**STRIP
    )


@lru_cache(None)
def _each(weight: int, centres: int) -> list[float]:
    """Chance that some centre keeps both of two strips, by the bits they differ in."""
    return [1 - (1 - _p_both(weight, j)) ** centres for j in range(STRIP + 1)]


@lru_cache(None)
def _meets(weight: int, centres: int, depth: int, distance: int, fine: tuple[int, int] = FINE) -> float:
    """Chance that a pair at ``distance`` shares a final list of one repetition, at ``depth``."""
    each = [_each(weight, centres), _each(*fine)]

    @lru_cache(None)
    def walk(level: int, bits: int, apart: int) -> float:
        if level == depth:
            return 1.0
        return sum(
            comb(apart, j) * comb(bits - apart, STRIP - j) / comb(bits, STRIP) * each[min(level, 1)][j] * walk(level + 1, bits - STRIP, apart - j)
            for j in range(min(STRIP, apart) + 1)
            if STRIP - j <= bits - apart
        )

    return walk(0, BITS, distance)


def _kept(weight: int) -> float:
    """Share of random strips that a centre keeps."""
    return sum(comb(STRIP, k) for k in range(weight + 1)) / 2**STRIP


@lru_cache(None)
def plan(n: int, distance: int = DISTANCE, recall: float = RECALL) -> dict:
    """Cheapest filters that reach ``recall`` over ``n`` fingerprints.

    ``weight`` and ``centres`` of the first level, ``fine`` those of the deeper
    ones, ``repeats``, and ``depth``, the greatest depth of a list: 2 or more, so
    that a list that real fingerprints make long can be refined. ``CLUSTERED``
    is how many times longer than random ones' their lists are taken to be.
    """
    best = None
    for depth in (2, 3, 4):
        for weight, centres, fine in product(range(6, 14), (16, 64, 256), product(range(8, 14), (16, 64))):
            meets = _meets(weight, centres, depth, distance, fine)
            if meets < 1e-5:
                continue
            repeats = max(1, ceil(log(1 - recall) / log(max(1e-12, 1 - meets))))
            if repeats >= 4096:
                continue
            copies, share, walked = float(repeats), 1.0, repeats * 5e-8
            for w, c in [(weight, centres)] + [fine] * (depth - 1):
                walked += copies * c * 4e-9
                copies, share = copies * c * _kept(w), share * _kept(w)
            cost = 3 * walked + copies * 3e-6 + copies * n * share * CLUSTERED * 2e-9
            if best is None or cost < best["cost"]:
                best = {"cost": cost, "depth": depth, "weight": weight, "centres": centres, "fine": fine, "repeats": repeats, "copies": copies}
    return best


def _strips(order: np.ndarray, depth: int) -> np.ndarray:
    """(pairs of strips, 16, 256): what each byte of a fingerprint adds to each two strips of an order of the coordinates."""
    out = np.zeros(((depth + 1) // 2, 16, 256), np.uint64)
    value = np.arange(256, dtype=np.uint64)
    for place, bit in enumerate(order[: STRIP * depth].tolist()):
        at, shift = divmod(place, 2 * STRIP)
        out[at, bit // 8] |= ((value >> K.U(7 - bit % 8)) & K.U(1)) << K.U(shift)
    return out


def _walk(how: dict, seed: int, long: list[np.ndarray]):
    """Fingerprints → (lists, rows) that keep them at each level, descending below the ``long`` lists of each.

    A list's name has a digit for each level: repetition, then centre + 1.
    """
    rng = np.random.default_rng(seed)
    shape = [(how["weight"], how["centres"])] + [how.get("fine", FINE)] * (how["depth"] - 1)
    base = max(c for _, c in shape) + 1
    order = [rng.permutation(BITS) for _ in range(how["repeats"])]
    centre = [[rng.integers(0, 2**32, c, dtype=np.uint32) for _, c in shape] for _ in order]
    table = [_strips(o, how["depth"]) for o in order]

    def lists(fp: np.ndarray):
        """(lists, rows, whether long) of each level down to that below the last ``long``."""
        columns = np.ascontiguousarray(fp.T).astype(np.intp)
        found = [([], [], []) for _ in range(len(long) + 1)]
        for rep, (t, c) in enumerate(zip(table, centre)):
            key, row = np.full(len(fp), rep + 1, np.int64), np.arange(len(fp))
            two = []
            for lv in range(len(long) + 1):
                if lv % 2 == 0:
                    both = t[lv // 2][0][columns[0]]
                    for k in range(1, 16):
                        both |= t[lv // 2][k][columns[k]]
                    two = both.view(np.uint32).reshape(-1, 2)
                strips = two[:, lv % 2] if not lv else two[row, lv % 2]
                i, j = np.nonzero(np.bitwise_count(strips[:, None] ^ c[lv][None, :]) <= shape[lv][0])
                key, row = key[i] * base + j + 1, row[i]
                go = np.zeros(len(key), bool)
                if lv < len(long) and len(long[lv]):
                    at = np.searchsorted(long[lv], key)
                    at[at == len(long[lv])] = 0
                    go = long[lv][at] == key
                for x, y in zip(found[lv], (key, row, go)):
                    x.append(y)
                key, row = key[go], row[go]
                if not len(key):
                    break
        return [tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in level) for level in found]

    return lists


def _counts(how: dict, seed: int, long: list[np.ndarray]):
    """Arrow batches of fingerprints → (list, n) of the deepest level, a row a list and task."""

    def run(batches):
        walk, held, n = _walk(how, seed, long), [], []
        for batch in batches:
            fp = _bytes(batch.column("fp"), 16)
            for at in range(0, len(fp), 4096):
                k, c = np.unique(walk(fp[at : at + 4096])[-1][0], return_counts=True)
                held.append(k)
                n.append(c)
            if held and sum(map(len, held)) > 1 << 20:
                k, back = np.unique(np.concatenate(held), return_inverse=True)
                held, n = [k], [np.bincount(back, np.concatenate(n)).astype(np.int64)]
        if held:
            k, back = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(back, np.concatenate(n)).astype(np.int64)
            for at in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 17)]), pa.array(n[at : at + (1 << 17)])], names=["list", "n"])

    return run


def _lists(how: dict, seed: int, long: list[np.ndarray], blocks: dict[int, int]):
    """Arrow batches of fingerprints → (list, part, side, fp) for each final list that keeps them.

    A list of several blocks has a part for each pair of them; a fingerprint of
    one block (side 0) meets those of the other (side 1) there.
    """

    def run(batches):
        walk = _walk(how, seed, long)
        wide = np.array(sorted(blocks), np.int64)
        for batch in batches:
            fp = _bytes(batch.column("fp"), 16)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                for keys, rows, go in walk(part):
                    end = ~go.astype(bool)
                    keys, rows = keys[end], rows[end]
                    pair, side = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int8)
                    if len(wide) and len(keys):
                        i = np.searchsorted(wide, keys)
                        i[i == len(wide)] = 0
                        hit = np.flatnonzero(wide[i] == keys)
                        more = [(np.delete(keys, hit), np.delete(rows, hit), np.delete(pair, hit), np.delete(side, hit))]
                        for k in np.unique(keys[hit]):
                            r, m = rows[hit][keys[hit] == k], blocks[int(k)]
                            own = (part[r].view(np.uint64)[:, 0] % np.uint64(m)).astype(np.int64)
                            for other in range(m):
                                lo, hi = np.minimum(own, other), np.maximum(own, other)
                                more.append((np.full(len(r), k), r, lo * m + hi, (own > other).astype(np.int8)))
                        keys, rows, pair, side = (np.concatenate(x) for x in zip(*more))
                    for k in range(0, len(keys), 1 << 17):
                        sl = slice(k, k + (1 << 17))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[sl]), pa.array(pair[sl]), pa.array(side[sl]), _binary(part[rows[sl]])], names=["list", "part", "side", "fp"])

    return run


def close_pairs(fp: np.ndarray, distance: int, block: int = 512):
    """(i, j, bits apart) for all pairs i < j within ``distance`` of an (n, 16) byte array."""
    w = np.ascontiguousarray(fp).view(np.uint64)
    for a in range(0, len(w), block):
        x = w[a : a + block]
        for b in range(a, len(w), block):
            y = w[b : b + block]
            d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint8)
            d += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
            i, j = np.nonzero(d <= distance)
            keep = i + a < j + b
            yield i[keep] + a, j[keep] + b, d[i[keep], j[keep]]


def _forest(fp: np.ndarray, distance: int) -> np.ndarray:
    """Each row's root: the least row of its component."""
    label = np.arange(len(fp))
    for i, j, _ in close_pairs(fp, distance):
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _search(distance: int, pairs: bool):
    """Arrow batches sorted by list and part → edges; a part that spans batches is gathered, which its size bounds."""

    def solve(fp: np.ndarray):
        if pairs:
            for i, j, d in close_pairs(fp, distance):
                yield fp[i], fp[j], d
        else:
            root = _forest(fp, distance)
            i = np.flatnonzero(root != np.arange(len(fp)))
            yield fp[i], fp[root[i]], np.zeros(len(i), np.uint8)

    def flush(found):
        a, b, d = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([_binary(a), _binary(b), pa.array(d.astype(np.int32))], names=["a", "b", "bits"])

    def run(batches):
        now, held, found, n = None, [], [], 0
        for batch in batches:
            key, part = batch.column("list").to_numpy(), batch.column("part").to_numpy()
            fp = _bytes(batch.column("fp"), 16)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if now != (key[s], part[s]):
                    if sum(map(len, held)) > 1:
                        for x in solve(np.concatenate(held)):
                            found.append(x)
                            n += len(x[0])
                    now, held = (key[s], part[s]), []
                held.append(fp[s:e])
                if n > 50_000:
                    yield flush(found)
                    found, n = [], 0
        if sum(map(len, held)) > 1:
            found += solve(np.concatenate(held))
        if found:
            yield flush(found)

    return run


def _spread(fps: DataFrame) -> DataFrame:
    """``fp`` over as many tasks as the session shuffles into."""
    return fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def refined(fps: DataFrame, how: dict, seed: int, longest: int = LONG) -> tuple[list[np.ndarray], dict[int, int]]:
    """(long lists of each level that are filtered again, blocks of final lists that stay long).

    Lists are counted level by level. At most a million lists a level are long,
    as ``longest`` rises with the rows, so what the driver holds is bounded.
    """
    long: list[np.ndarray] = []
    rows = _spread(fps)
    limit, deep = longest, how["depth"]
    while True:
        n = rows.mapInArrow(_counts(how, seed, long), "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
        n = cut(n, "lists")
        limit = max(limit, int(n.agg(F.sum("n")).first()[0] or 0) // 1_000_000)
        last = len(long) == deep - 1
        most = n.where(F.col("n") > (max(BLOCK, limit) if last else limit)).collect()
        drop(n)
        if last:
            return long, {r.list: -(-r.n // BLOCK) for r in most}
        if not most:
            return long, {}
        long.append(np.sort(np.array([r.list for r in most], np.int64)))


def candidate_edges(
    fps: DataFrame, distance: int = DISTANCE, recall: float = RECALL, seed: int = 11, pairs: bool = False, n: int | None = None, longest: int = LONG
) -> DataFrame:
    """Distinct ``fp`` → (a, b, bits). ``pairs``: all pairs found; else a forest of each list's components."""
    n = fps.count() if n is None else n
    how = plan(max(2, n), distance, recall)
    long, blocks = refined(fps, how, seed, longest)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n * how["copies"] // 2_000_000))
    return (
        _spread(fps).mapInArrow(_lists(how, seed, long, blocks), "list long, part long, side byte, fp binary")
        .repartition(parts, "list", "part")
        .sortWithinPartitions("list", "part")
        .drop("side")
        .mapInArrow(_search(distance, pairs), "a binary, b binary, bits int")
        .distinct()
    )


_MEMBER = "root binary, no_id boolean, id long, th long, sketch binary"
_SETTLED = _MEMBER + ", keep_id long, keep_th long, done boolean"


def _settle(near: float):
    """Some documents of a component, and the least ones that are left of it → each document and the first of those it is near, if any."""

    def run(members: pa.Table, block: pa.Table) -> pa.Table:
        members = members.drop_columns("salt").combine_chunks()
        block = block.rename_columns([c.removeprefix("b_") for c in block.column_names]).combine_chunks()
        if not len(members) or not len(block):
            return pa.table({n: pa.array([], t) for n, t in (("root", pa.binary()), ("no_id", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("sketch", pa.binary()), ("keep_id", pa.int64()), ("keep_th", pa.int64()), ("done", pa.bool_()))})
        block = block.sort_by([("no_id", "ascending"), ("id", "ascending"), ("th", "ascending")])
        x = _bytes(block.column("sketch"), BINS)
        close, stays = similarity(x, x) >= near, []
        for k in range(len(x)):
            if not close[k, stays].any():
                stays.append(k)
        own = _bytes(members.column("sketch"), BINS)
        where = np.full(len(own), -1)
        for at in range(0, len(own), 4096):
            hit = similarity(own[at : at + 4096], x[stays]) >= near
            where[at : at + 4096] = np.where(hit.any(1), np.array(stays)[hit.argmax(1)], -1)
        pick = pa.array(np.maximum(where, 0))
        done = pa.array(where >= 0)
        return members.append_column("keep_id", block.column("id").take(pick)).append_column("keep_th", block.column("th").take(pick)).append_column("done", done)

    return run


def settled(members: DataFrame, near: float = NEAR) -> DataFrame:
    """(root, no_id, id, th, sketch) of components → (id, th, keep_id, keep_th): who stays for each document.

    A round takes the ``STARS`` least documents left of each component; those
    that no earlier one of them is near stay, and every document near one that
    stays is settled. Large components are split over tasks by text hash, each
    with that block, so a task holds at most about ``GROUP`` documents.
    """
    out, left = [], cut(members, "members")
    order = Window.partitionBy("root").orderBy("no_id", "id", "th")
    columns = [c.split()[0] for c in _MEMBER.split(", ")]
    while not left.isEmpty():
        big = left.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("root", F.ceil(F.col("n") / GROUP).alias("salts"))
        big = F.broadcast(cut(big, "big"))  # at most a row for every GROUP documents
        salts = F.coalesce("salts", F.lit(1))
        rows = left.join(big, "root", "left").withColumn("salt", F.pmod("th", salts)).drop("salts")
        block = left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= STARS).drop("k").join(big, "root", "left")
        block = block.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
        pick = [*columns, "salt"]
        got = rows.select(pick).groupBy("root", "salt").cogroup(block.select([F.col(c).alias("b_" + c) for c in pick]).groupBy("b_root", "b_salt"))
        got = cut(got.applyInArrow(_settle(near), _SETTLED), "settled")
        drop(left)
        out.append(got.where("done").select("id", "th", "keep_id", "keep_th"))
        left = cut(got.where("not done").select(columns), "members")
    return reduce(DataFrame.unionByName, out) if out else left.select("id", "th", F.col("id").alias("keep_id"), F.col("th").alias("keep_th"))


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL, seed: int = 11, near: float = NEAR
) -> DataFrame:
    """(id, th, keep_id, keep_th) of every document that has candidates; those that stay keep themselves."""
    fps = cut(fingerprints(docs, id_col, text_col).where("fp is not null"), "fingerprints")
    one = cut(fps.groupBy("fp").agg(F.count_distinct("id", "th").alias("n"), F.count_if(F.col("id").isNull()).alias("m")).repartition("fp"), "distinct")
    edges = candidate_edges(one.select("fp"), distance, recall, seed)
    root = cut(connected_components(edges.select("a", "b")), "roots")
    alone = one.where("n + m > 1").join(root.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root"))
    root = root.select(F.col("node").alias("fp"), "root").unionByName(alone)
    members = fps.join(root, "fp").select("root", F.col("id").isNull().alias("no_id"), "id", "th", "sketch").dropDuplicates(["root", "no_id", "id", "th"])
    return settled(members, near)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, duplicate_of): each near copy and the document of its group that stays."""
    return (
        groups(docs, **how)
        .where("not (id <=> keep_id and th = keep_th)")
        .select(F.col("id").alias("doc_id"), F.col("keep_id").alias("duplicate_of"))
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group; rows repeated in full are one."""
    gone = groups(docs, id_col, text_col, **how).where("not (id <=> keep_id and th = keep_th)")
    gone = gone.select(F.coalesce("id", F.lit(0)).alias(KEY), F.col("th").alias(TH))
    return keyed(docs, id_col, text_col).join(gone, [KEY, TH], "left_anti").dropDuplicates([KEY, TH]).drop(KEY, TH)
