"""Exact word-shingle Jaccard join by signature trees.

Candidates: two sets that link differ in at most D shingles, D known from their sizes,
so of any D + 1 ranges of the shingle hash at least one holds equal contents in both. The
content hash of a range is a bucket key; only sets that meet under a key are compared.
Ranges that are empty say nothing, and large sets have some in common by chance. There are
somewhat more than D + 1 ranges, and a set in which more than D hold something has the
keys of the first D + 1 of those only. Of two such sets, take the one whose keys end
first: one of its ranges is equal in the other, which has all that are filled up to there.
If both sets have too few, both have the keys of all ranges, the empty ones too.
Verification: inside a group of sets two signature trees are traversed together. A node
holds the OR of its sets' shingle bitmaps, their size range and the largest number of
shingles that share bits; a pair of nodes is left as soon as the largest overlap they
allow is below what the smallest sizes need. Leaves count the exact overlap.

Sets that are equal collapse first. Links inside what is already one component are not
looked for again: first every set meets the smallest set of its buckets, then the rest
of each bucket that still holds more than one component is traversed in full, in chunk
pairs, so that no task holds an unbounded bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, keyed, marked, pieces, release, settle, unzipped, zipped
from .graph import components

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64
_PIECE = 1 << 18
#: Size classes end at about 1.5 times the one before.
_RATIO = (3, 2)
#: Bits of the bitmap that stands for a set until its shingles are needed.
BITS = 2048
#: A chunk holds at most about this many sets and shingles.
CHUNK_SETS, CHUNK_SHINGLES = 64, 1 << 16
#: Sets of a tree; a bucket of more is split, and all pairs of its trees are traversed.
TREE_SETS = 512


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + _U(salt * 0x632BE59BD9B4E019 % _WORD)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``base``; those of the usual piece are kept."""
    if base not in _KEPT or len(_KEPT[base]) < n:
        size = max(n, 2 * _PIECE)
        made = np.full(size, base, _U)
        made[0] = 1
        made = np.cumprod(made, dtype=_U)
        if size > 4 * _PIECE:
            return made[:n]
        _KEPT[base] = made
    return _KEPT[base][:n]


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at the bytes ``apart``, ASCII white space)
    of the rows in ``data``, and the position of each row's first word."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    body = _LOWER[data]
    inside = ~apart[body]
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    cuts = offsets[offsets < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    powers = _powers(_BASE, len(data))
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum((body.astype(_U) + _U(1)) * powers, out=prefix[1:])
    inverse = _powers(pow(_BASE, -1, _WORD), len(data))
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(_U) << _U(48)), 1), np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct ``k``-word shingle hashes per row; a row of fewer words has its
    whole sequence as one shingle, a row without words none."""
    w, at = words_of(data, offsets)
    runs = {}
    for m in range(1, k + 1):
        if len(w) < m:
            break
        h = np.full(len(w) - m + 1, m, _U)
        for j in range(m):
            h = mix(h * _U(_BASE) + w[j : len(w) - m + 1 + j], 2)
        runs[m] = h
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        n = hi - lo
        if n == 0:
            yield np.zeros(0, _U)
        elif n < k:
            yield runs[n][lo : lo + 1]
        else:
            yield np.unique(runs[k][lo : hi - k + 1])


def class_of(n: int) -> tuple[int, int]:
    """(index, largest size) of the size class that holds ``n``."""
    c, top = 0, 1
    while top < n:
        top = max(top + 1, top * _RATIO[0] // _RATIO[1])
        c += 1
    return c, top


def parts_of(top: int, p: int, q: int) -> tuple[int, int]:
    """(ranges, D) of the size class that ends at ``top``: so many ranges that its largest
    sets have about 10 % more than D filled; smaller ones need fewer."""
    most = (q - p) * 2 * top // (q + p)
    wanted = 1.1 * (most + 1)
    return math.ceil(wanted / (1 - math.exp(-top / wanted))) if most else 1, most


def range_keys(u: np.ndarray, p: int, q: int) -> np.ndarray:
    """Bucket keys of a set for similarity p/q: of its own size class and, if the
    largest partner lies in a later one, of those too."""
    n, out = len(u), []
    if not n:
        return np.zeros(0, _U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix(u, 3), out=sums[1:])
    most = n * q // p
    c, top = class_of(n)
    while True:
        parts, _ = parts_of(top, p, q)
        # Shingles in which it and its largest partner of the class may differ.
        apart = (q - p) * (n + min(most, top)) // (q + p)
        edges = (np.arange(1, parts, dtype=object) * _WORD // parts).astype(_U) if parts > 1 else np.zeros(0, _U)
        cut = np.concatenate(([0], np.searchsorted(u, edges, "left"), [n]))
        at = np.flatnonzero(cut[1:] > cut[:-1])
        at = at[: apart + 1] if len(at) > apart else np.arange(parts)
        out.append(mix(sums[cut[at + 1]] - sums[cut[at]] + mix(at.astype(_U), 4 + c), 5))
        if top >= most:
            return np.concatenate(out)
        c, top = c + 1, max(top + 1, top * _RATIO[0] // _RATIO[1])


def bitmap(u: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, _U)
    at = (u & _U(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, _U(1) << (at & 63).astype(_U))
    return out


def _emit_keys(k: int, p: int, q: int):
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])
    signed = lambda x: np.array(x, _U).view(np.int64)

    def run(batches):
        for b in batches:
            data, offsets = blobs(b.column("text"))
            for i, j in pieces(offsets, _PIECE):
                lo, hi = int(offsets[i]), int(offsets[j])
                n, k1, k2, bits, keys = [], [], [], [], []
                for u in shingle_sets(data[lo:hi], offsets[i : j + 1] - lo, k):
                    n.append(len(u))
                    k1.append(mix(u, 6).sum(dtype=_U))
                    k2.append(mix(u, 7).sum(dtype=_U))
                    bits.append(bitmap(u, BITS).tobytes())
                    keys.append(signed(range_keys(u, p, q)))
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                yield pa.record_batch(
                    [b.column("doc").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n, pa.int32()), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    schema=schema,
                )

    return run


def _emit_sets(k: int):
    def run(batches):
        for b in batches:
            for i, j, data, offsets in unzipped(b.column("z")):
                sets = [u.tobytes() for u in shingle_sets(data, offsets, k)]
                yield pa.record_batch([b.column("sid").slice(i, j - i), pa.array(sets, pa.binary())], names=["sid", "body"])

    return run


class Tree:
    """Signature tree over sets: leaves of up to ``FAN`` sets, inner nodes of up to
    ``FAN`` nodes, each with its OR bitmap, size range and slack (size minus set bits)."""

    FAN = 8

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        # Similar sets share their first bits, and stand side by side.
        self.order = np.lexsort((sizes, maps[:, 1], maps[:, 0])) if len(maps) > 1 else np.zeros(len(maps), np.int64)
        maps, size = maps[self.order], sizes[self.order]
        slack = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), self.FAN)
            low, high = np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            self.levels.append((maps, low, high, np.maximum.reduceat(self.levels[-1][3], cut)))

    def below(self, level: int, at: int) -> np.ndarray:
        return np.arange(at * self.FAN, min((at + 1) * self.FAN, len(self.levels[level - 1][1])))


def traverse(x: Tree, y: Tree, p: int, q: int):
    """Pairs (i, j) of positions in the two sets' lists whose overlap may suffice."""
    stack = [(len(x.levels) - 1, np.array([0]), len(y.levels) - 1, np.array([0]))]
    while stack:
        lx, ax, ly, ay = stack.pop()
        (mx, sx, bx, fx), (my, sy, by, fy) = x.levels[lx], y.levels[ly]
        common = np.bitwise_count(mx[ax][:, None, :] & my[ay][None, :, :]).sum(axis=2, dtype=np.int64)
        # Overlap of any two sets below: shared bits, plus shingles that share a bit with others.
        most = np.minimum(np.minimum(common + fx[ax][:, None], common + fy[ay][None, :]), np.minimum(bx[ax][:, None], by[ay][None, :]))
        least = (sx[ax][:, None] + sy[ay][None, :]) * p
        ok = (most * (p + q) >= least) & (bx[ax][:, None] * q >= sy[ay][None, :] * p) & (by[ay][None, :] * q >= sx[ax][:, None] * p)
        for i, j in zip(*np.nonzero(ok)):
            i, j = int(ax[i]), int(ay[j])
            if lx == 0 and ly == 0:
                yield int(x.order[i]), int(y.order[j])
            else:
                kx = (lx - 1, x.below(lx, i)) if lx else (0, np.array([i]))
                ky = (ly - 1, y.below(ly, j)) if ly else (0, np.array([j]))
                stack.append((*kx, *ky))


def _pairs(p: int, q: int):
    """Pairs of one group that the trees leave: of sets on side 0 and on side 1, or among
    all where only one side is there, in different components."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sid, comp, n = (table.column(c).to_numpy() for c in ("sid", "comp", "n"))
        maps = np.frombuffer(b"".join(table.column("bits").to_pylist()), _U).reshape(len(sid), -1)
        rows = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(rows[1]):
            rows[1] = rows[0]
        trees = [Tree(maps[r], n[r].astype(np.int64)) for r in rows] if len(rows[0]) else []
        found = set()
        for i, j in traverse(*trees, p, q) if trees else ():
            i, j = rows[0][i], rows[1][j]
            if comp[i] != comp[j]:
                x, y = int(sid[i]), int(sid[j])
                found.add((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _may_link(p: int, q: int):
    """Pairs whose bitmaps and sizes allow a link."""

    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            ma, mb = (np.frombuffer(b"".join(b.column(c).to_pylist()), _U).reshape(len(na), -1) for c in ("ba", "bb"))
            ones = lambda m: np.bitwise_count(m).sum(axis=1, dtype=np.int64)
            common = ones(ma & mb)
            most = np.minimum(np.minimum(na - ones(ma), nb - ones(mb)) + common, np.minimum(na, nb))
            ok = most * (p + q) >= (na + nb) * p
            yield b.select(["a", "b", "na"]).filter(pa.array(ok))

    return run


def _linked(p: int, q: int):
    """Links between the one set of side 0 and those of side 1."""

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        sid, side = table.column("sid").to_pylist(), table.column("side").to_pylist()
        at = side.index(0) if 0 in side else -1
        found = []
        if at >= 0:
            v = np.frombuffer(bodies[at], _U)
            for x, s, body in zip(sid, side, bodies):
                if s == 1 and len(v) and len(body):
                    u = np.frombuffer(body, _U)
                    where = np.searchsorted(v, u)
                    where[where == len(v)] = 0
                    both = int((v[where] == u).sum())
                    if both * q >= (len(u) + len(v) - both) * p:
                        found.append(x)
        return pa.table({"a": pa.array([sid[at]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def _chunks(count, shingles):
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(count) / CHUNK_SETS, F.col(shingles) / CHUNK_SHINGLES))).cast("int")


def _with_comp(rows: DataFrame, comp: DataFrame, sid: str, name: str) -> DataFrame:
    right = comp.select(F.col("node").alias(sid), F.col("root").alias(name))
    return rows.join(right, sid, "left").withColumn(name, F.coalesce(name, sid))


class _Join:
    """The written tables that the rounds of one join share."""

    def __init__(self, base: DataFrame, rows: DataFrame, k: int, p: int, q: int):
        self.k, self.p, self.q = k, p, q
        self.base = base
        # One row for each different set; equal sets have equal fields.
        self.nodes = settle(rows.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min(F.struct("doc", "th")).alias("head")))
        self.edges: DataFrame | None = None
        self.comp: DataFrame | None = None

    def look(self, pairs: DataFrame) -> None:
        """Add the links among distinct pairs ``a``, ``b``, and the components they make."""
        at = lambda c: self.nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
        sized = pairs.join(at("a"), "a").join(at("b"), "b").where(F.least("na", "nb") * self.q >= F.greatest("na", "nb") * self.p)
        left = settle(sized.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_may_link(self.p, self.q), "a long, b long, na int"))
        sets = self._sets(left)
        # Chunks of the partners of each b.
        per = settle(left.groupBy("b").agg(F.count(F.lit(1)).alias("sets"), F.sum("na").alias("shingles")))
        chunk = F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")
        placed = left.join(per.select("b", _chunks("sets", "shingles").alias("chunks")), "b").select("b", chunk.alias("c"), "a")
        placed = settle(placed)
        members = placed.select("b", "c", F.col("a").alias("sid"), F.lit(1).alias("side")).union(
            placed.select("b", "c").distinct().select("b", "c", F.col("b").alias("sid"), F.lit(0).alias("side"))
        )
        new = settle(members.join(sets, "sid").groupBy("b", "c").applyInArrow(_linked(self.p, self.q), "a long, b long"))
        release(sets)
        self.edges = new if self.edges is None else self.edges.union(new)
        self.comp = settle(components(self.edges))

    def _sets(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        where = settle(self.nodes.join(need, "sid").select("sid", F.col("head.doc").alias("d2"), F.col("head.th").alias("t2")))
        # Texts that no pair needs are not shuffled.
        once = zipped(self.base, marked(where, "t2")).join(where, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
        return settle(once.select("sid", "z").mapInArrow(_emit_sets(self.k), "sid long, body binary").dropDuplicates(["sid"]))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        return _with_comp(_with_comp(pairs, self.comp, "a", "ca"), self.comp, "b", "cb").where("ca != cb").select("a", "b")


def jaccard_classes(
    docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``th``, ``n_shingles``, ``first`` (of its
    component, by id and text), ``component_id`` (the smallest id reachable over links of Jaccard similarity >= p/q between sets of
    ``k``-word shingles).

    A null or empty text and one of white space only have an empty set, link with
    nothing and are their own component. Rows that repeat, or whose sets are equal, are
    one component. Null ids take part; a component of null ids only has a null id."""
    base = keyed(docs, text, key)
    made = base.mapInArrow(_emit_keys(k, p, q), "doc long, th long, n int, k1 long, k2 long, bits binary, keys array<long>")
    rows = settle(made)
    # Equal sets share an id. Should two sets ever collide, another salt is taken.
    salt = 0
    while True:
        sid = F.xxhash64(F.lit(salt), "n", "k1", "k2")
        what = F.struct("n", "k1", "k2")
        if rows.groupBy(sid.alias("sid")).agg(F.min(what).alias("x"), F.max(what).alias("y")).where("x != y").isEmpty():
            break
        salt += 1
    wide, rows = rows, rows.withColumn("sid", sid)
    join = _Join(base, rows, k, p, q)

    # Buckets of at least two sets, each with its smallest set. The keys are by far the most
    # rows of the join: they are shuffled once, for both sides.
    keyed_sets = rows.where("n > 0").select("sid", F.explode("keys").alias("key")).repartition("key")
    heads = keyed_sets.groupBy("key").agg(F.min("sid").alias("head"), F.max("sid").alias("last")).where("head != last").select("key", "head")
    met = settle(keyed_sets.join(heads.hint("merge"), "key").where("sid != head").distinct())
    rows = settle(rows.select("doc", "th", "n", "sid"))
    release(wide)

    # Every set with the smallest head it meets, then with its other heads.
    join.look(met.groupBy(F.col("sid").alias("a")).agg(F.min("head").alias("b")))
    join.look(join.apart(met.select(F.col("sid").alias("a"), F.col("head").alias("b")).distinct()))

    # Buckets whose other sets still are in several components: trees over all chunk pairs.
    at = _with_comp(met, join.comp, "sid", "comp").select("key", "sid", "comp")
    per = at.groupBy("key").agg(
        F.count(F.lit(1)).alias("sets"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s1"), F.min("sid").alias("s0"), F.max("sid").alias("s2"),
    ).where("c0 != c1")
    # Buckets of the same sets are looked at once.
    once = settle(per.groupBy("sets", "s0", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("sets") / TREE_SETS).cast("int").alias("chunks")))
    placed = at.join(once, "key").withColumn("c", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    seen = placed.join(join.nodes.select("sid", "n", "bits"), "sid").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("c") <= F.col("o"), 0).otherwise(1)
    members = seen.select("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "sid", "comp", "n", "bits", side.alias("side"))
    join.look(settle(members.groupBy("key", "lo", "hi").applyInArrow(_pairs(p, q), "a long, b long").distinct()))

    named = settle(_with_comp(rows.select("doc", "th", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")), join.comp, "sid", "root"))
    place = F.struct(F.col("doc").isNull().alias("late"), "doc", "th")
    least = settle(named.where("root is not null").groupBy("root").agg(F.min(place).alias("head")))
    release(met)
    alone = F.col("root").isNull()
    return named.join(least, "root", "left").select(
        F.col("doc").alias("doc_id"), "th", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("head.doc")).alias("component_id"),
        (alone | (F.col("head") == place)).alias("first"),
    )


def first_of_classes(docs: DataFrame, classes: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each class: its first, by id (null last) and text. Rows
    with an empty set all stay."""
    keep = settle(classes.where("first").groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.max("n_shingles").alias("__s")))
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = docs.join(keep, F.col(key).cast("long").eqNullSafe(F.col("__d")) & (own == F.col("__t")))
    if not keep.where("__n > 1 and __s > 0").isEmpty():
        # Rows that repeat id and text are one class; one of them stays.
        many = (F.col("__n") > 1) & (F.col("__s") > 0)
        out = out.where(~many).unionByName(out.where(many).dropDuplicates(["__d", "__t"]))
    return out.select(*docs.columns)
