"""Suffix-array dedup: depth-limited radix sort of suffixes, most significant digit first.

A suffix is ordered through its first ``width`` bytes only, and groups that are equal
there are exactly the repeated windows. Three passes, each over what the pass before
left undecided:

1. Digit one is the ``gram``-byte string at the window's *anchor*, the smallest gram
   hash inside the window. Equal windows have equal anchors at equal places, so a group
   of one is decided (no repeat). Neighbouring suffixes share their anchor; a row is a
   *run* of such suffixes, about ``(width - gram) / 2`` of them, not a single one.
2. Digit two is the whole run. Runs with an equal run repeat in full.
3. Digit three is what all windows of a *block* of eight share, and after it the whole
   block, for runs that differ from the others of their anchor group (and for one run
   of each set of equal ones).
4. The last digit is a single window at full depth, for blocks that agree in the shared
   part and differ beyond it: a few at the edges of a repeated passage.

The steps of a pass are the same for runs, blocks and windows (:func:`_refine`). Rows are kept whole whatever a group's size: groups are counted with partial
aggregation and joined back from written tables, where a hot group can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, keyed, pieces, release, settle, slices, unzipped, zipped

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_PLACE = np.uint64((1 << 22) - 1)
_PIECE = 1 << 18
_WORD = 1 << 64


def _rolled(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram``-byte string by doubling (``gram`` a power of two)."""
    h, m = data.astype(np.uint64) + np.uint64(1), 1
    while m < gram:
        h = h[:-m] * np.uint64(pow(_BASE, m, _WORD)) + h[m:]
        m *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    return h


def _lowest(packed: np.ndarray, span: int) -> np.ndarray:
    m, step = packed, 1
    while step * 2 <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (span - step)], m[span - step :]) if step < span else m


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Runs of windows that share an anchor: first window, last window, gram hash, anchor."""
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty, empty.astype(np.uint64), empty
    h = _rolled(data, gram)
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least = _lowest(packed, width - gram + 1)
    long = ends - starts >= width
    mark = np.zeros(len(least) + 1, np.int8)
    mark[starts[long]] += 1
    mark[ends[long] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    if not len(at):
        return empty, empty, empty.astype(np.uint64), empty
    p = (least[at] & _PLACE).astype(np.int64)
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(at) - 1]))
    return at[first], at[last], h[p[first]], p[first]


#: A set of ``n`` neighbouring windows of a document from byte ``a``; ``g`` is its digit so
#: far, ``r`` a digest of all it covers, ``p`` how far behind ``a`` its anchor stands.
_ROW = "g long, r long, doc long, th long, a int, n short, p short"
_FIELDS = ("g", "r", "doc", "th", "a", "n", "p")
_SCHEMA = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("n", pa.int16()), ("p", pa.int16())])
#: Windows in a block.
BLOCK = 8


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _digest(body, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(body, seed=seed % _WORD)


def _emit_runs(width: int, gram: int):
    def chunks(offsets):
        """Byte ranges to look at: groups of rows, or overlapping parts of a long row."""
        for i, j in pieces(offsets, _PIECE):
            lo, hi = int(offsets[i]), int(offsets[j])
            if j - i > 1 or hi - lo <= 2 * _PIECE:
                yield i, lo, hi, offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo
            else:
                for c in range(lo, hi - width + 1, _PIECE):
                    end = min(hi, c + _PIECE + width - 1)
                    yield i, c, end, np.zeros(1, np.int64), np.array([end - c])

    def run(batches):
        for b in batches:
            data, offsets = blobs(b.column("text"))
            doc, th = b.column("doc"), b.column("th")
            for i, lo, hi, starts, ends in chunks(offsets):
                first, last, g, p = runs_of(data[lo:hi], starts, ends, width, gram)
                if not len(first):
                    continue
                view = memoryview(data[lo:hi])
                stops = (last + width).tolist()
                r = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), stops)]
                row = np.searchsorted(starts, first, "right") - 1 + i
                rows = pa.array(row)
                ints = (first + lo - offsets[row]).astype(np.int32), (last - first + 1).astype(np.int16), (p - first).astype(np.int16)
                yield pa.record_batch([_signed(g), _signed(r), doc.take(rows), th.take(rows), *map(pa.array, ints)], schema=_SCHEMA)

    return run


def _split(width: int, parts):
    """Rows of a finer pass. ``parts(x)`` yields, for one of a document's sets of windows,
    the first and last window of each part (from the set's first), the byte range that
    its digit covers, and a salt for that digit."""

    def run(batches):
        for b in slices(batches):
            docs, ths, lists = (b.column(c).to_pylist() for c in ("doc", "th", "todo"))
            for first, _, data, offsets in unzipped(b.column("z")):
                out: list[list] = [[] for _ in _FIELDS]
                for k in range(len(offsets) - 1):
                    view = memoryview(data[int(offsets[k]) : int(offsets[k + 1])])
                    doc, th = docs[first + k], ths[first + k]
                    for x in lists[first + k]:
                        a = x["a"]
                        for i, j, lo, hi, salt in parts(x):
                            fields = (
                                _digest(view[a + lo : a + hi], x["g"] + salt * _BASE),
                                _digest(view[a + i : a + j + width], 1 + (x["p"] - i) * 512 + j - i),
                                doc, th, a + i, j - i + 1, x["p"] - i,
                            )
                            for col, value in zip(out, fields):
                                col.append(value)
                yield flush(out)

    def flush(out):
        cols = [_signed(out[0]), _signed(out[1]), *(pa.array(v, f.type) for v, f in zip(out[2:], list(_SCHEMA)[2:]))]
        return pa.record_batch(cols, schema=_SCHEMA)

    return run


def _blocks(width: int):
    """Blocks are counted from the anchor, so that equal windows of two runs stand in
    equal blocks. The digit is what all windows of a block have in common."""

    def parts(x):
        n, p = x["n"], x["p"]
        for q in range((p - n + 1) // BLOCK, p // BLOCK + 1):
            i, j = max(0, p - q * BLOCK - BLOCK + 1), min(n - 1, p - q * BLOCK)
            yield i, j, p - q * BLOCK, p - q * BLOCK - BLOCK + 1 + width, q

    return parts


def _windows(width: int):
    return lambda x: ((i, i, i, i + width, 0) for i in range(x["n"]))


def _refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over written rows: those that repeat in full, and those to split. A
    digit that stands alone is decided and gone."""
    digit = settle(
        rows.groupBy("g").agg(F.count(F.lit(1)).alias("n1"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        .where("n1 > 1").select("g", (F.col("lo") == F.col("hi")).alias("one"))
    )
    left = settle(rows.join(digit, "g"))
    release(rows)
    mixed = left.where(~F.col("one"))
    kinds = settle(mixed.groupBy("g", "r").agg(F.count(F.lit(1)).alias("n2"), F.min(F.struct("doc", "th", "a")).alias("head")))
    mixed = settle(mixed.join(kinds, ["g", "r"]))
    whole = left.where("one").select(*_FIELDS).unionByName(mixed.where("n2 > 1").select(*_FIELDS))
    is_head = (F.col("head.doc").eqNullSafe(F.col("doc"))) & (F.col("head.th") == F.col("th")) & (F.col("head.a") == F.col("a"))
    return whole, mixed.where((F.col("n2") == 1) | is_head).select(*_FIELDS)


def _held(base: DataFrame, rows: DataFrame, alias: str) -> DataFrame:
    """``base`` with the rows of each document as a list (bounded by its own length)."""
    lists = rows.groupBy(F.col("doc").alias("d2"), F.col("th").alias("t2")).agg(F.collect_list("x").alias(alias))
    joined = base.join(lists, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    return joined.select("doc", "th", "z", alias)


def _union(spans):
    """Sorted maximal spans of (lo, hi) pairs; touching ones merge."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cut(batches):
    for b in slices(batches):
        removed, kept = [], []
        lists = b.column("spans").to_pylist()
        for first, _, data, offsets in unzipped(b.column("z")):
            for k in range(len(offsets) - 1):
                view = memoryview(data[int(offsets[k]) : int(offsets[k + 1])])
                merged = _union([(x["lo"], x["hi"]) for x in lists[first + k]])
                digest, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    digest.update(view[at:lo])
                    at = hi
                digest.update(view[at:])
                removed.append([{"lo": lo, "hi": hi} for lo, hi in merged])
                kept.append(digest.hexdigest())
        spans = pa.array(removed, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        yield pa.record_batch([b.column("doc"), b.column("th"), spans, pa.array(kept, pa.string())], names=["d2", "t2", "removed", "left_sha256"])


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``removed`` (maximal byte
    runs that are covered by a ``width``-byte string which also starts anywhere else,
    judged on the input), ``kept_sha256`` of what is left. ``gram`` is a power of two
    below ``width``, and ``width - gram`` is at most 254.

    A null or empty text has no bytes and no runs; texts shorter than ``width`` lose
    nothing. Every row counts as a document: a row that stands twice repeats itself and
    loses its text in both places. Null ids stay null. Other columns are not read."""
    if gram & (gram - 1) or not 0 < gram < width or width - gram > 254:
        raise ValueError("gram: a power of two below width, and width - gram at most 254")
    base = keyed(docs, text, key)
    whole, todo = _refine(settle(base.mapInArrow(_emit_runs(width, gram), _ROW)))

    # The texts that hold any repeated run or one to look into; all later passes read these.
    item = F.struct("g", "a", "n", "p")
    seen = whole.select("doc", "th", F.lit(None).cast("struct<g: long, a: int, n: short, p: short>").alias("x")).distinct()
    held = settle(_held(zipped(base), seen.unionByName(todo.select("doc", "th", item.alias("x"))), "todo").dropDuplicates(["doc", "th"]))
    whole2, todo2 = _refine(settle(held.mapInArrow(_split(width, _blocks(width)), _ROW)))
    fine = _held(held.drop("todo"), todo2.select("doc", "th", item.alias("x")), "todo")
    whole3, _ = _refine(settle(fine.mapInArrow(_split(width, _windows(width)), _ROW)))

    found = whole.unionByName(whole2).unionByName(whole3)
    span = F.struct(F.col("a").alias("lo"), (F.col("a") + F.col("n") - 1 + F.lit(width)).cast("int").alias("hi"))
    cut = _held(held.drop("todo"), found.select("doc", "th", span.alias("x")), "spans").mapInArrow(
        _cut, "d2 long, t2 long, removed array<struct<lo: int, hi: int>>, left_sha256 string"
    )
    facts = base.select("doc", "th", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("own_sha256"))
    joined = facts.join(settle(cut), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    none = F.array().cast("array<struct<lo: int, hi: int>>")
    return joined.select(
        F.col("doc").alias("doc_id"), "n_bytes", F.coalesce("removed", none).alias("removed"), F.coalesce("left_sha256", "own_sha256").alias("kept_sha256")
    )
