"""Ranked lexical search turned round: documents are streamed through the queries.

The queries' terms form an inverted index, broadcast in blocks of bounded size. A first
pass counts what the weights need: documents, terms, and documents of each query term. A
second pass takes each document's term counts through the index, adds up its score for
every item it shares a term with, and offers it to the item's heap, which holds the best
few. The heaps of all tasks are merged, first in salted parts, then by item. No posting
list of the documents is ever built or shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs

#: Postings (term and item) at which a block of items is closed; an item of more has a
#: block of its own, and one of more than the second number is an error.
POSTINGS, MOST = 1 << 18, 1 << 22
#: Bytes of text split at once; cells of the score table; postings added at once.
_PIECE, _CELLS, _ADDS = 1 << 20, 1 << 20, 1 << 21
#: Parts in which an item's heaps are merged first.
_SALTS = 64
_NONE = 1 << 63  # above every id: null ids stand last among ties


def _fold() -> bytes:
    """Bytes of a term stay (A-Z as a-z, all of UTF-8 beyond ASCII), others are blanks."""
    keep = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        keep[c] = c
    for c in range(ord("A"), ord("Z") + 1):
        keep[c] = c + 32
    return bytes(keep)


_FOLD = _fold()


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in order: runs of ASCII letters and digits and of
    letters beyond ASCII, only A-Z in lower case. Long texts come in several lists."""
    folded = text.translate(_FOLD)
    at = 0
    while len(folded) - at > _PIECE:
        end = folded.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield folded[at:end].split()
        at = end
    yield (folded[at:] if at else folded).split()


class Index(NamedTuple):
    """Inverted index of a block of items: for term number t, places ``ptr[t]`` to
    ``ptr[t + 1]`` of ``item`` and ``times`` (its occurrences in that item)."""

    number: dict[bytes, int]
    ptr: np.ndarray
    item: np.ndarray
    times: np.ndarray
    ids: list[int | None]


def _index(block: list[tuple[int | None, Counter]]) -> Index:
    number: dict[bytes, int] = {}
    rows = [(number.setdefault(t, len(number)), i, n) for i, (_, terms) in enumerate(block) for t, n in terms.items()]
    table = np.array(rows, np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0], kind="stable")]
    ptr = np.searchsorted(table[:, 0], np.arange(len(number) + 1))
    return Index(number, ptr, table[:, 1].copy(), table[:, 2].copy(), [i for i, _ in block])


def blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes of ``item_id``, ``text`` rows; items pass the driver one partition at a
    time and only a block of them is held."""
    block, held = [], 0
    for row in items.toLocalIterator():
        terms = Counter(t for part in term_lists((row.text or "").encode()) for t in part)
        if len(terms) > MOST:
            raise ValueError(f"item {row.item_id} has more than {MOST} different terms")
        if not terms:
            continue
        if block and held + len(terms) > POSTINGS:
            yield _index(block)
            block, held = [], 0
        block.append((row.item_id, terms))
        held += len(terms)
    if block:
        yield _index(block)


def _documents(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[tuple[int | None, int, Counter]]:
    """Id, number of terms, and counts of the index's terms, of each document."""
    known = number.__contains__
    for b in batches:
        data, offsets = blobs(b.column("text"))
        body = memoryview(data)
        for i, x, y in zip(b.column("doc_id"), offsets[:-1].tolist(), offsets[1:].tolist()):
            n, counts = 0, Counter()
            for terms in term_lists(bytes(body[x:y])):
                n += len(terms)
                counts.update(filter(known, terms))
            yield i.as_py(), n, counts


class Statistics(NamedTuple):
    documents: int
    terms: int
    weight: np.ndarray  # of each term number


def statistics(docs: DataFrame, shared, n_terms: int) -> Statistics:
    """Counts over all documents; one row for each term of the block comes back."""

    def run(batches):
        number = shared.value.number
        df = np.zeros(len(number) + 2, np.int64)  # the last two: documents, terms
        for _, n, counts in _documents(batches, number):
            df[-2] += n > 0
            df[-1] += n
            for t in counts:
                df[number[t]] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "n"])

    totals = np.zeros(n_terms + 2, np.int64)
    for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        totals[r.term] = r.n
    n, df = int(totals[-2]), totals[:-2].tolist()
    return Statistics(n, int(totals[-1]), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df], np.int64))


class _Heaps:
    """The best ``k`` of each item, smallest score and then largest id on top."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)  # no lower score can enter

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        at, item = np.nonzero(scores >= self.least)
        for d, i, s in zip(at.tolist(), item.tolist(), scores[at, item].tolist()):
            entry, heap = (s, -(_NONE if ids[d] is None else ids[d])), self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _search(docs: DataFrame, shared, stats, k: int, first: int) -> DataFrame:
    def run(batches):
        index, (n_docs, n_terms, weight) = shared.value, stats.value
        items = len(index.ids)
        gain = index.times * np.repeat(weight, np.diff(index.ptr))
        width, heaps = np.diff(index.ptr), _Heaps(items, k)
        rows = max(1, _CELLS // items)
        ids: list[int | None] = []
        lengths, doc, term, tf = [], [], [], []
        adds = 0

        def flush():
            d, t, f = (np.array(x, np.int64) for x in (doc, term, tf))
            m = 75 + (25 * np.array(lengths, np.int64) * n_docs) // n_terms
            part = (1_000_000_000 * f) // (1000 * f + 12 * m[d])
            w = width[t]
            at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(index.ptr[t], w)
            scores = np.zeros(len(ids) * items, np.int64)
            np.add.at(scores, np.repeat(d, w) * items + index.item[at], gain[at] * np.repeat(part, w))
            heaps.offer(scores.reshape(len(ids), items), ids)
            for x in (ids, lengths, doc, term, tf):
                x.clear()

        for i, n, counts in _documents(batches, index.number):
            if not counts:
                continue
            own = [index.number[t] for t in counts]
            doc += [len(ids)] * len(own)
            term += own
            tf += counts.values()
            ids.append(i)
            lengths.append(n)
            adds += int(width[own].sum())
            if len(ids) >= rows or adds >= _ADDS:
                flush()
                adds = 0
        if ids:
            flush()
        out = [(first + i, index.ids[i], None if -d == _NONE else -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4
        yield pa.record_batch(columns, names=["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: for each row of ``items``
    the ``k`` rows of ``docs`` with the largest score above 0; equal scores by id, null
    ids last.

    An item or document without terms (null, empty, only signs) has no rows. Rows that
    repeat, or share an id, are rows of their own on both sides. Only ids and texts are
    read, so other columns may have any name. Texts may be of any length: long ones are
    split a megabyte at a time. Each block of items reads the documents twice; the first
    reading runs while the plan is made. An empty table on either side: no rows."""
    spark = docs.sparkSession
    named = lambda df, i, t, name: df.select(F.col(i).cast("long").alias(name), F.col(t).cast("string").alias("text"))
    base = named(docs, key, text, "doc_id")
    found, first = [], 0
    for index in blocks(named(items, item_key, item_text, "item_id")):
        shared = spark.sparkContext.broadcast(index)
        stats = spark.sparkContext.broadcast(tuple(statistics(base, shared, len(index.number))))
        found.append(_search(base, shared, stats, k, first))
        first += len(index.ids)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    heaps = reduce(DataFrame.unionAll, found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    salted = heaps.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SALTS)))
    return best(best(salted, "item", "salt"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(k: int = 20) -> str:
    """The query over ``documents`` and ``benchmark`` in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, 75 + ((25 * CAST(len(w) AS BIGINT) * nn) // ll) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q.i, m.doc_id, t.r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM t JOIN q USING (term) JOIN f USING (term) JOIN m ON m.r = t.r GROUP BY q.i, m.doc_id, t.r)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, score FROM (
  SELECT b.item_id, x.doc_id, x.score, row_number() OVER (PARTITION BY x.i ORDER BY x.score DESC, x.doc_id NULLS LAST, x.r) AS rk
  FROM x JOIN b ON b.i = x.i WHERE x.score > 0) WHERE rk <= {k}"""
