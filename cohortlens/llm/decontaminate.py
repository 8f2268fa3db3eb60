"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features and weighted by their inverse document frequency over all
documents. A randomised SVD of TF-IDF passages gives a small latent space; it is fitted
on all passages of the benchmark and of every document, in one pass that leaves sums of a
bounded size, and whitened, so that language and topic do not outweigh the rest. Windows of
documents and benchmark passages meet by cosine; what is near is checked word by word: the
longest common subsequence with the whole passage and, for looser copies, the answer.

A hit shares at least half of a passage's words, so of its rarest words, a few more than
half, some must stand around the window. An inverted list of those words, counted over the
reach of a window, leaves few windows, and word signatures (each bit of the passage's that
the surroundings lack is a missing word) fewer to take a cosine of. Both lose no hit. Texts are read
in tiles of words that overlap by that reach, so memory does not grow with a text's length.

Half of the words in order may be function words that meet by chance. The looser rule
therefore asks that the common words carry half of the passage's weight (inverse document
frequency), and that the answer stands in order there too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, keyed, pieces, settle
from .jaccard import words_of

#: Features, width of the sketch (bits of one hash), and latent dimensions kept.
FEATURES, SKETCH, LATENT = 1 << 17, 64, 60
#: Bytes of text (about) whose passages one task of the fit adds up.
FIT_BYTES = 1 << 30
#: Words of a block; windows are of some blocks, benchmark passages of up to PASSAGE words.
BLOCK, WINDOWS, PASSAGE = 16, (2, 3, 4), 48
#: Besides, short passages meet short windows, or the words around would outweigh them: for
#: passages of up to so many words, windows of so many blocks of FINE words.
FINE, SHORT = 4, ((5, (1, 2)), (9, (2, 3)), (13, (3, 4)), (20, (4, 5, 6)))
#: Benchmark passages that are broadcast at once; more take more passes.
AT_ONCE = 20_000
#: Cosine of a candidate; share of a passage's words in the common subsequence that makes
#: a hit by itself; share of its words and of their weight that does with its answer.
NEAR, COPY, LOOSE = 0.25, 0.75, 0.5
#: Rare words of a passage that must stand around a window; words of a tile.
SEEN, TILE = 4, 1 << 16
#: Bits of a word signature.
BITS = 512
_PIECE = 1 << 18
_TASK = pa.schema([("v", pa.list_(pa.float64()))])
#: Words are runs of digits, letters and non-ASCII bytes.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(data: np.ndarray, offsets: np.ndarray):
    w, at = words_of(data, offsets, _APART)
    return w, (w & np.uint64(FEATURES - 1)).astype(np.int64), at


def _row_words(column) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = blobs(column)
    w, f, at = _words(data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0])
    return [(w[x:y], f[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _frequencies(batches):
    """Documents that hold each feature, summed over the task."""
    total = np.zeros(FEATURES, np.int64)
    for b in batches:
        data, offsets = blobs(b.column("text"))
        for i, j in pieces(offsets, _PIECE):
            lo, hi = int(offsets[i]), int(offsets[j])
            _, f, at = _words(data[lo:hi], offsets[i : j + 1] - lo)
            row = np.repeat(np.arange(j - i), np.diff(at))
            total += np.bincount(np.unique(row * FEATURES + f) % FEATURES, minlength=FEATURES)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["f", "n"])


def _cut(words: int, length: int = PASSAGE) -> list[tuple[int, int]]:
    """Word ranges of the passages of a text: all of it, or overlapping halves."""
    if words <= length:
        return [(0, words)] if words else []
    step = length // 2
    return [(s, min(words, s + length)) for s in range(0, words - step, step)]


def _moments(idf: np.ndarray, hashes: np.ndarray):
    """Sums over the TF-IDF passages (rows of unit length) of the task's texts. By feature:
    weight times the passage's sketch with random signs; below 0 the rows of the sum of
    outer products of the sketches."""
    half = PASSAGE // 2

    def run(batches):
        signs = (np.where(hashes[:, None] >> np.arange(SKETCH) & 1, 1.0, -1.0) * idf[:, None]).astype(np.float32)
        gram, total = np.zeros((SKETCH, SKETCH)), np.zeros((FEATURES, SKETCH))
        for b in batches:
            data, offsets = blobs(b.column("text"))
            for i, j in pieces(offsets, _PIECE):
                lo, hi = int(offsets[i]), int(offsets[j])
                _, f, at = _words(data[lo:hi], offsets[i : j + 1] - lo)
                if not len(f):
                    continue
                # The passages of _cut: two half passages each, or the only one of a short text.
                n = np.diff(at)
                blocks = -(-n // half)
                start = _spread(np.zeros(len(n), np.int64), blocks) * half + np.repeat(at[:-1], blocks)
                many = np.maximum(blocks - 1, np.minimum(blocks, 1))
                first = _spread(np.cumsum(blocks) - blocks, many)
                two = np.repeat(blocks > 1, many)
                words = np.minimum(start[first] + PASSAGE, np.repeat(at[1:], many)) - start[first]
                u, k = np.unique(np.repeat(np.arange(len(first)) * FEATURES, words) + f[_spread(start[first], words)], return_counts=True)
                norm = np.sqrt(np.bincount(u // FEATURES, (k * idf[u % FEATURES]) ** 2, len(first)))
                scale = np.divide(1.0, norm, out=np.zeros(len(norm)), where=norm > 0)[:, None].astype(np.float32)
                # The features of the piece, the most frequent first, and their places.
                order = np.argsort(f)
                cut = np.flatnonzero(np.diff(f[order], prepend=-1))
                count = np.diff(cut, append=len(f))
                by = np.argsort(-count)
                cut, count = cut[by], count[by]
                own = f[order[cut]]
                number = np.empty(len(f), np.int64)
                number[order[_spread(cut, count)]] = np.repeat(np.arange(len(cut)), count)
                parts, near = np.zeros((len(start), SKETCH), np.float32), signs[own]
                length = np.diff(start, append=len(f))
                for step in range(half):
                    some = np.flatnonzero(length > step)
                    parts[some] += near[number[start[some] + step]]
                y = parts[first]
                y[two] += parts[first[two] + 1]
                y *= scale
                wide = y.astype(np.float64)
                gram += wide.T @ wide
                # What the words of a half passage add: the sketches of the passages around it.
                y *= scale
                z = np.zeros(parts.shape, np.float32)
                z[first] = y
                z[first[two] + 1] += y[two]
                around = np.repeat(np.arange(len(start)), length)[order]
                added = np.zeros((len(cut), SKETCH))
                for step in range(min(64, int(count[0]))):
                    m = np.searchsorted(-count, -step, "left")
                    added[:m] += z[around[cut[:m] + step]]
                for g in range(np.searchsorted(-count, -64, "left")):
                    added[g] += z[around[cut[g] + 64 : cut[g] + count[g]]].sum(axis=0, dtype=np.float64)
                total[own] += added
        total *= idf[:, None]
        some = np.flatnonzero(total.any(axis=1))
        for rows, y in [(-1 - np.arange(SKETCH), gram), *((some[x : x + 2048], total[some[x : x + 2048]]) for x in range(0, len(some), 2048))]:
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * SKETCH)
            yield pa.record_batch([pa.array(rows.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["f", "y"])

    return run


def _gram(rows: DataFrame) -> np.ndarray:
    """Sum of outer products of the array column ``y``: one small matrix from each task."""

    def run(batches):
        total = np.zeros((SKETCH, SKETCH))
        for b in batches:
            y = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
            total += y.T @ y
        yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], schema=_TASK)

    parts = rows.select("y").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(SKETCH * SKETCH)
    for r in parts:
        out[r.i] = r.x
    return out.reshape(SKETCH, SKETCH)


def _rotate(rows: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            y = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH) @ by
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * by.shape[1])
            yield pa.record_batch([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[key, "y"])

    return rows.select(key, "y").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, y array<double>")


def _signs() -> Column:
    """Random bits of the feature ``f``, one for each column of the sketch."""
    return F.xxhash64(F.lit(7), F.col("f").cast("int"))


def latent_space(passages: DataFrame, whiten_space: bool = False) -> np.ndarray:
    """Right singular vectors (FEATURES x LATENT) of the matrix in long form ``pid``,
    ``f``, ``w``: sketch with random signs, orthonormal range, and the small SVD."""
    a = settle(passages)
    sketch = a.withColumn("h", _signs()).groupBy("pid").agg(
        F.array(*[F.sum(F.when(F.shiftright("h", j).bitwiseAND(1) == 1, F.col("w")).otherwise(-F.col("w"))) for j in range(SKETCH)]).alias("y")
    )
    y = settle(sketch)
    q = _rotate(y, "pid", _whitening(_gram(y)))
    return _directions(settle(a.join(settle(q), "pid").groupBy("f").agg(F.array(*[F.sum(F.col("w") * F.col("y")[j]) for j in range(SKETCH)]).alias("y"))), whiten_space)


def corpus_space(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """:func:`latent_space`, whitened, of the passages of the column ``text``; each text is
    read once, and what a task leaves does not grow with its texts."""
    table = texts.sparkSession.range(FEATURES).select(F.col("id").alias("f")).select("f", _signs().alias("h")).toArrow()
    hashes = np.zeros(FEATURES, np.int64)
    hashes[table.column("f").to_numpy()] = table.column("h").to_numpy()
    made = texts.select("text").mapInArrow(_moments(idf, hashes), "f int, y array<double>")
    sums = settle(made.groupBy("f").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(SKETCH)]).alias("y")))
    gram = np.zeros((SKETCH, SKETCH))
    for r in sums.where("f < 0").collect():
        gram[-1 - r.f] = r.y
    return _directions(settle(_rotate(sums.where("f >= 0"), "f", _whitening(gram))), True)


def _whitening(gram: np.ndarray) -> np.ndarray:
    """What turns sketches with these outer products into an orthonormal range."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(initial=0), 1e-30) * 1e-10
    whiten = np.zeros((SKETCH, SKETCH))
    whiten[:, good] = vectors[:, good] / np.sqrt(values[good])
    return whiten


def _directions(b: DataFrame, whiten_space: bool) -> np.ndarray:
    """Singular vectors by feature of the small matrix with the rows ``f``, ``y``."""
    values, vectors = np.linalg.eigh(_gram(b))
    top = np.argsort(-values)[:LATENT]
    top = top[values[top] > max(values.max(initial=0), 1e-30) * 1e-10]
    # Whitened: divided by the singular value once for the unit vector, once more for the scale.
    turn = vectors[:, top] / (values[top] if whiten_space else np.sqrt(values[top]))
    out = np.zeros((FEATURES, LATENT), np.float32)
    # At most FEATURES rows.
    table = _rotate(b, "f", turn).toArrow()
    if table.num_rows and len(top):
        out[table.column("f").to_numpy(), : len(top)] = table.column("y").combine_chunks().flatten().to_numpy().reshape(-1, len(top))
    return out


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common_weight(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence, ``weight`` being that of the words of ``a``."""
    best = np.zeros(len(b) + 1)
    for word, own in zip(a, weight):
        taken = np.where(b == word, best[:-1] + own, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1])


def _signatures(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """OR of one bit for each word, by block."""
    bit = (w >> np.uint64(40)) & np.uint64(BITS - 1)
    flags = np.zeros((len(w), BITS // 64), np.uint64)
    flags[np.arange(len(w)), (bit >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bit & np.uint64(63))
    return np.bitwise_or.reduceat(flags, starts, axis=0)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges ``start``, ``start + n`` one after another."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Searcher:
    """Benchmark passages (item, words, answer words) with their vectors, and the
    inverted list of their rare words."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, list[int]]], idf: np.ndarray, space: np.ndarray):
        self.weighted = (space * idf[:, None]).astype(np.float32)
        self.passages, vectors, rare, marks, answers, allowed = [], [], [], [], [], []
        for item, w, f, answer in items:
            for x, y in _cut(len(f)):
                weight = idf[f[x:y]]
                need = int(np.ceil(LOOSE * (y - x)))
                seen = min(SEEN, need)
                rare.append((seen, np.unique(f[x:y][np.argsort(-weight, kind="stable")[: (y - x) - need + seen]])))
                marks.append(_signatures(w[x:y], np.zeros(1, np.int64))[0])
                answers.append(_signatures(np.array(answer, np.uint64), np.zeros(1, np.int64))[0] if answer else np.full(BITS // 64, ~np.uint64(0)))
                allowed.append(((y - x) - need, (y - x) - int(np.ceil(COPY * (y - x)))))
                self.passages.append((item, w[x:y], answer, weight))
                vectors.append(self.weighted[f[x:y]].sum(axis=0))
        self.vectors = _unit(np.array(vectors, np.float32)) if vectors else np.zeros((0, LATENT), np.float32)
        self.marks, self.allowed = np.array(marks, np.uint64), np.array(allowed, np.int64).reshape(-1, 2)
        self.answers = np.array(answers, np.uint64)
        self.seen = np.array([seen for seen, _ in rare], np.int64)
        lengths = np.array([len(words) for _, words, _, _ in self.passages], np.int64)
        feature = np.concatenate([u for _, u in rare]) if rare else np.zeros(0, np.int64)
        holder = np.repeat(np.arange(len(rare)), [len(u) for _, u in rare])
        self.holders = holder[np.argsort(feature, kind="stable")]
        self.held = np.bincount(feature, minlength=FEATURES)
        self.first = np.cumsum(self.held) - self.held
        # Block size, windows and the passages that meet them.
        self.plans = [(BLOCK, WINDOWS, np.ones(len(lengths), bool))]
        above = 0
        for most, windows in SHORT:
            which = (lengths > above) & (lengths <= most)
            above = most
            if which.any():
                self.plans.append((FINE, windows, which))
        self.reach = max(size * (max(windows) + 2) for size, windows, _ in self.plans)

    def hits(self, w: np.ndarray, f: np.ndarray, at: np.ndarray):
        """(row, item, cosine, share, answered, first word) of what passes the checks."""
        if not len(w) or not self.passages:
            return
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        cut = {}
        for size in {size for size, _, _ in self.plans}:
            # Blocks start anew at every row.
            blocks = -(-np.diff(at) // size)
            cut[size] = np.append(0, np.cumsum(blocks)), _signatures(w, _spread(np.zeros(len(blocks), np.int64), blocks) * size + np.repeat(at[:-1], blocks))
        for lo in range(0, len(w), TILE):
            own = f[lo : lo + TILE + self.reach]
            n = self.held[own]
            place = np.repeat(np.arange(lo, lo + len(own)), n)
            passage = self.holders[_spread(self.first[own], n)]
            order = np.argsort(passage, kind="stable")
            place, passage = place[order], passage[order]
            for size, windows, which in self.plans:
                meets = which[passage]
                yield from self._checked(w, f, at, size, windows, *self._windows(at, row, size, max(windows), *cut[size], place[meets], passage[meets]))

    def _windows(self, at: np.ndarray, row: np.ndarray, size: int, most: int, base: np.ndarray, marks: np.ndarray, place: np.ndarray, passage: np.ndarray):
        """Row, first block and passage of windows of up to ``most`` blocks that have
        enough rare words of the passage inside or in the next block on either side."""
        last = np.arange(len(place)) + self.seen[passage] - 1
        inside = last < len(place)
        i, j = np.flatnonzero(inside), last[inside]
        i, j = (x[(passage[i] == passage[j]) & (row[place[i]] == row[place[j]])] for x in (i, j))
        r, p = row[place[i]], passage[i]
        block, end = (place[i] - at[r]) // size, (place[j] - at[r]) // size
        keys = []
        for back in range(most + 2):
            s = block + 1 - back
            ok = (s >= end - most) & (s >= 0) & (base[r] + s < base[r + 1])
            keys.append((base[r[ok]] + s[ok]) * len(self.passages) + p[ok])
        key = np.unique(np.concatenate(keys))
        start, p = key // len(self.passages), key % len(self.passages)
        r = np.searchsorted(base, start, "right") - 1
        near = np.zeros((len(start), BITS // 64), np.uint64)
        for step in range(-1, most + 1):
            there = start + step
            ok = (there >= base[r]) & (there < base[r + 1])
            near[ok] |= marks[there[ok]]
        lacking = np.bitwise_count(self.marks[p] & ~near).sum(axis=1)
        # A copy by itself, or a looser one beside its whole answer.
        loose = (lacking <= self.allowed[p, 0]) & ~(self.answers[p] & ~near).any(axis=1)
        ok = (lacking <= self.allowed[p, 1]) | loose
        return r[ok], start[ok] - base[r[ok]], p[ok]

    def _checked(self, w: np.ndarray, f: np.ndarray, at: np.ndarray, size: int, windows: tuple[int, ...], row: np.ndarray, block: np.ndarray, passage: np.ndarray):
        for part in range(0, len(row), 4096):
            r, s, p = (x[part : part + 4096] for x in (row, block, passage))
            begin = at[r] + s * size
            where, back = np.unique(begin, return_inverse=True)
            stop = at[np.searchsorted(at, where, "right")]
            for m in windows:
                n = np.minimum(stop, where + m * size) - where
                vectors = _unit(np.add.reduceat(self.weighted[f[_spread(where, n)]], np.cumsum(n) - n, axis=0))
                cosine = np.einsum("ij,ij->i", vectors[back], self.vectors[p])
                for x in np.flatnonzero(cosine >= NEAR).tolist():
                    lo, hi = max(int(at[r[x]]), int(begin[x]) - size), min(int(stop[back[x]]), int(begin[x]) + (m + 1) * size)
                    found = self._judged(int(p[x]), w[lo:hi])
                    if found:
                        yield int(r[x]), self.passages[p[x]][0], float(cosine[x]), *found, lo - int(at[r[x]])

    def _judged(self, passage: int, text: np.ndarray) -> tuple[float, bool] | None:
        """Share of the passage's words in the text, in order, and whether it answers."""
        _, words, answer, weight = self.passages[passage]
        near = text.tolist()
        share = common_length(words.tolist(), near) / len(words)
        if share < LOOSE:
            return None
        answered = bool(answer) and common_length(answer, near) == len(answer)
        if share >= COPY or answered and common_weight(words, text, weight) >= LOOSE * weight.sum():
            return share, answered
        return None


def _search(shared):
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answered", pa.bool_()), ("first_word", pa.int64())])

    def run(batches):
        items, idf, space = shared.value
        searcher = Searcher(items, idf, space)
        for b in batches:
            data, offsets = blobs(b.column("text"))
            out: list[list] = [[] for _ in schema]
            for i, j in pieces(offsets, _PIECE):
                lo, hi = int(offsets[i]), int(offsets[j])
                for r, item, cosine, share, answered, first in searcher.hits(*_words(data[lo:hi], offsets[i : j + 1] - lo)):
                    row = (b.column("doc")[i + r].as_py(), b.column("th")[i + r].as_py(), item, cosine, share, answered, first)
                    for col, x in zip(out, row):
                        col.append(x)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", answer: str | None = None
) -> DataFrame:
    """One row for every row of ``docs`` (``doc``, ``th``: see :func:`common.keyed`) and
    benchmark item that it holds a copy or paraphrase of: ``item_id``, the best
    ``cosine``, ``share`` of a passage's words in the longest common subsequence,
    whether the ``answered`` words stand there too, and the ``first_word`` looked at.

    ``answer`` names the benchmark's answer column; without one an item's last five
    words stand for it. Null or empty texts hold nothing and are held by nothing; null
    item ids are reported as null; rows of ``docs`` that repeat give one row. Texts of any
    length are read in tiles; other columns of either table are not looked at."""
    spark = docs.sparkSession
    base = keyed(docs, text, key)
    counts = settle(base.mapInArrow(_frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")))
    n_docs, n_bytes = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    table = counts.toArrow()  # at most FEATURES rows
    df = np.zeros(FEATURES)
    df[table.column("f").to_numpy()] = table.column("n").to_numpy()
    idf = np.log((1.0 + n_docs) / (1.0 + df))
    bench = settle(benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).withColumn("pid", F.monotonically_increasing_id()))
    # Few large tasks, for each leaves a table of all features.
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // FIT_BYTES))
    space = corpus_space(base.select("text").coalesce(tasks).unionByName(bench.select("text")), idf)

    found, first, total = None, 0, bench.count()
    ordered = bench.orderBy("pid")
    while first < total or found is None:
        rows = ordered.offset(first).limit(AT_ONCE).collect()
        first += AT_ONCE
        texts = _row_words(pa.array([r.text for r in rows], pa.string())) if rows else []
        answers = _row_words(pa.array([r.answer for r in rows], pa.string())) if rows else []
        items = [(r.item, w, f, (x.tolist() if r.answer else w[-5:].tolist())) for r, (w, f), (x, _) in zip(rows, texts, answers)]
        shared = spark.sparkContext.broadcast((items, idf.astype(np.float32), space))
        hits = base.mapInArrow(_search(shared), "doc long, th long, item_id long, cosine double, share double, answered boolean, first_word long")
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("share", "cosine", "answered", (-F.col("first_word")).alias("place"))).alias("x")
    return found.groupBy("doc", "th", "item_id").agg(best).select(
        "doc", "th", "item_id", "x.cosine", "x.share", "x.answered", (-F.col("x.place")).alias("first_word")
    )


def without(docs: DataFrame, hits: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that have a hit."""
    bad = settle(hits.select(F.col("doc").alias("__d"), F.col("th").alias("__t")).distinct())
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(bad, F.col(key).cast("long").eqNullSafe(F.col("__d")) & (own == F.col("__t")), "left_anti")
