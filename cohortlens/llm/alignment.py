"""Two tokenisations of the same texts aligned by interval coalescing.

The tokens of both vocabularies are byte ranges. All of them stand in order of their
start; where a start reaches the largest end so far, a group ends: no token of either
side spans that offset. Overlaps are expanded inside groups only. Texts are handled in
chunks of some megabytes, whose documents stand one behind the other in one coordinate.

What is counted over the corpus, how often a pair of ids is linked, leaves a chunk as one
row for each distinct pair of the chunk, so no shuffle holds a row for each token.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_rows

#: Bytes of text, and texts, of a chunk; letters of a text that are encoded at once.
CHUNK, CHUNK_ROWS, AT_ONCE = 2 << 20, 20_000, 1 << 16
#: Most bytes of a tokenizer file; files are read on the driver and broadcast.
MAX_FILE = 64 << 20
#: A blank between two letters: a token boundary of both vocabularies, see `Coder`.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Pattern of the byte-level pre-tokenizer (a fixed value), and letters whose classes may
#: differ between two readings of it; texts with them, or longer ones, take the slow way.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE, _SHORT = re.compile("[^\\x00-\u024f]"), 2 * AT_ONCE
_B_BITS = 32  # a pair of ids is one long: the A id above, the B id below


class Files(NamedTuple):
    """Tokenizer files as read: a byte-level BPE in JSON, a sentencepiece model."""

    a: bytes
    b: bytes


def load_files(a: str, b: str) -> Files:
    out = []
    for path in (a, b):
        if os.path.getsize(path) > MAX_FILE:
            raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        with open(path, "rb") as f:
            out.append(f.read())
    return Files(*out)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    letters stand for themselves, the other bytes follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(hidden)}


class Coder:
    """Encodes texts with both vocabularies. A long text is cut at blanks between two
    ASCII letters: the byte-level pattern begins a token there, and no sentencepiece has
    a blank behind another letter (else texts are not cut).

    Where a token's id is the rank of its merge, as in all public files of this kind, a
    second encoder over the same ids is used for texts of Latin letters; it is faster."""

    def __init__(self, files: Files):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._a = tokenizers.Tokenizer.from_str(files.a.decode("utf-8"))
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        letters = _byte_letters()
        vocabulary = self._a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self._b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.may_cut = not any(re.search("[^▁]▁", x) for x in names)
        self._fast = self._ranked(json.loads(files.a))
        #: What follows an id in the digest: a token of its side, the other side, a group.
        self.shown = [b"%d%c" % (i, c) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in b",|;"]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def _ranked(self, file: dict):
        import tiktoken

        model, plain = file["model"], {x["id"] for x in file.get("added_tokens", [])}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        by_rank = all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        level = file.get("pre_tokenizer") or {}
        as_known = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex", True) and not file.get("normalizer")
        if not (by_rank and as_known and not model.get("ignore_merges")):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in plain}
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A ids of each text."""
        slow = [i for i, x in enumerate(texts) if self._fast is None or len(x) > _SHORT or _RARE.search(x)]
        out = [[]] * len(texts)
        for i, x in zip(slow, self._a.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = x.ids
        left = set(slow)
        for i, x in enumerate(texts):
            if i not in left:
                out[i] = self._fast.encode_ordinary(x)
        return out

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.may_cut and len(text) - at > AT_ONCE and (m := _CUT.search(text, at + AT_ONCE)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids, and how many of each every text has. A text whose tokens of
        either side do not join to a blank and the text has none."""
        parts, of = [], []
        for i, t in enumerate(texts):
            if t:
                own = list(self.parts(t))
                parts += own
                of += [i] * len(own)
        a = self.a_ids([" " + x for x in parts])
        b = self._b.encode(parts, num_threads=1) if parts else []
        a_get, b_get = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        bad = set()
        for i, part, x, y in zip(of, parts, a, b):
            want = b" " + part.encode()
            if b"".join(map(a_get, x)) != want or b"".join(map(b_get, y)) != want:
                bad.add(i)
        kept = [k for k, i in enumerate(of) if i not in bad]
        flat = lambda ids: np.fromiter(chain.from_iterable(ids[k] for k in kept), np.int64)
        many = lambda ids: np.bincount([of[k] for k in kept], [len(ids[k]) for k in kept], len(texts)).astype(np.int64)
        if not kept:
            none = np.zeros(len(texts), np.int64)
            return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none.copy()
        return flat(a), flat(b), many(a), many(b)


_CODERS: dict[str, Coder] = {}


def coder(files: Files) -> Coder:
    """The coder of a worker process, made once."""
    key = hashlib.sha256(files.a + files.b).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(files)
    return _CODERS[key]


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number, from 0, of every A and every B interval."""
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    first = np.ones(len(order), bool)
    first[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all intervals that share a byte; each side is in order and
    without overlap of its own, so there are fewer of them than intervals."""
    lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(a_start)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Chunk(NamedTuple):
    """Aligned documents: ids of both sides, counts per document, groups, links."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def per_document(self, at: np.ndarray) -> np.ndarray:
        """Document of A tokens ``at``."""
        return np.repeat(np.arange(len(self.n_a)), self.n_a)[at]

    def first_of_group(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.a_group, prepend=-1))

    def digests(self, code: Coder) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` for each document; without tokens empty."""
        groups = int(self.a_group[-1]) + 1 if len(self.a) else 0
        in_a, in_b = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.zeros(len(ids), np.int64)  # what follows an id: , | ;
        a_at = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.a_group]
        b_at = np.arange(len(self.b)) + np.cumsum(in_a)[self.b_group]
        ids[a_at], ids[b_at] = self.a, self.b
        mark[a_at[np.diff(self.a_group, append=groups) > 0]] = 1
        mark[b_at[np.diff(self.b_group, append=groups) > 0]] = 2
        word = ids * 3 + mark
        get, at, out = code.shown.__getitem__, 0, []
        for end in np.cumsum(self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(map(get, word[at:end].tolist()))[:-1]).hexdigest() if end > at else "")
            at = end
        return out


def align(code: Coder, texts: list[str]) -> Chunk:
    sides = [code.encode(texts[i : i + 200]) for i in range(0, len(texts), 200)] or [code.encode([])]
    a, b, n_a, n_b = (np.concatenate(x) for x in zip(*sides))
    a_end, b_end = np.cumsum(code.a_len[a]), np.cumsum(code.b_len[b])
    spans = a_end - code.a_len[a], a_end, b_end - code.b_len[b], b_end
    a_group, b_group = coalesce(*spans)
    i, j = overlaps(*spans)
    linked = a_end[i] == b_end[j]
    return Chunk(a, b, n_a, n_b, a_group, b_group, a_end, i[linked], j[linked])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts, some megabytes at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id"), text_rows(batch.column("text"))):
            ids.append(i.as_py())
            texts.append(t)
            held += len(t)
            if held >= CHUNK or len(ids) >= CHUNK_ROWS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def groups(docs: DataFrame, files: Files, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each group of each document: ``doc_id``, ``part`` (from 0), ``lo``,
    ``hi`` (bytes of a blank and the text), ``a``, ``b`` (ids in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        code = coder(shared.value)
        for ids, texts in chunked(batches):
            c = align(code, texts)
            first = c.first_of_group()
            if not len(first):
                continue
            doc = c.per_document(first)
            begins = np.append(c.a_end[first[1:] - 1], c.a_end[-1])
            base = np.zeros(len(texts), np.int64)
            own = np.bincount(doc, np.diff(begins, prepend=0), len(texts)).astype(np.int64)
            base[1:] = np.cumsum(own)[:-1]
            part = np.arange(len(first)) - np.searchsorted(doc, doc, "left")
            cut = lambda x, g: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(g, np.arange(len(first)), "left"), len(x)), pa.int32()), pa.array(x, pa.int32()))
            lo = np.append(0, begins[:-1])
            columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(part), pa.array(lo - base[doc]), pa.array(begins - base[doc]), cut(c.a, c.a_group), cut(c.b, c.b_group)]
            yield pa.record_batch(columns, names=["doc_id", "part", "lo", "hi", "a", "b"])

    return _named(docs, text, key).mapInArrow(run, "doc_id long, part long, lo long, hi long, a array<int>, b array<int>")


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_CHUNKS = f"chunk long, docs array<struct<{_DOCS.replace(' ', ':').replace(',:', ',')}>>, pairs array<long>, counts array<long>, links binary"


def aligned(docs: DataFrame, files: Files, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each chunk, written: its documents, its distinct linked pairs of ids
    with their counts, and its links as places in ``pairs`` (compressed)."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    names = [x.split()[0] for x in _DOCS.split(", ")]

    def run(batches):
        code, pack = coder(shared.value), zstandard.ZstdCompressor(level=3).compress
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(chunked(batches)):
            c = align(code, texts)
            n_groups = np.bincount(c.per_document(c.first_of_group()), minlength=len(texts))
            n_links = np.bincount(c.per_document(c.link_a), minlength=len(texts))
            pairs, place, counts = np.unique((c.a[c.link_a] << _B_BITS) | c.b[c.link_b], return_inverse=True, return_counts=True)
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (c.n_a, c.n_b, n_groups, n_links)), pa.array(c.digests(code), pa.string())]
            rows = pa.StructArray.from_arrays(columns, names=names)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            links = pa.array([pack(place.astype(np.int32).tobytes())], pa.binary())
            yield pa.record_batch([pa.array([(task << 32) + k], pa.int64()), one(rows), one(pa.array(pairs, pa.int64())), one(pa.array(counts, pa.int64())), links], names=["chunk", "docs", "pairs", "counts", "links"])

    return settle(_named(docs, text, key).mapInArrow(run, _CHUNKS))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair``, ``a``, ``b``, ``count`` (links that hold the pair), ``best`` (no pair of
    the same B id has more): the map of one vocabulary onto the other."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    totals = settle(each.groupBy("pair").agg(F.sum("n").alias("count")).select("pair", F.shiftright("pair", _B_BITS).alias("a"), b.alias("b"), "count"))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, files: Files, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A null or empty text, and one that either vocabulary changes, has no tokens: zeros
    and an empty digest. Repeated rows and ids are rows of their own and all count. Only
    the id and the text are read, so other columns may have any name. A text may be of
    any length; what is encoded at once is 65,536 letters and what follows to the next
    blank between two ASCII letters, so a text without such blanks is encoded whole."""
    chunks = aligned(docs, files, text, key)
    places = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    scored = places.join(pair_counts(chunks).select("pair", "count", "best"), "pair").select("chunk", "pos", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pos")
        count, best = right.column("count").to_numpy(), right.column("best").to_numpy()
        rows = left.column("docs").combine_chunks().flatten()
        packed = left.column("links")[0].as_py()
        place = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32) if len(count) else np.zeros(0, np.int32)
        ends = np.append(0, np.cumsum(rows.field("n_links").to_numpy()))
        running = lambda x: np.append(0, np.cumsum(x[place], dtype=np.int64))
        sums = {n: (s := running(x))[ends[1:]] - s[ends[:-1]] for n, x in (("n_best", best), ("count_sum", count))}
        keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(rows.field(n) for n in keep), *(pa.array(x, pa.int64()) for x in sums.values()), rows.field("groups_sha256")], names=[*keep, *sums, "groups_sha256"])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.select(F.col("chunk").alias("own"), "docs", "links").groupBy("own").cogroup(scored.groupBy("chunk")).applyInArrow(run, out)
