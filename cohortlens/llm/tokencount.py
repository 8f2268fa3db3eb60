"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node's link leads to where matching goes
on when the next letter does not fit, and its count says how many pieces are popped on
the way, so the number of greedy longest-match pieces of a word is read off one walk
over its letters; no piece is ever built."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

#: Words: runs of word characters, and every other visible character by itself.
WORD = r"\w+|[^\w\s]"
#: Most pieces of a vocabulary that is broadcast.
MAX_PIECES = 1 << 20
_CACHE = 400_000
_UNKNOWN = 1 << 40  # added to a word's value when no pieces cover it
_SHIFT = 21  # a code point fits below


class Automaton:
    """``first`` are the pieces that may begin a word, ``inner`` those that may follow."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.child: dict[int, int] = {}
        self.link, self.pops = [-1, -1], [0, 0]
        up, end = [(-1, 0), (-1, 0)], [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                at = root
                for ch in piece:
                    key = (at << _SHIFT) | ord(ch)
                    if key not in self.child:
                        self.child[key] = len(end)
                        up.append((at, ord(ch)))
                        end.append(False)
                    at = self.child[key]
                end[at] = at > 1
        self.link += [-1] * (len(end) - 2)
        self.pops += [0] * (len(end) - 2)
        below: list[list[int]] = [[] for _ in end]
        for v in range(2, len(end)):
            below[up[v][0]].append(v)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for v in below[u]:
                if end[v]:
                    self.link[v], self.pops[v] = 1, 1
                else:
                    z, n = self.link[u], self.pops[u]
                    while z >= 0 and (z << _SHIFT) | up[v][1] not in self.child:
                        n += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.child[(z << _SHIFT) | up[v][1]], n
                todo.append(v)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if the greedy longest match fails somewhere."""
        child, link, pops = self.child, self.link, self.pops
        at = n = 0
        for ch in word:
            c = ord(ch)
            while (at << _SHIFT) | c not in child:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 0
            at = child[(at << _SHIFT) | c]
        while at != 1:
            n += pops[at]
            at = link[at]
            if at < 0:
                return 0
        return n


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces inside one) of a vocabulary file: a sentencepiece
    model (word starts are marked) or byte-level ranks (word starts carry a blank)."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return [x[1:] for x in plain if x.startswith("▁") and len(x) > 1], [x for x in plain if "▁" not in x]
    first, inner = [], []
    with open(path, "rb") as lines:
        for line in lines:
            raw = base64.b64decode(line.split()[0])
            try:
                piece = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            (first if piece.startswith(" ") else inner).append(piece.lstrip(" "))
    return [x for x in first if x], [x for x in inner if x and not x.isspace()]


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        value = self.automaton.count(word) or 1 + _UNKNOWN
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value
        return value


def token_counts(docs: DataFrame, first: list[str], inner: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown``.

    A word that the vocabulary cannot cover is one unknown token, as a whole. A null or
    empty text has no words. Words have no length limit. Only the id and the text are
    read, so other columns may have any name. The vocabulary is broadcast; above
    ``MAX_PIECES`` pieces that is an error."""
    if len(first) + len(inner) > MAX_PIECES:
        raise ValueError(f"vocabulary of more than {MAX_PIECES} pieces")
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(first, inner))
    find = re.compile(WORD).findall

    def run(batches):
        counts = _Counts(shared.value)
        value = counts.__getitem__
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in text_rows(b.column("text")):
                w = find(t)
                total = sum(map(value, w))
                words.append(len(w))
                tokens.append(total % _UNKNOWN)
                unknown.append(total // _UNKNOWN)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
