"""Alignment of two tokenisations against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from cohortlens.llm import alignment

from .conftest import HARD

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def files():
    return alignment.load_files(A, B)


def brute(rows):
    """Contract columns of (id, text) rows, token by token."""
    ta = tokenizers.Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    level = tokenizers.decoders.ByteLevel()
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()
    docs, pairs = [], Counter()
    for i, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in ta.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        elif "�" not in text:
            assert level.decode([ta.id_to_token(x) for x in a]) == " " + text
        a_ends, b_ends = (np.cumsum([len(x) for x in y], dtype=int).tolist() for y in (a_bytes, b_bytes))
        cuts = sorted(set(a_ends) & set(b_ends))
        a_at, b_at = ({e: k for k, e in enumerate(ends)} for ends in (a_ends, b_ends))
        links = [(a[a_at[c]], b[b_at[c]]) for c in cuts]
        shown, x, y = [], 0, 0
        for c in cuts:
            shown.append(f"{','.join(map(str, a[x : a_at[c] + 1]))}|{','.join(map(str, b[y : b_at[c] + 1]))}")
            x, y = a_at[c] + 1, b_at[c] + 1
        pairs.update(links)
        docs.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if cuts else ""))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        (str((i, na, nb, ng, len(links), sum(pairs[x] == top[x[1]] for x in links), sum(pairs[x] for x in links), sha)) for i, na, nb, ng, links, sha in docs)
    )


def rows_of(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_whole_query_against_brute_force(spark, files, monkeypatch):
    rows = [(r[0], r[1]) for r in HARD if r[0] not in (8, 9)]
    rows += [(100, "plain </s> [INST] <|endoftext|> <0x0A> <s> text"), (101, "lower▁one eighth"), (102, "日本語のテキスト 🦆 and more"), (103, " leading  blanks \n\n\tand\x00 zero "), (104, "don't we'll I'm x's"), (105, "é   　 ﬁ ½")]
    rows += [(200 + i, t) for i, t in enumerate(["the cat sat on the mat", "the cat sat on the mat", "The Cat; the dog, the end."])]
    got = rows_of(alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), files))
    assert got == brute(rows)


def test_small_chunks_give_the_same_rows(spark, files, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert rows_of(alignment.alignment(docs, files)) == want


def test_long_texts_are_cut_at_boundaries_of_both(files, monkeypatch):
    text = " ".join(x for r in HARD[:8] for x in [r[1] or ""]) + " It's 12 o'clock, isn't it? naïve words … a b c d e 日本 語 x y z " * 40
    whole = alignment.Coder(files).encode([text])
    monkeypatch.setattr(alignment, "AT_ONCE", 20)
    code = alignment.Coder(files)
    assert len(list(code.parts(text))) > 50
    for x, y in zip(whole, code.encode([text])):
        assert x.tolist() == y.tolist()


def test_the_fast_encoder_gives_the_same_ids(files):
    code = alignment.Coder(files)
    assert code._fast is not None
    slow = lambda texts: [x.ids for x in code._a.encode_batch(texts, add_special_tokens=False)]
    texts = []
    for c in map(chr, range(0x250)):
        texts += [f"{x}{c}{y}" for x in ("", "a", " ", "7", "'", "\n ", "..") for y in ("", "b ", "  x", "9", "'ll", c, "\u00a0", "!")]
    rng = np.random.default_rng(5)
    common = list("abE  \n\t.,'79-\u00e9\u00a0\x85\x1c\u00df")
    texts += ["".join(rng.choice(common, 30)) for _ in range(3000)] + ["a" * 3000, " " * 3000, "<|endoftext|> x"]
    texts += [r[1] for r in HARD if r[1]]
    assert code.a_ids(texts) == slow(texts)
    rare = ["\u65e5\u672c", "\U0001f986 x", "\u0250", "plain", ""]
    assert code.a_ids(rare) == slow(rare) and alignment._RARE.search(rare[2]) and not alignment._RARE.search("\u024f\x00")


def test_coalescing_of_any_intervals():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cut = lambda: np.unique(np.append(rng.integers(1, 40, rng.integers(1, 12)), 40))
        a_end, b_end = cut(), cut()
        a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
        ga, gb = alignment.coalesce(a_start, a_end, b_start, b_end)
        both = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        assert [int(np.searchsorted(both, e, "left")) for e in a_end] == ga.tolist() and [int(np.searchsorted(both, e, "left")) for e in b_end] == gb.tolist()
        i, j = alignment.overlaps(a_start, a_end, b_start, b_end)
        want = [(x, y) for x in range(len(a_end)) for y in range(len(b_end)) if a_start[x] < b_end[y] and b_start[y] < a_end[x]]
        assert list(zip(i.tolist(), j.tolist())) == want and all(ga[x] == gb[y] for x, y in want)


def test_groups_hold_every_token_once(spark, files, hard, empty):
    rows = alignment.groups(hard.where("doc_id in (6, 8, 10)"), files).orderBy("doc_id", "part").collect()
    code = alignment.Coder(files)
    for i, t in [(r[0], r[1]) for r in HARD if r[0] in (8, 10)]:
        own = [r for r in rows if r.doc_id == i]
        a, b, *_ = code.encode([t])
        assert [x for r in own for x in r.a] == a.tolist() and [x for r in own for x in r.b] == b.tolist()
        body = (" " + t).encode()
        assert [r.part for r in own] == list(range(len(own))) and own[0].lo == 0 and own[-1].hi == len(body)
        for r in own:
            assert b"".join(code.a_bytes[x] for x in r.a) == b"".join(code.b_bytes[x] for x in r.b) == body[r.lo : r.hi]
    assert alignment.groups(empty, files).count() == 0


def test_hard_cases_and_empty_tables(spark, files, hard, empty):
    got = alignment.alignment(hard, files)
    assert got.count() == hard.count() and all(r.n_a == 0 and r.groups_sha256 == "" for r in got.where("doc_id in (1, 2)").collect())
    assert alignment.alignment(empty, files).count() == 0
