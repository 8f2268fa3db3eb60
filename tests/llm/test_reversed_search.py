"""Ranked search against a plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import reversed_search

from .conftest import HARD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, n_all = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for r, (i, w) in enumerate(split):
            tf = Counter(w)
            m = 75 + 25 * len(w) * n_docs // max(n_all, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, r, i))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def random_tables():
    random.seed(4)
    words = ["a", "B", "naïve", "Ünder", "x1", "the", "of", "日本", "z_y", "don't"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(random.choices(words, k=n))
    docs = [(i if i % 17 else None, text(random.randrange(0, 40))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(r[0], r[1]) for r in HARD]
    items = [(i, text(random.randrange(0, 15))) for i in range(30)] + [(3, docs[5][1]), (None, "the THE of"), (40, None), (41, ""), (42, " !?"), (43, HARD[11][1]), (44, "absent")]
    return docs, items


def test_against_brute_force(spark, random_tables):
    docs, items = random_tables
    assert rows_of(reversed_search.ranked(*frames(spark, docs, items))) == brute(docs, items)
    assert rows_of(reversed_search.ranked(*frames(spark, docs, items), k=3)) == brute(docs, items, 3)


def test_blocks_and_pieces_of_any_size_give_the_same_rows(spark, random_tables, monkeypatch):
    docs, items = random_tables
    want = brute(docs, items)
    monkeypatch.setattr(reversed_search, "POSTINGS", 100)
    assert len(list(reversed_search.blocks(frames(spark, docs, items)[1]))) > 2
    assert rows_of(reversed_search.ranked(*frames(spark, docs, items))) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms_of_bytes_are_terms_of_letters(text):
    body = text.encode("utf-8", "replace")
    want = [t.encode() for t in terms(body.decode())]
    assert [t for part in reversed_search.term_lists(body) for t in part] == want


def test_pieces_of_a_long_text(monkeypatch):
    text = HARD[11][1] + " " + "x" * 500 + " end"
    monkeypatch.setattr(reversed_search, "_PIECE", 64)
    got = list(reversed_search.term_lists(text.encode()))
    assert len(got) > 100 and [t.decode() for part in got for t in part] == terms(text)


def test_an_item_with_too_many_terms_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reversed_search, "MOST", 3)
    docs, items = frames(spark, [(1, "a b")], [(1, "a b c d")])
    with pytest.raises(ValueError):
        reversed_search.ranked(docs, items)


def test_empty_tables_and_clashing_columns(spark, hard, empty):
    items = spark.createDataFrame([(1, "alpha beta", 2, 3, "y")], "item_id long, text string, score int, rank int, item string")
    assert reversed_search.ranked(empty, items).count() == 0
    assert reversed_search.ranked(hard, items.limit(0)).count() == 0
    rows = [(r[0], r[1]) for r in HARD]
    assert rows_of(reversed_search.ranked(hard, items)) == brute(rows, [(1, "alpha beta")])
