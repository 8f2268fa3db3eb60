"""The candidate search against every window of every row, checked word by word."""

import random

import numpy as np

from cohortlens.llm import decontaminate

from .test_lines_and_benchmark import line


def brute(rows, items):
    """Hits by the words alone: all blocks, all windows, no list, signature or cosine."""
    d = decontaminate
    split = lambda texts: d._row_words(d.pa.array(texts, d.pa.string()))
    df = np.zeros(d.FEATURES)
    docs = split([t for _, t in rows])
    for _, f in docs:
        df[np.unique(f)] += 1
    idf = np.log((1.0 + len(rows)) / (1.0 + df))
    found = set()
    for item, (w, f) in zip((i for i, _ in items), split([t for _, t in items])):
        for x, y in d._cut(len(f)):
            plans = [(d.BLOCK, d.WINDOWS)] + [(d.FINE, ws) for most, ws in d.SHORT if y - x <= most][:1]
            for (doc, _), (text, _) in zip(rows, docs):
                for size, windows in plans:
                    for at in range(0, len(text), size):
                        for m in windows:
                            near = text[max(0, at - size) : at + (m + 1) * size]
                            share = d.common_length(w[x:y].tolist(), near.tolist()) / (y - x)
                            loose = share >= d.LOOSE and d.common_length(w[-5:].tolist(), near.tolist()) == len(w[-5:])
                            if share >= d.COPY or loose and d.common_weight(w[x:y], near, idf[f[x:y]]) >= d.LOOSE * idf[f[x:y]].sum() - 1e-4:
                                found.add((doc, item))
    return found


def test_search_finds_what_every_window_holds(spark):
    random.seed(5)
    items = [(i, line(n)) for i, n in enumerate([6, 9, 12, 17, 25, 40, 70])]
    rows = []
    for doc in range(60):
        words = line(random.choice([30, 90, 160])).split()
        if doc % 2:
            copy = items[doc % 7][1].split()
            lost = 0 if doc % 3 == 0 else 0.15 if doc % 3 == 1 else 0.35
            kept = [w for w in copy[:-5] if random.random() >= lost] + copy[-5:]
            at = random.randrange(len(words))
            words[at:at] = kept
        rows.append((doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    want = brute(rows, items)
    assert len(want) >= 25 and got <= want
    assert len(got) >= 0.95 * len(want)


def test_function_words_alone_are_no_loose_copy():
    words, weight = np.arange(8, dtype=np.uint64), np.array([5.0, 5, 5, 5, 0.1, 0.1, 0.1, 0.1])
    assert decontaminate.common_weight(words, words[4:], weight) < 1
    assert decontaminate.common_weight(words, words[[0, 2, 1, 3]], weight) == 15


def test_a_very_long_text_is_read_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TILE", 500)
    random.seed(6)
    item = line(30)
    words = line(3000).split()
    for at in (2990, 1490, 499):
        words[at:at] = item.split()
    idf = np.ones(decontaminate.FEATURES, np.float32)
    space = np.random.default_rng(1).normal(size=(decontaminate.FEATURES, decontaminate.LATENT)).astype(np.float32)
    (w, f), (tw, tf) = decontaminate._row_words(decontaminate.pa.array([item, " ".join(words)]))
    searcher = decontaminate.Searcher([(1, w, f, w[-5:].tolist())], idf, space)
    first = {place for _, _, _, share, _, place in searcher.hits(tw, tf, np.array([0, len(tw)])) if share == 1}
    for at in (499, 1520, 3050):
        assert any(abs(at - p) <= 48 for p in first)
