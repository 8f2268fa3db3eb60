"""Licences, token counts, toxicity."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import licences, tokencount, toxicity

from .conftest import HARD


def base_phrases(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in licences.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), sorted({x for _, x in hits})


def test_licences(spark, hard):
    pieces = [p for p, _ in licences.PHRASES] + [t for _, t in licences.TEMPLATES] + ["the", "license", "cc", "by", "gnu general public", "mit mit license", "Apache-License", "ÉTÉ cc by-nc", "of the", "\n"]
    random.seed(2)
    rows = [(i, " ".join(random.choice(pieces) for _ in range(random.randrange(12)))) for i in range(200)]
    rows += [(1000 + i, r[1]) for i, r in enumerate(HARD)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_phrases(text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert licences.scan(hard).count() == hard.count()


@pytest.mark.parametrize("label,text", licences.TEMPLATES)
def test_a_template_is_covered(label, text):
    row = licences.Scanner().document(f"some words before {text} and after".encode())
    assert label in row["labels"] and row["score"] == 1.0
    cut = text.split()
    if len(cut) > 20:  # a word changed in the middle is chained over
        row = licences.Scanner().document(" ".join(cut[:10] + ["changed"] + cut[11:]).encode())
        assert label in row["labels"]


def test_matching_statistics():
    random.seed(6)
    lists = [[random.randrange(4) for _ in range(n)] for n in (1, 2, 7, 15, 30)]
    a = licences.SuffixAutomaton(lists)
    parts = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    text = [random.randrange(5) for _ in range(400)]
    s = n = 0
    for i, w in enumerate(text):
        s, n = a.step(s, n, w)
        assert n == max((m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m : i + 1]) in parts))
        for t, end in a.ends[s]:
            if n:
                assert lists[t][end - n + 1 : end + 1] == text[i + 1 - n : i + 1]


def greedy(word, first, inner):
    at, n, vocabulary = 0, 0, first
    while at < len(word):
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in vocabulary), 0)
        if not stop:
            return 0
        at, n, vocabulary = stop, n + 1, inner
    return n


def test_longest_match_automaton():
    random.seed(9)
    for _ in range(60):
        make = lambda: {"".join(random.choice("abc") for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 12))}
        first, inner = make(), make()
        a = tokencount.Automaton(first, inner)
        for _ in range(80):
            word = "".join(random.choice("abcd" if random.random() < 0.1 else "abc") for _ in range(random.randint(1, 14)))
            assert a.count(word) == greedy(word, first, inner), (word, first, inner)


def test_token_counts(spark, hard, empty):
    first, inner = {"a", "al", "alpha", "w", "one", "two", "line", "s"}, {"a", "b", "eta", "word", "ne", "l", "ame", "ine"}
    rows = sorted(map(str, tokencount.token_counts(hard, list(first), list(inner)).collect()))
    want = []
    for i, t, *_ in HARD:
        counts = [greedy(w, first, inner) for w in re.findall(tokencount.WORD, t or "")]
        want.append(f"Row(doc_id={i}, n_words={len(counts)}, n_tokens={sum(c or 1 for c in counts)}, n_unknown={counts.count(0)})")
    assert rows == sorted(want)
    assert tokencount.token_counts(empty, ["a"], []).count() == 0


def test_a_public_vocabulary_agrees_with_a_public_word_piece_model():
    tokenizers = pytest.importorskip("tokenizers")
    first, inner = tokencount.load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    vocabulary = {"[UNK]": 0} | {x: i + 1 for i, x in enumerate([*first, *("##" + x for x in inner)])}
    model = tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=1000)
    a = tokencount.Automaton(first, inner)
    for w in "the antidisestablishmentarianism naïve Straße ciónas pathetic x1y2 日本語 réeuxment".split():
        pieces = model.tokenize(w)
        assert (a.count(w) or 1) == len(pieces)


def toxic_frames(spark):
    random.seed(11)
    vocabulary = [f"{a}{b}" for a in ("tion", "sha", "wer", "lan", "pre", "kol") for b in ("ing", "ed", "er", "ol", "am", "ut", "is")]
    docs, labels = [], []
    for i in range(1200):
        w = [random.choice(vocabulary) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(1, 4)):
                w.insert(random.randrange(60), random.choice(["idiot", "moron", "vrunk" + random.choice(["al", "or", "isch"]), "skibble"]))
        if i % 50 < 6:  # copies of one toxic passage
            w = ["copied", "passage", "of", "words"] * 3 + w if toxic else w
        docs.append((i, " ".join(w) + ". " + "End of it.\n"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_frames(spark)
    stems = toxicity.learn_stems(toxicity.training_rows(docs, labels))
    assert {"vrunk", "skibble"} <= set(stems) and not {"copied", "passage"} & set(stems)
    rows = toxicity.scored(docs, labels).select("row.doc_id", "held_out", "score", "predicted").join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert 300 < len(out) < 500
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == (r.predicted == 1) for r in rows)
    # Labels of held-out rows are not read.
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(docs, other).select("row.doc_id", "score")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.score) for r in rows)


def test_clauses():
    g = toxicity.Grammar({})
    f = lambda t: dict(zip(toxicity.FEATURES, g.features(t)))
    assert f("you are an idiot")["direct"] > 0 and f("an idiot walks")["plain"] > 0
    assert f("you are not an idiot")["negated"] > 0 and f("you are not an idiot")["direct"] == 0
    assert f("he said you are an idiot")["reported"] > 0 and f("He said so. You are an idiot.")["direct"] > 0
    assert f("i will kill you")["threat"] > 0 and f("kill the lights")["threat"] == 0
    assert not any(f("").values()) and not any(f("plain words only").values())


def test_toxicity_hard_cases(spark, hard, empty):
    _, labels = toxic_frames(spark)
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (6, 1, None), (7, 1, 1), (7, 1, 0)], labels.schema))
    for docs in (hard, empty):
        for given in (odd, labels.limit(0)):
            rows = toxicity.scored(docs, given).collect()
            assert len(rows) == docs.count() and all(r.predicted == 0 for r in rows)
