"""What is learned from the documents is learned from all of them."""

import random

import numpy as np

from cohortlens.llm import decontaminate, toxicity

from .test_lines_and_benchmark import line


def weights(texts, idf):
    """The TF-IDF passages of texts, one row each."""
    rows = []
    for _, f in decontaminate._row_words(decontaminate.pa.array(texts, decontaminate.pa.string())):
        for x, y in decontaminate._cut(len(f)):
            v = np.bincount(f[x:y], minlength=decontaminate.FEATURES) * idf
            rows.append(v / np.sqrt(v @ v))
    return np.array(rows)


def test_space_of_texts_is_that_of_their_passages(spark):
    random.seed(3)
    texts = [line(n) for n in (1, 5, 24, 25, 48, 49, 72, 73, 200)] + [None, "", " . "]
    idf = np.random.default_rng(4).random(decontaminate.FEATURES) + 0.5
    a = weights(texts, idf)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    space = decontaminate.corpus_space(frame.repartition(3), idf).astype(float)
    left = a @ space
    used = left[:, np.abs(left).sum(axis=0) > 0]
    assert used.shape[1] == len(a)
    assert np.allclose(used.T @ used, np.eye(len(a)), atol=1e-3)


def test_every_document_is_in_the_fit(spark, monkeypatch):
    seen, search = [], decontaminate._search
    monkeypatch.setattr(decontaminate, "_search", lambda shared: seen.append(shared.value) or search(shared))
    texts = [f"own{i} {line(8)}" for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, line(20))], "item_id long, text string")
    decontaminate.contaminated(docs, items).collect()
    (_, _, space), = seen
    own = [int(f[0]) for _, f in decontaminate._row_words(decontaminate.pa.array(texts))]
    assert (np.abs(space[own]).sum(axis=1) > 0).all()


def test_all_accepted_stems_are_kept(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + "zz" for a in letters for b in letters for c in letters][:2000]
    rows = [(i, " ".join(rng.sample(words, len(words))), 1) for i in range(12)] + [(12 + i, f"plain text {i}", 0) for i in range(60)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "doc long, text string, y int"))
    assert set(stems) == set(words)


def test_model_is_fitted_on_all_training_rows(spark):
    rng = random.Random(6)
    kinds = ["you are an idiot.", "not an idiot.", "he said idiot.", "i will kill you.", "a fine day.", "idiot and scum."]
    rows = [(i, text, int(rng.random() < (0.1, 0.6)["idiot." in text])) for i in range(24000) for text in [f"{rng.choice(kinds)} {rng.choice(kinds)}"]]
    beta = np.array(toxicity.fit(spark.createDataFrame(rows, "doc long, text string, y int").repartition(5), {}))
    grammar = toxicity.Grammar({})
    made = {text: [1.0, *grammar.features(text)] for text in {t for _, t, _ in rows}}
    x, y = np.array([made[t] for _, t, _ in rows]), np.array([y for *_, y in rows])
    grad = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.array([0.01] + [0.5] * 6) * beta
    assert np.abs(grad[beta > 0]).max() < 0.5 and abs(grad[0]) < 0.5 and grad[beta <= 0][1:].max(initial=-1) < 0.5
