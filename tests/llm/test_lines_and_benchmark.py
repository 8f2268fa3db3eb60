import random


from cohortlens.llm import decontaminate, linededup

from .conftest import HARD

WORDS = [a + b + c for a in ("tion", "sha", "wer", "lan", "pre", "kol", "mi") for b in ("ing", "ed", "er", "ol", "am") for c in ("a", "o", "st", "ly")]


def line(n=20):
    return " ".join(random.choice(WORDS) for _ in range(n))


def shingle_set(text):
    w, out, at = text.split(" "), set(), 0
    for x in w:
        out.add(text[at : at + linededup.SHINGLE])
        at += len(x) + 1
    return out


def brute_lines(rows, percent=80):
    """Removed places by row, over links between all pairs of lines."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    lines = [(r[0], k, " ".join(x.split()).lower()) for r in order for k, x in enumerate((r[1] or "").split("\n")) if x.strip()]
    s = [shingle_set(x) for *_, x in lines]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    gone = {}
    for i, (doc, k, _) in enumerate(lines):
        if root(i) != i:
            gone.setdefault(doc, []).append(k)
    return gone


def test_fuzzy_lines(spark):
    random.seed(8)
    common = [line(25) for _ in range(12)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(3)]
        for c in random.sample(common, 3):
            w = c.split()
            for _ in range(random.randrange(3)):
                w[random.randrange(len(w))] = random.choice(WORDS)
            own.insert(random.randrange(3), random.choice(["", "  "]) + "  ".join(w) if random.random() < 0.2 else " ".join(w).capitalize())
        rows.append((i, "\n".join(own + [""])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: list(r.removed) for r in linededup.removed_lines(df).collect() if r.removed}
    want = brute_lines(rows)
    lost = sum(len(set(want.get(d, ())) ^ set(got.get(d, ()))) for d in {*want, *got})
    assert lost <= 0.02 * sum(map(len, want.values()))
    text = {r.doc_id: r.text for r in linededup.without_lines(df, linededup.removed_lines(df)).collect()}
    for d, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if k not in got.get(d, ())]
        assert text.get(d, "") == "\n".join(kept) or not any(x.strip() for x in kept)


def test_line_hard_cases(spark, hard, empty):
    gone = linededup.removed_lines(hard)
    rows = {r.doc: r for r in gone.where("doc = 12").collect()}
    assert list(rows[12].removed) == [1, 2, 3, 4] and rows[12].n_lines == 5
    out = linededup.without_lines(hard, gone)
    assert out.columns == hard.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[12] == ("same line here again", 20) and texts[1] == (None, None) and texts[2] == ("", 0)
    assert linededup.removed_lines(empty).count() == 0 and linededup.without_lines(empty, linededup.removed_lines(empty)).count() == 0


def leak_frames(spark):
    random.seed(21)
    items = [(i, line(random.randint(24, 60))) for i in range(30)]
    docs, planted = [], {}
    for d in range(150):
        w = line(random.randint(30, 300)).split()
        if d % 3 == 0:
            i, text = random.choice(items)
            own = text.split()
            if d % 2:  # a paraphrase: some words replaced, left out or put in
                for _ in range(len(own) // 12):
                    own[random.randrange(len(own))] = random.choice(WORDS)
                own.pop(random.randrange(len(own)))
                own.insert(random.randrange(len(own)), random.choice(WORDS))
            at = random.randrange(len(w))
            w[at:at] = own
            planted[d] = i
        docs.append((d, " ".join(w)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), planted


def test_leaks_are_found_and_clean_documents_stay(spark):
    docs, items, planted = leak_frames(spark)
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    want = set(planted.items())
    assert len(got & want) >= 0.95 * len(want)
    assert not {d for d, _ in got} - set(planted)
    left = decontaminate.without(docs, decontaminate.contaminated(docs, items))
    assert {r.doc_id for r in left.collect()} == set(range(150)) - {d for d, _ in got}


def test_common_length():
    random.seed(3)
    for _ in range(50):
        a, b = ([random.randrange(5) for _ in range(random.randint(1, 20))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                row[i + 1][j + 1] = row[i][j] + 1 if a[i] == b[j] else max(row[i][j + 1], row[i + 1][j])
        assert decontaminate.common_length(a, b) == row[-1][-1]


def test_latent_space_is_orthonormal_and_close_to_the_svd(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = (rng.random((40, 6)) @ rng.random((6, 30))) * (rng.random((40, 30)) < 0.9)
    rows = [(i, j, float(a[i, j])) for i in range(40) for j in range(30) if a[i, j]]
    v = decontaminate.latent_space(spark.createDataFrame(rows, "pid long, f int, w double"))[:30].astype(float)
    used = v[:, np.abs(v).sum(axis=0) > 0]
    assert np.allclose(used.T @ used, np.eye(used.shape[1]), atol=1e-4)
    assert np.linalg.norm(a - a @ used @ used.T) < 1e-3 * np.linalg.norm(a) + np.linalg.svd(a)[1][used.shape[1] :].sum() + 1e-3


def test_benchmark_hard_cases(spark, hard, empty):
    items = spark.createDataFrame([(1, HARD[6][1]), (None, HARD[6][1]), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(hard, items).collect()}
    assert got == {(d, i) for d in (6, 7, None) for i in (1, None)}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(hard, items.limit(0)).count() == 0
