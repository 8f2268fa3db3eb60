import random
import re

import pytest

from cohortlens.llm import jaccard
from cohortlens.llm.graph import components

from .conftest import HARD


def sets(texts, k):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(rows, k, p):
    s = sets([r[1] for r in rows], k)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= p * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    key = lambda r: (r[0] is None, r[0] or 0)
    return sorted((*key(r), len(s[i]), str(least.get(root(i)) if s[i] else r[0])) for i, r in enumerate(rows))


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("k,p", [(3, 90), (5, 80)])
def test_hard_cases(hard, k, p):
    assert result(jaccard.jaccard_classes(hard, k, p)) == brute(HARD, k, p)


def test_chains_and_hot_groups(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [random.choice(words) for _ in range(60)]
    for i in range(150):
        w = list(base)
        for _ in range(random.randrange(9)):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((1000 - i, " ".join(w)))
        if i % 10 == 0:
            base = w
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard.jaccard_classes(df, 3, 70)) == brute(rows, 3, 70)


def test_tree_prunes_no_link():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    made = [np.unique(rng.choice(pool[a : a + 60], 50, replace=False)) for a in rng.integers(0, 240, 80)]
    tree = jaccard.Tree(np.array([jaccard.bitmap(u, jaccard.BITS) for u in made]), np.array([len(u) for u in made]))
    left = {(min(p), max(p)) for p in jaccard.traverse(tree, tree, 1, 2)}
    for i in range(80):
        for j in range(i):
            if 2 * len(np.intersect1d(made[i], made[j])) >= len(np.union1d(made[i], made[j])):
                assert (j, i) in left
    assert len(left) < 80 * 81 / 2


def test_first_of_classes(hard):
    out = jaccard.first_of_classes(hard, jaccard.jaccard_classes(hard)).collect()
    assert [r.doc_id for r in out if r.text and r.text.startswith("Alpha")] == [6]
    assert sorted(str(r.doc_id) for r in out if not (r.text or "").strip()) == ["1", "2", "3", "None"]


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (300, None)]
    edges += [(random.randrange(400, 500), random.randrange(400, 500)) for _ in range(60)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in list(up)}


def test_empty(empty):
    assert jaccard.jaccard_classes(empty).count() == 0
