import hashlib
from collections import Counter

from cohortlens.llm import repeats

from .conftest import HARD


def brute(texts, width):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + width] for b in bodies for s in range(len(b) - width + 1))
    out = []
    for b in bodies:
        covered = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                covered[s : s + width] = b"\1" * width
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and covered[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((len(b), tuple(spans), hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, tuple((x.lo, x.hi) for x in r.removed), r.kept_sha256) for r in df.collect())


def expected(rows, width):
    return sorted((i is None, i or 0, *x) for (i, *_), x in zip(rows, brute([r[1] for r in rows], width)))


def test_hard_cases(hard):
    for width, gram in ((200, 64), (20, 8)):
        assert result(repeats.remove_repeats(hard, width, gram)) == expected(HARD, width)


def test_edges_of_passages(spark):
    import random

    random.seed(5)
    make = lambda n: "".join(random.choice("abcdefgh ijklmnop") for _ in range(n))
    shared, other = make(400), make(90)
    rows = [(i, make(random.randrange(300)) + shared[random.randrange(150) : 400 - random.randrange(150)] + make(50) + other[i % 40 :]) for i in range(40)]
    rows += [(40 + i, rows[i][1][:100] + "#" + rows[i][1][101:]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.remove_repeats(df, 60, 16)) == expected(rows, 60)


def test_long_text_is_looked_at_in_parts(spark):
    import random

    random.seed(1)
    body = "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700_000))
    rows = [(1, body), (2, "." + body[300_000:300_500] + "."), (3, body[-250:])]
    got = {r.doc_id: [(x.lo, x.hi) for x in r.removed] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(300_000, 300_500), (699_750, 700_000)], 2: [(1, 501)], 3: [(0, 250)]}


def test_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0
