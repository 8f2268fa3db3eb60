import random

from cohortlens.llm import decontaminate

from .test_lines_and_benchmark import line


def test_short_items_are_found_inside_long_documents(spark):
    random.seed(31)
    items = [(i, line(n)) for i, n in enumerate([6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20] * 4)]
    docs, want = [], set()
    for i, text in items:
        w = line(200).split()
        at = random.randrange(len(w))
        docs.append((i, " ".join([*w[:at], text, *w[at:]])))
        want.add((i, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hits = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc, r.item_id) for r in hits.collect() if r.share == 1.0}
    # Brute force: the words of an item in a row.
    brute = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    assert want <= brute
    print(len(got & brute), len(brute))
    assert len(got & brute) >= 0.97 * len(brute)
