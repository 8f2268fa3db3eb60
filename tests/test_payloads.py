"""Nested payloads: which blocks are written, and by how many tasks."""

from pyspark.sql import functions as F

from cohortlens.catalog import load, payloads
from cohortlens.functions import scalar as X


def test_payloads_are_spread_and_hold_the_blocks_asked_for(tables, monkeypatch):
    monkeypatch.setattr(payloads, "LINES_PER_TASK", 1000)
    monkeypatch.setattr(payloads, "_WRITTEN", {})
    lines = tables.lineitem.count()
    some = payloads.unit_payloads(tables, "events", "fixture")
    assert some.columns == ["fixture", "events"] and some.count() == lines
    sizes = [r["count"] for r in some.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= lines // 1000 and max(sizes) <= 1100
    whole = payloads.unit_payloads(tables)
    assert whole.columns == list(payloads.S.UNIT_FIELDS)
    one, other = (df.select(F.to_json(F.struct("fixture", "events")).alias("v")) for df in (some, whole))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_outcome_rows_need_no_written_payloads(tables, monkeypatch):
    def written(*_):
        raise AssertionError("payloads are written")

    monkeypatch.setattr(payloads, "_WRITTEN", {})
    monkeypatch.setattr(payloads, "scratch_path", written)
    for name in ("F16_unit_outcome_row", "K32_event_benchmark"):
        assert load()[name].build(tables).count()


def test_entries_give_what_the_map_gives(spark):
    rows = [([("Shots", "1"), ("shots!", "2%"), (None, "3"), ("Fouls", "n/a")],), ([],), (None,), ([("corners", "4")],)]
    df = spark.createDataFrame(rows, "a array<struct<type: string, value: string>>")
    both = df.select(*[f(g("a"), *n) for f, g in ((X.pick, X.stats_map), (X.pick_entry, X.stats_entries)) for n in (("shots",), ("fouls", "corners"), ("none",))])
    assert all(r[:3] == r[3:] for r in map(tuple, both.collect()))
    assert tuple(both.first())[:3] == (2.0, None, None)
