"""Scalar expressions: cleaning, guarded arithmetic, labels.

Everything here is a ``Column -> Column`` function, so the work stays in the JVM.
"""

from __future__ import annotations

import unicodedata

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# A decimal literal as Python's float() reads it; Java's "1d"/"1f" suffixes are excluded.
_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


_NUMBER_TYPES = ("double", "float", "bigint", "int", "smallint", "tinyint")


def _is_number(col: Column) -> Column:
    """Known when the plan is analysed, so the branch not taken is folded away."""
    return F.typeof(col).isin(*_NUMBER_TYPES)


def to_number(col: Col) -> Column:
    """Text to double; anything that is not a number becomes null. Numbers pass."""
    v = c(col)
    text = v.cast("string")
    return F.when(_is_number(v), v.try_cast("double")).otherwise(
        F.when(text.rlike(_NUMERIC), F.trim(text).try_cast("double"))
    )


def to_number0(col: Col) -> Column:
    """As :func:`to_number`, ``%`` removed, and 0 instead of null."""
    v = c(col)
    plain = F.replace(v.cast("string"), F.lit("%"), F.lit(""))
    value = F.when(_is_number(v), v.try_cast("double")).otherwise(
        F.when(plain.rlike(_NUMERIC), F.trim(plain).try_cast("double"))
    )
    return F.coalesce(value, F.lit(0.0))


def to_bool(col: Col) -> Column:
    text = F.lower(F.trim(c(col).cast("string")))
    return F.coalesce(text.isin("true", "1", "yes", "y"), F.lit(False))


def finite(col: Col) -> Column:
    """NaN and infinities to null: done once where data enters."""
    v = c(col).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def finite_or_zero(col: Col) -> Column:
    return F.coalesce(finite(col), F.lit(0.0))


def safe_ratio(num: Col, den: Col, zero: bool = False) -> Column:
    """num/den where den > 0 and finite; otherwise null (or 0 with ``zero``)."""
    d = finite(den)
    out = F.when(d > 0, c(num) / d)
    return F.coalesce(out, F.lit(0.0)) if zero else out


def accurate_count(total: Col, accuracy: Col) -> Column:
    """Count of successes from a field that holds either a count or a percentage."""
    t = to_number0(total)
    text = c(accuracy).cast("string")
    raw = to_number0(accuracy)
    share = t * raw / 100.0
    return (
        F.when(t <= 0, 0.0)
        .when(text.contains("%"), share)
        .when(raw <= 0, 0.0)
        .when(raw <= t, raw)
        .when(raw <= 100, share)
        .otherwise(F.least(raw, t))
    )


def clip(col: Col, lo: float | Column | None, hi: float | Column | None) -> Column:
    """Bound to [lo, hi]; null stays null (least/greatest alone would skip it)."""
    v = c(col)
    out = v
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(v.isNotNull(), out)


def event_minute(elapsed: Col, extra: Col) -> Column:
    return c(elapsed) + F.coalesce(c(extra), F.lit(0))


def null_aware_sum(*cols: Col) -> Column:
    """Sum of the present values; null when none is present."""
    values = [c(x).cast("double") for x in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(reduce(lambda a, b: a | b, [v.isNotNull() for v in values]), total)


def null_aware_array_sum(array: Col) -> Column:
    present = F.filter(c(array), lambda x: x.isNotNull())
    return F.when(
        F.size(present) > 0,
        F.aggregate(present, F.lit(0.0), lambda a, x: a + x.cast("double")),
    )


def stats_entries(array: Col, key: str = "type", value: str = "value") -> Column:
    """array<struct<type, value>> -> array<struct<key, value>> by normalised key; bad values
    become null, entries without a key go."""
    keyed = F.transform(
        c(array),
        lambda s: F.struct(
            normalise_key(s[key]).alias("key"),
            to_number(F.replace(s[value].cast("string"), F.lit("%"), F.lit(""))).alias("value"),
        ),
    )
    return F.filter(keyed, lambda s: s["key"].isNotNull())


def stats_map(array: Col, key: str = "type", value: str = "value") -> Column:
    """:func:`stats_entries` as a map. A repeated key keeps its last entry."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.aggregate(
        stats_entries(array, key, value),
        empty,
        lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["key"]), F.create_map(s["key"], s["value"])),
    )


def pick_entry(entries: Col, *names: str) -> Column:
    """:func:`pick` on :func:`stats_entries`, without making a map of them."""
    own = lambda n: F.try_element_at(F.filter(c(entries), lambda s: s["key"] == n), F.lit(-1))["value"]
    return F.coalesce(*[own(n) for n in names])


def pick(mapping: Col, *names: str) -> Column:
    """First present key of a map."""
    return F.coalesce(*[F.try_element_at(c(mapping), F.lit(n)) for n in names])


def normalise_key(col: Col) -> Column:
    """Lower case, every run of other characters to one blank; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(c(col)), "[^a-z0-9]+", " "))


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose compatibility decomposition leaves plain ASCII: those that leave one
    character, what they leave, and (letter, text) of those that leave several."""
    one, plain, many = [], [], []
    for code in range(0x80, 0x10000):
        letter = chr(code)
        left = "".join(x for x in unicodedata.normalize("NFKD", letter) if ord(x) < 128).lower()
        if left.isalnum() and letter == letter.lower():
            if len(left) == 1:
                one.append(letter)
                plain.append(left)
            elif unicodedata.name(letter, "").startswith("LATIN"):
                many.append((letter, left))
    return "".join(one), "".join(plain), many


_ACCENTED, _PLAIN, _SEVERAL = _folds()


def fold_accents(col: Col) -> Column:
    """Lower case without accents, by compatibility decomposition; a letter with no plain
    form is dropped later, as are combining marks."""
    out = F.translate(F.lower(c(col)), _ACCENTED, _PLAIN)
    for letter, text in _SEVERAL:
        out = F.replace(out, F.lit(letter), F.lit(text))
    return F.regexp_replace(out, r"[\u0300-\u036f]", "")


def normalise_text(col: Col) -> Column:
    """Accent-folded words separated by single blanks."""
    kept = F.regexp_replace(fold_accents(col), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(kept, "[^a-z0-9]+", " "))


def slug(col: Col) -> Column:
    """As :func:`normalise_text` joined with ``-``; empty text becomes ``unknown``."""
    text = F.regexp_replace(F.coalesce(normalise_text(col), F.lit("")), " ", "-")
    return F.when(text == "", "unknown").otherwise(text)


def grid_part(grid: Col, index: int) -> Column:
    part = F.split(c(grid), ":", 2)
    return F.try_element_at(part, F.lit(index + 1))


def parse_grid(grid: Col) -> Column:
    """``"r:c"`` -> struct(row, col); null unless both parts are whole numbers."""
    row = F.trim(grid_part(grid, 0)).try_cast("int")
    col = F.trim(grid_part(grid, 1)).try_cast("int")
    return F.when(row.isNotNull() & col.isNotNull(), F.struct(row.alias("row"), col.alias("col")))


def parse_ts(col: Col) -> Column:
    """ISO-8601 with Z/offset, or epoch seconds; naive text is taken as UTC."""
    text = c(col).cast("string")
    return F.when(text.rlike(r"^[0-9]{9,11}$"), F.timestamp_seconds(text.try_cast("long"))).otherwise(
        text.try_cast("timestamp")
    )


def keyword_flag(col: Col, words: Sequence[str]) -> Column:
    lowered = F.lower(F.coalesce(c(col), F.lit("")))
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def bucketise(
    col: Col, edges: Sequence[float], labels: Sequence[str], right: bool = True, include_lowest: bool = False
) -> Column:
    """Interval label: right-closed (lo, hi] by default, left-closed [lo, hi) otherwise."""
    v = c(col)
    out: Column | None = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right:
            low_ok = (v >= lo) if (include_lowest and i == 0) else (v > lo)
            test = low_ok & (v <= hi)
        else:
            test = (v >= lo) & (v < hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def per_exposure(col: Col, exposure: Col, unit: float = 90.0) -> Column:
    return F.when(c(exposure) > 0, c(col) * unit / c(exposure)).otherwise(0.0)


def logistic_unit(z: Col, bound: float = 8.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -bound, bound)))


def weighted_composite(role: Col, weights: Mapping[str, Mapping[str, float]], base: float = 0.5) -> Column:
    """Sum of weight x dimension with the weights of the row's role; any missing
    dimension makes the result null. The dimension ``base`` is the constant ``base``."""
    out: Column | None = None
    for name, parts in weights.items():
        total = reduce(
            lambda a, b: a + b,
            [F.lit(w) * (F.lit(base) if dim == "base" else F.col(dim)) for dim, w in parts.items()],
        )
        out = F.when(c(role) == name, total) if out is None else out.when(c(role) == name, total)
    return out


def reason_precedence(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first rule that holds."""
    out: Column | None = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(default))


def outcome_label(home: Col, away: Col) -> Column:
    return F.when(c(home) > c(away), "H").when(c(home) == c(away), "D").when(c(home) < c(away), "A")


def winner(home: Col, away: Col, home_name: Col, away_name: Col) -> Column:
    return F.when(c(home) > c(away), c(home_name)).when(c(home) < c(away), c(away_name)).otherwise(F.lit("draw"))


def scoreline(home: Col, away: Col) -> Column:
    return F.concat_ws("-", c(home).cast("string"), c(away).cast("string"))


def to_local(ts: Col, zone: Col) -> Column:
    return F.from_utc_timestamp(c(ts), c(zone))


def extract_year(col: Col) -> Column:
    return F.coalesce(F.regexp_extract(c(col), r"(\d{4})", 1).try_cast("int"), F.lit(0))


def coverage_flags(seasons: Col, year: Col, flags: Sequence[str]) -> list[Column]:
    """Flags of the season element that matches ``year``; absent means false."""
    hit = F.try_element_at(F.filter(c(seasons), lambda s: s["year"] == c(year)), F.lit(1))
    return [F.coalesce(hit["coverage"][f], F.lit(False)).alias(f"coverage_{f}") for f in flags]
