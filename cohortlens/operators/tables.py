"""Small literal tables (configuration as data)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, schema: Sequence[tuple[str, str]], rows: Iterable[Sequence]) -> DataFrame:
    """A constant table; its size is known to the optimizer, which broadcasts it."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(n for n, _ in schema)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in schema)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
