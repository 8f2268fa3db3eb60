"""Registry, table access, and the frames derived from the shared tables.

Each derived frame has a Spark form (a method of :class:`Tables`) and a SQL form (an
entry of :data:`CTE`), so that a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import strict

REGISTRY: dict[str, "Entry"] = {}


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[["Tables"], DataFrame]
    body: str | None
    ctes: tuple[str, ...] = ()

    @property
    def sql(self) -> str | None:
        """The SQL twin with its CTEs; complete once all modules are loaded."""
        return with_ctes(self.body, self.ctes) if self.body else None


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query under ``name``; ``sql`` may use the named CTEs."""

    def wrap(fn: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ctes)
        return fn

    return wrap


def with_ctes(sql: str, ctes: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the named CTEs and what they build on, in order."""
    names: list[str] = []

    def add(n: str) -> None:
        for dep in CTE_DEPS.get(n, ()):
            add(dep)
        if n not in names:
            names.append(n)

    for n in ctes:
        add(n)
    body = sql.strip()
    if not names:
        return body
    head = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in names)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


class Tables:
    """The shared tables of one directory as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = strict(spark)
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def entity_units(self) -> DataFrame:
        """Entity = part, unit = order, side = supplier nation, cohort = part type,
        exposure = quantity; whole-number counters, so sums are exact."""
        flag = lambda test: F.when(test, 1.0).otherwise(0.0)
        return (
            self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_orderkey").alias("unit"),
                F.col("l_partkey").alias("entity"),
                F.col("p_name").alias("entity_name"),
                F.col("s_nationkey").alias("side"),
                F.col("p_type").alias("cohort"),
                F.col("l_quantity").alias("minutes"),
                F.col("l_linenumber").cast("double").alias("shots"),
                flag(F.col("l_returnflag") == "R").alias("goals"),
                flag(F.col("l_linestatus") == "F").alias("saves"),
                (F.col("p_size") + F.col("l_linenumber")).cast("double").alias("passes"),
                F.col("p_size").cast("double").alias("passes_accurate"),
                (F.col("l_linenumber") + 3).cast("double").alias("duels"),
                F.col("l_linenumber").cast("double").alias("duels_won"),
                flag(F.col("l_returnflag") == "A").alias("yellow"),
                flag((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("red"),
                F.round(F.col("l_discount") * 100).alias("rating"),
            )
        )

    def units(self) -> DataFrame:
        """One row per order as a two-side unit: home/away customer and nation, goals,
        league (priority digit), season (order year), status and window flags."""
        date = F.col("o_orderdate")
        between = lambda lo, hi: (date >= F.lit(lo).cast("timestamp_ntz")) & (date < F.lit(hi).cast("timestamp_ntz"))
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("unit"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("league"),
            F.year(date).alias("season"),
            F.col("o_custkey").alias("home_id"),
            (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("away_id"),
            F.col("c_nationkey").alias("home"),
            ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away"),
            ((F.floor("o_totalprice") + F.col("c_nationkey")) % 4).cast("int").alias("home_goals"),
            (F.floor(F.col("o_totalprice") / 10) % 4).cast("int").alias("away_goals"),
            date.alias("ts"),
            F.when(F.col("o_orderstatus") == "F", "FT")
            .when(F.col("o_orderstatus") == "O", "AET")
            .otherwise("NS")
            .alias("status"),
            (F.col("o_orderpriority") != "5-LOW").alias("official"),
            between("1996-01-01", "1998-01-01").alias("in_current"),
            between("1997-01-01", "1999-01-01").alias("in_pre"),
        )

    def associations(self) -> DataFrame:
        """Which supplier (entity) belonged to which customer (side) in which league
        and season: distinct pairs from the order lines."""
        o = self.orders.select(
            "o_orderkey",
            F.col("o_custkey").alias("side"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("league"),
            F.year("o_orderdate").alias("season"),
        )
        return (
            self.lineitem.select("l_orderkey", F.col("l_suppkey").alias("entity"))
            .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("entity", "league", "season", "side")
            .distinct()
        )

    def details(self) -> DataFrame:
        """Exposure rows of a supplier in an order; several per pair."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("unit"),
            F.col("l_suppkey").alias("entity"),
            F.col("l_quantity").alias("minutes"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.when(F.col("l_linestatus") == "F", "startXI").otherwise("substitutes").alias("source"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_shipdate").alias("shipped"),
        )


CTE: dict[str, str] = {
    "eu": """
SELECT l_orderkey AS unit, l_partkey AS entity, p_name AS entity_name, s_nationkey AS side,
  p_type AS cohort, l_quantity AS minutes, CAST(l_linenumber AS DOUBLE) AS shots,
  CASE WHEN l_returnflag='R' THEN 1e0 ELSE 0e0 END AS goals,
  CASE WHEN l_linestatus='F' THEN 1e0 ELSE 0e0 END AS saves,
  CAST(p_size + l_linenumber AS DOUBLE) AS passes, CAST(p_size AS DOUBLE) AS passes_accurate,
  CAST(l_linenumber + 3 AS DOUBLE) AS duels, CAST(l_linenumber AS DOUBLE) AS duels_won,
  CASE WHEN l_returnflag='A' THEN 1e0 ELSE 0e0 END AS yellow,
  CASE WHEN l_returnflag='N' AND l_linestatus='F' THEN 1e0 ELSE 0e0 END AS red,
  round(l_discount * 100) AS rating
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "u": """
SELECT o_orderkey AS unit, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS league,
  CAST(year(o_orderdate) AS INTEGER) AS season, o_custkey AS home_id,
  o_custkey + 1 + o_orderkey % 3 AS away_id, c_nationkey AS home,
  CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS away,
  CAST((CAST(floor(o_totalprice) AS BIGINT) + c_nationkey) % 4 AS INTEGER) AS home_goals,
  CAST(CAST(floor(o_totalprice / 10) AS BIGINT) % 4 AS INTEGER) AS away_goals,
  o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'FT' WHEN 'O' THEN 'AET' ELSE 'NS' END AS status,
  o_orderpriority <> '5-LOW' AS official,
  o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AS in_current,
  o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AS in_pre
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "assoc": """
SELECT DISTINCT l_suppkey AS entity, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS league,
  CAST(year(o_orderdate) AS INTEGER) AS season, o_custkey AS side
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "det": """
SELECT l_orderkey AS unit, l_suppkey AS entity, l_quantity AS minutes, l_linenumber AS line,
  l_partkey AS part, CASE WHEN l_linestatus='F' THEN 'startXI' ELSE 'substitutes' END AS source,
  l_returnflag AS flag, l_shipdate AS shipped
FROM lineitem""",
}
CTE_DEPS: dict[str, tuple[str, ...]] = {}
