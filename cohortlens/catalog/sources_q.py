"""Source and sink queries. What must lie in files is first written by Spark from the
shared tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import io
from ..sources.ledger import Ledger
from .base import query


def _write_envelopes(t):
    """One envelope per line. A third of the lines write numbers as they are declared, a
    third as text, a third with a fraction; beside them stand a broken document and one
    without a response."""
    path = scratch_path(t.spark, "envelopes")
    n, text = F.col("l_linenumber"), lambda c: c.cast("string")

    def envelopes(part, unit, shots, passes):
        stat = F.struct(F.struct(shots.alias("total")).alias("shots"), F.struct(passes.alias("total"), F.lit("80%").alias("accuracy")).alias("passes"))
        man = F.struct(F.struct(F.col("l_partkey").alias("id")).alias("player"), F.array(stat).alias("statistics"))
        side = F.struct(F.struct(F.col("l_suppkey").alias("id")).alias("team"), F.array(man).alias("players"))
        doc = F.struct(F.struct(unit.alias("id"), F.struct(F.col("l_linestatus").alias("short")).alias("status")).alias("fixture"), F.array(side).alias("players"))
        return t.lineitem.where(n % 3 == part).select(F.to_json(F.struct(F.array(doc).alias("response"))).alias("value"))

    plain = envelopes(0, F.col("l_orderkey"), n, n * 10)
    worded = envelopes(1, text(F.col("l_orderkey")), text(n), F.when(n == 4, "n/a").otherwise(text(n * 10)))
    broken = envelopes(2, F.col("l_orderkey").cast("double"), n.cast("double"), n.cast("double") * 10)
    plain.union(worded).union(broken).write.text(f"{path}/good")
    t.region.limit(1).select(F.explode(F.array(F.lit('{"response": ['), F.lit('{"errors": "none"}'), F.lit("[1, 2"))).alias("value")).write.text(f"{path}/bad")
    return [f"{path}/good", f"{path}/bad"]


@query(
    "S1_read_envelope_json",
    """SELECT l_orderkey AS fixture_id, l_linestatus AS status, CAST(l_partkey AS BIGINT) AS player, CAST(l_linenumber AS INTEGER) AS shots,
  CAST(CASE WHEN l_linenumber<>4 THEN l_linenumber*10 END AS INTEGER) AS passes, '80%' AS accuracy FROM lineitem""",
)
def _(t):
    units = io.read_envelope_json(t.spark, _write_envelopes(t), lines=True)
    man = F.col("players")[0]["players"][0]
    stat = man["statistics"][0]
    return units.select(
        F.col("fixture.id").alias("fixture_id"), F.col("fixture.status.short").alias("status"), man["player"]["id"].alias("player"),
        stat["shots"]["total"].alias("shots"), stat["passes"]["total"].alias("passes"), stat["passes"]["accuracy"].alias("accuracy"),
    )


@query(
    "S1_rejects",
    """SELECT 'no json' AS reason, CAST(2 AS BIGINT) AS n, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS "rows"
UNION ALL SELECT 'no response', 1, (SELECT count(*) FROM lineitem)""",
)
def _(t):
    paths = _write_envelopes(t)
    kept = io.read_envelope_json(t.spark, paths, lines=True).agg(F.count(F.lit(1)).alias("rows"))
    out = io.envelope_rejects(t.spark, paths, lines=True).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return out.join(kept, F.lit(True)).select("reason", "n", "rows")


@query(
    "S2_read_glob_union",
    """SELECT l_orderkey AS unit, l_suppkey AS entity, CASE WHEN l_linestatus='F' THEN l_quantity END AS minutes, CASE WHEN l_linestatus='F' THEN 'starts' ELSE 'bench' END AS src FROM lineitem""",
)
def _(t):
    path = scratch_path(t.spark, "globs")
    a = t.lineitem.where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("minutes"), "l_tax")
    b = t.lineitem.where(F.col("l_linestatus") == "O").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity"))
    io.write_table(a, f"{path}/starts", "csv")
    io.write_table(b, f"{path}/bench", "csv")
    out = io.read_glob_union(
        t.spark,
        [(f"{path}/starts/*.csv.gz", "unit bigint, entity bigint, minutes double, l_tax double"), (f"{path}/bench/*.csv.gz", "unit bigint, entity bigint")],
        ["unit", "entity", "minutes"],
    )
    src = F.when(F.col("source_file").contains("/starts/"), "starts").otherwise("bench")
    return out.select("unit", "entity", "minutes", src.alias("src"))


@query(
    "S3_conform_columns",
    "SELECT o_orderkey AS unit, o_totalprice AS amount, CASE WHEN o_orderstatus='P' THEN 'none' ELSE o_orderstatus END AS status, CAST(0 AS DOUBLE) AS minutes FROM orders",
)
def _(t):
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("fixture"), F.col("o_totalprice").cast("string").alias("price"), F.nullif("o_orderstatus", F.lit("P")).alias("state")
    )
    return io.conform_columns(
        raw,
        {
            "unit": (["unit", "fixture"], "bigint", None), "amount": (["amount", "price"], "double", 0.0),
            "status": (["status", "state"], "string", "none"), "minutes": (["minutes", "min"], "double", 0.0),
        },
    )


@query("S4_require_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    return io.require_columns(t.orders, ["o_orderkey", "o_custkey"], "orders").select("o_orderkey", "o_custkey")


@query(
    "S5_source_inventory",
    """SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'players' WHEN 'N' THEN 'lineups' ELSE 'other' END AS kind, count(*) AS "rows", count(DISTINCT l_suppkey) AS entities, count(DISTINCT l_orderkey) AS units, sum(l_quantity) AS exposure
FROM lineitem GROUP BY ALL""",
)
def _(t):
    path = scratch_path(t.spark, "inventory")
    io.write_table(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag"), path, partition_by=["l_returnflag"])
    rows = t.spark.read.parquet(path).select("*", F.regexp_extract(F.col("_metadata.file_path"), "l_returnflag=([A-Z])", 1).alias("flag"))
    rules = [(F.col("flag") == "A", "players"), (F.col("flag") == "N", "lineups")]
    return io.source_inventory(rows, "flag", "l_suppkey", "l_orderkey", "l_quantity", rules)


@query("S6_write_table", "SELECT n_nationkey, n_name, n_regionkey, 'csv' AS fmt FROM nation UNION ALL SELECT c_custkey, c_name, c_nationkey, 'json' FROM customer")
def _(t):
    path = scratch_path(t.spark, "tables")
    io.write_table(t.nation, f"{path}/csv", "csv")
    io.write_table(t.customer.select("c_custkey", "c_name", "c_nationkey"), f"{path}/json", "json")
    a = t.spark.read.schema("n_nationkey bigint, n_name string, n_regionkey int").option("header", True).csv(f"{path}/csv")
    b = t.spark.read.schema("c_custkey bigint, c_name string, c_nationkey int").json(f"{path}/json")
    return a.withColumn("fmt", F.lit("csv")).union(b.withColumn("fmt", F.lit("json")))


@query(
    "S2_rejects",
    """SELECT 'unreadable' AS reason, CAST(1 AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS "rows" FROM orders""",
)
def _(t):
    path = scratch_path(t.spark, "broken")
    io.write_table(t.orders.select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("minutes")), f"{path}/good", "csv")
    files = t.spark.sparkContext
    fs_path = files._jvm.org.apache.hadoop.fs.Path
    to = fs_path(f"{path}/odd/cut.csv.gz")
    stream = to.getFileSystem(files._jsc.hadoopConfiguration()).create(to)
    stream.write(bytearray(b"\x1f\x8b\x08\x00\x00"))
    stream.close()
    groups = [(f"{path}/good/*.csv.gz", "unit bigint, minutes double"), (f"{path}/odd/*.csv.gz", "unit bigint")]
    kept = io.read_glob_union(t.spark, groups, ["unit"]).agg(F.count(F.lit(1)).alias("rows"))
    return io.glob_rejects(t.spark, groups).groupBy("reason").agg(F.count(F.lit(1)).alias("files")).join(kept, F.lit(True)).select("reason", "files", "rows")


_DIGEST_WORDS = ", ".join(f"sum(CAST('0x'||substr(h,{1 + i * 15},15) AS BIGINT)::HUGEINT) AS w{i}" for i in range(5))


@query(
    "S7_content_digest",
    f"""SELECT lang, sha256(concat_ws(',', "rows", w0, w1, w2, w3, w4)) AS digest, "rows" FROM (
  SELECT lang, count(*) AS "rows", {_DIGEST_WORDS} FROM (
    SELECT lang, sha256('{{"doc_id":'||doc_id||',"n_chars":'||n_chars||',"source":"'||source||'","text":'||CAST(to_json(text) AS VARCHAR)||'}}') AS h FROM documents) GROUP BY lang)""",
)
def _(t):
    return io.content_digest(t.documents, ["lang"], ["source", "doc_id", "n_chars", "text"])


@query("S8_file_manifest")
def _(t):
    files = io.file_manifest(t.spark, f"{t.folder}/*.parquet")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes", "sha256")


@query(
    "S9_inline_hourly",
    """SELECT s_suppkey, h AS hour, CASE WHEN s_suppkey%5<>0 THEN s_acctbal+h END AS temperature, CASE WHEN s_suppkey%7<>0 THEN CAST(h%2 AS DOUBLE) END AS rain
FROM supplier, (SELECT unnest(range(0,24)) AS h)""",
)
def _(t):
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h.cast("bigint"))
    temp = F.when(F.col("s_suppkey") % 5 != 0, F.transform("hours", lambda h: F.col("s_acctbal") + h)).otherwise(F.array(F.lit(1.0)))
    rain = F.when(F.col("s_suppkey") % 7 != 0, F.transform("hours", lambda h: (h % 2).cast("double")))
    rows = t.supplier.withColumn("hours", hours).select("s_suppkey", "hours", temp.alias("temperature"), rain.alias("rain"))
    return io.inline_hourly(rows, ["s_suppkey"], "hours", ["temperature", "rain"]).withColumnRenamed("time", "hour")


CTE_LEDGER = """SELECT l_orderkey AS unit, l_shipdate AS updated, l_quantity AS minutes, l_linestatus AS status, l_linenumber AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_returnflag<>'N') WHERE rn=1"""


@query("S10_upsert_ledger", CTE_LEDGER)
def _(t):
    path = scratch_path(t.spark, "lake")
    cols = ["l_orderkey", "l_shipdate", "l_quantity", "l_linestatus", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice"]
    order = [F.col(x).desc() for x in ("l_shipdate", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = t.lineitem.select(*cols)
    retry = F.col("l_returnflag") == "N"
    ledger = Ledger(path, ("l_orderkey",), tuple(order), 16)
    ledger.apply(rows.where(F.col("l_linestatus") == "F"), retry, 0)
    for _ in range(2):  # the second batch comes twice
        ledger.apply(rows.where(F.col("l_linestatus") == "O"), retry, 1)
    return ledger.rows(t.spark).select(
        F.col("l_orderkey").alias("unit"), F.col("l_shipdate").alias("updated"), F.col("l_quantity").alias("minutes"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")
    )
