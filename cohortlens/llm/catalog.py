"""The operators bound to the shared tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import alignment, chat, decontaminate, jaccard, knn, licences, linededup, mixing, repeats, reversed_search, tokencount, toxicity, warc
from .common import settle, tuned

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(fn):
    _QUERIES[fn.__name__] = lambda spark, folder: fn(tuned(spark), folder)
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of `documents` covered by a 200-byte string that starts anywhere else."""
    out = repeats.remove_repeats(_table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + (x["hi"] - x["lo"])).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
    )


@_query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of `documents` over links of Jaccard >= 0.9 on 3-word shingles."""
    out = jaccard.jaccard_classes(_table(spark, folder, "documents"), k=3, p=90, q=100)
    return out.select("doc_id", "n_shingles", "component_id")


@_query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` mixed to source weights 1, 2, 3."""
    out = mixing.mix(_table(spark, folder, "documents").select("doc_id", "source", "text"), keep=("doc_id",))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


_SQL["op7_source_mixing"] = mixing.sql()


@_query
def op8_warc_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """`pages` written as WARC records, read back and assembled by capture."""
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    rows = warc.captures(settle(warc.read_archives(spark, path, payload=False)))
    revisit = F.col("capture.record_type") == "revisit"
    own = lambda name: F.when(revisit, F.col(f"origin.capture.{name}")).otherwise(F.col(f"capture.{name}"))
    return rows.select(
        F.get("metadata", F.lit(0))["fields"]["page-id"].try_cast("long").alias("page_id"),
        own("payload_bytes").alias("payload_bytes"), own("payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(revisit, F.get("origin.metadata", F.lit(0))["fields"]["page-id"].try_cast("long")).alias("refers_to"),
        F.col("capture.target_uri").alias("url"),
    )


@_query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` scored by the grammar; labels of held-out rows are never read."""
    out = toxicity.scored(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"), keep=["doc_id"])
    return out.select("row.doc_id", "held_out", "score", "predicted")


@_query
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Five best integer inner products of every fiftieth vector."""
    return knn.top_k(_table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@_query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and covered license notices of `documents`."""
    out = licences.scan(_table(spark, folder, "documents"))
    joined = lambda c: F.array_join(c, ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), "score"
    )


#: Vocabulary of the token counts; a path on every machine that plans the query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy longest-match pieces of every text of `documents`."""
    return tokencount.token_counts(_table(spark, folder, "documents"), *tokencount.load_pieces(PIECES))


#: The vocabularies that are aligned; paths on the machine that plans the query.
BYTE_BPE, SENTENCE_PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenisations of every text of `documents`."""
    return alignment.alignment(_table(spark, folder, "documents"), alignment.load_files(BYTE_BPE, SENTENCE_PIECES))


@_query
def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """`conversations` in the chat template, read back from the output."""
    return chat.digests(_table(spark, folder, "conversations"))


_SQL["op12_chat_formatting"] = chat.sql()


@_query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty best `documents` for each item of `benchmark`."""
    return reversed_search.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


_SQL["op13_ranked_search"] = reversed_search.sql()


@_query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of `benchmark`, with the items."""
    hits = decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return hits.select(F.col("doc").alias("doc_id"), "item_id", "cosine", "share", "answered", "first_word")


@_query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of `documents` that go because a near or equal line stands before them."""
    docs = _table(spark, folder, "documents")
    gone = settle(linededup.removed_lines(docs))
    right = gone.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), "n_lines", "removed")
    own = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    joined = own.join(right, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("removed", none).alias("removed"))


_SQL["op3_exact_top_k"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS n FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score, c.n AS m FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST, m) AS rk FROM s) WHERE rk <= 5"""

_SQL["op8_warc_assembly"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS b FROM pages),
h AS (SELECT *, sha1(b) AS x FROM p),
d AS (SELECT page_id, url, strlen(b) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url FROM f"""

_SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [len(w) || '|' || array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: '3|' || w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
