"""The archive's tables, read off the driver's: columns and types are fixed here, never inferred.

Each view has its SQL twin in ``SQL`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("rev_no"),
        F.concat(F.lit("r"), F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
        F.col("role").alias("author"),
        F.when(F.col("turn") % 3 != 2, F.col("text")).alias("content"),
    )


def denied_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where("turn % 6 = 5").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("rev_no"), F.lit("forbidden").alias("reason"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages, read off customer: some without updated_at, some with broken tags."""
    c = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        c.alias("page_id"),
        F.lower(F.translate("c_name", "#", "-")).alias("slug"),
        F.col("c_name").alias("title"),
        F.when(c % 11 == 0, F.lit("[broken")).otherwise(F.concat(F.lit('["'), F.lower("c_mktsegment"), F.lit('","n'), F.col("c_nationkey"), F.lit('"]'))).alias("tags"),
        F.when(c % 4 != 0, c * 60).alias("updated_at"),
        (c * 10).alias("discovered_at"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    saved = d % 3 == 0
    return _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://"), F.when(d % 2 == 0, F.lit("www.")).otherwise(F.lit("")), F.col("source"), F.lit(".example.org/local--files/p"), d % 50, F.lit("/f"), d % 97, F.lit(".png"), F.when(d % 7 == 0, F.lit("|junk")).otherwise(F.lit(""))).alias("path"),
        F.when(saved, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"),
        F.when(saved, F.octet_length("text").cast("long")).alias("size"),
        F.when(saved, F.lit("saved")).when(d % 3 == 1, F.lit("missing")).otherwise(F.lit("pending")).alias("status"),
        d.alias("first_seen"),
        F.when(saved, F.lit("image/png")).alias("content_type"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("page.sync")).otherwise(F.lit("file.fetch")).alias("kind"),
        F.concat(F.lit('{"id":'), F.col("o_custkey"), F.lit("}")).alias("payload"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"),
        F.when(k % 17 == 0, F.lit("dead")).when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("running")).alias("status"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("run_at"),
        (k % 9).alias("attempts"),
        F.when(k % 10 == 0, F.lit(0)).otherwise(F.lit(8)).cast("long").alias("max_attempts"),
        F.when(k % 17 == 0, F.concat(F.lit("error "), k)).alias("last_error"),
    )


def out_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last publication packed: some pages absent, some behind, some without a hash."""
    r = revisions(spark, sf_dir).groupBy("page_id").agg(F.count("content").alias("c"))
    p = F.col("page_id")
    return r.where("page_id % 5 <> 0").select("page_id", (F.col("c") - F.when(p % 3 == 0, 1).otherwise(0)).alias("packed_revs"), F.when(p % 4 != 0, F.sha2(p.cast("string"), 256)).alias("archive_sha256"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed: ts in seconds, a row a change."""
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("slug"), F.col("event_id").alias("rev_no"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("author"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages")


SQL = {
    "revisions": """(SELECT conv_id AS page_id, turn AS rev_no, 'r' || (conv_id * 1000 + turn) AS rev_id, conv_id * 1000 + turn AS ts, role AS author,
      CASE WHEN turn % 3 <> 2 THEN text END AS content FROM conversations)""",
    "denied": "(SELECT conv_id AS page_id, turn AS rev_no, 'forbidden' AS reason FROM conversations WHERE turn % 6 = 5)",
    "pages": """(SELECT c_custkey AS page_id, lower(translate(c_name, '#', '-')) AS slug, c_name AS title,
      CASE WHEN c_custkey % 11 = 0 THEN '[broken' ELSE '["' || lower(c_mktsegment) || '","n' || c_nationkey || '"]' END AS tags,
      CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 60 END AS updated_at, c_custkey * 10 AS discovered_at FROM customer)""",
    "files": """(SELECT 'http://' || CASE WHEN doc_id % 2 = 0 THEN 'www.' ELSE '' END || source || '.example.org/local--files/p' || (doc_id % 50) || '/f' || (doc_id % 97) || '.png'
        || CASE WHEN doc_id % 7 = 0 THEN '|junk' ELSE '' END AS path,
      CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 3 = 0 THEN strlen(text) END AS size,
      CASE WHEN doc_id % 3 = 0 THEN 'saved' WHEN doc_id % 3 = 1 THEN 'missing' ELSE 'pending' END AS status, doc_id AS first_seen,
      CASE WHEN doc_id % 3 = 0 THEN 'image/png' END AS content_type FROM documents)""",
    "jobs": """(SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'page.sync' ELSE 'file.fetch' END AS kind, '{"id":' || o_custkey || '}' AS payload,
      CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
      CASE WHEN o_orderkey % 17 = 0 THEN 'dead' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
      CAST(epoch(o_orderdate) AS BIGINT) AS run_at, o_orderkey % 9 AS attempts, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 8 END::BIGINT AS max_attempts,
      CASE WHEN o_orderkey % 17 = 0 THEN 'error ' || o_orderkey END AS last_error FROM orders)""",
    "feed": "(SELECT 'u' || user_id AS slug, event_id AS rev_no, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS author FROM events)",
}
SQL["out_state"] = f"""(SELECT page_id, c - CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS packed_revs, CASE WHEN page_id % 4 <> 0 THEN sha256(page_id::VARCHAR) END AS archive_sha256
  FROM (SELECT page_id, count(content) AS c FROM {SQL['revisions']} GROUP BY page_id) WHERE page_id % 5 <> 0)"""
