"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records over (shard, bucket) by seeded hashes; the
number of buckets follows the table's bytes, so that a bucket fits in memory.
Pass two shuffles each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates),
numbers its records after those of the shard's earlier buckets and writes them.

Law ``key``: a record's shard is the one whose hash with doc_id is greatest
(rendezvous hashing): only doc_id and the shard count decide, and one more
shard takes records only into itself. Equal texts spread like any others.

Buckets are cut by a hash of the whole record, so no copy group, source or
other key can swell one. Rows that are equal in all columns are counted before
anything moves, and each of them gets a number of its own that takes part in
the hash: they spread as well. The order does not depend on the input's layout.

Defined cases: null text: size 1, CRC-32 of the empty string; null doc_id: its
shard is that of the text 'null'; repeated rows: each gets its own slot. Columns
must be of types that can be grouped by (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandline.llm.common import rows_of, small, table, whole_row
from strandline.session import shared_folder

SHARDS = 16
BUCKET_BYTES = 8 << 20
SEED = 20_240_301
#: Equal rows that one row of the first expansion stands for.
COPIES = 1_000
#: Buckets that one row of the upper level of the offsets stands for.
GROUP = 1_024


def rendezvous(key: Column, shards: int) -> Column:
    """The shard with the greatest hash of (key, shard)."""
    weights = F.array(*(F.struct(F.xxhash64(key, F.lit(SEED), F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)))
    return F.array_max(weights)["s"]


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def whole_hash(documents: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns))


def numbered(documents: DataFrame) -> DataFrame:
    """(row, copy): documents' rows as structs; copy is 0, and 1, 2, ... for further rows that are equal in all columns."""
    spark = documents.sparkSession
    rows = documents.select(whole_hash(documents).alias("whole"), whole_row(documents).alias("row"))
    repeats = table(spark, rows.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole"))
    none = F.lit(0).cast("long").alias("copy")
    if not rows_of(repeats):
        return rows.select("row", none)
    alone = rows.join(small(repeats), "whole", "left_anti").select("row", none)
    counted = rows.join(small(repeats), "whole", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("block")).repartition("block", F.xxhash64("row"))
    copies = blocks.select("row", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)).alias("copy"))
    return alone.unionByName(copies)


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """(_shard, _bucket, _offset): rows in the shard's earlier buckets, by running sums of groups of buckets and inside them."""
    grouped = counts.withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    upper = grouped.groupBy("_shard", "_group").agg(F.sum("_n").alias("_n"))
    before = lambda *keys: Window.partitionBy("_shard", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("_shard", "_group", F.coalesce(F.sum("_n").over(before("_group")), F.lit(0)).alias("_start"))
    inner = grouped.withColumn("_within", F.coalesce(F.sum("_n").over(before("_group", "_bucket")), F.lit(0)))
    return inner.join(upper, ["_shard", "_group"]).select("_shard", "_bucket", (F.col("_start") + F.col("_within")).alias("_offset"))


def shuffled(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, _size, _crc, _shard, _slot, _grown): documents' rows as structs in the shuffled order inside each shard."""
    key = doc_key(F.col("row.doc_id"))
    total = documents.agg(F.sum(text_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    text = F.col("row.text")
    order = F.xxhash64(F.xxhash64(*(F.col(f"row.`{c}`") for c in documents.columns)), "copy", F.lit(seed))
    sized = numbered(documents).withColumns({"_size": text_size(text), "_crc": text_crc(text), "_shard": rendezvous(key, shards), "_grown": rendezvous(key, shards + 1), "_order": order})
    placed = sized.withColumn("_bucket", F.pmod(F.xxhash64("_order", F.lit(seed)), F.lit(buckets)).cast("int"))
    # Offsets come from hashes alone; no text is read for them twice.
    offsets = bucket_offsets(placed.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    record = F.struct("_order", "copy", "row", "_size", "_crc", "_shard", "_grown")
    # The generator behind shuffle() runs through a partition's rows: with a fixed number of
    # partitions, and both the rows and the records in them sorted, every run gives the same order.
    dealt = placed.repartition(shards * buckets, "_shard", "_bucket")
    gathered = dealt.groupBy("_shard", "_bucket").agg(F.collect_list(record).alias("_rows"))
    ordered = F.array_sort("_rows", lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).when(a["copy"] < b["copy"], -1).when(a["copy"] > b["copy"], 1).otherwise(0))
    placed_rows = gathered.join(offsets, ["_shard", "_bucket"]).sortWithinPartitions("_shard", "_bucket")
    mixed = placed_rows.select("_offset", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("_at", "_row"))
    return mixed.select("_row.row", "_row._size", "_row._crc", "_row._shard", (F.col("_offset") + F.col("_at")).cast("long").alias("_slot"), "_row._grown")


def external_shuffle(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """shuffled() with documents' columns side by side, and _size, _crc, _shard, _slot, _grown instead of theirs of those names."""
    own = ("_size", "_crc", "_shard", "_slot", "_grown")
    return shuffled(documents, shards, seed, bucket_bytes).select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in own), *own)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The shuffled records as Parquet, a folder a shard, in slot order within each file; read back as row (a struct of documents' columns), _shard and _slot."""
    rows = shuffled(documents, shards, seed, bucket_bytes).select("row", "_shard", "_slot")
    rows.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    schema = StructType([StructField("row", documents.select(whole_row(documents).alias("row")).schema["row"].dataType), StructField("_slot", LongType()), StructField("_shard", IntegerType())])
    return documents.sparkSession.read.schema(schema).parquet(path)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = write_shards(documents, shared_folder(spark, "shards"))
    return written.select(
        "row.doc_id",
        text_size(F.col("row.text")).alias("size"),
        text_crc(F.col("row.text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        rendezvous(doc_key(F.col("row.doc_id")), SHARDS + 1).cast("int").alias("grown_shard"),
    )


QUERIES = {"op9_sharding": op9}

ORACLE: dict[str, str] = {}
