"""Streaming forms: change discovery, keyed upserts and host health.

Every sink is foreachBatch into a versioned state; a batch that is replayed
after a failure finds its number in the newest commit and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import merge as M
from strandline.operators.layered import LayeredTable, retried
from strandline.operators.versions import VersionedSite

#: How long a host stays marked, in seconds.
GONE_S, UNREACHABLE_S = 30 * 86_400, 30 * 60
FEED = "slug string, rev_no bigint, ts bigint, author bigint"


def feed_stream(spark: SparkSession, path: str, files_per_batch: int = 50) -> DataFrame:
    """Captured feed pages (JSON lines) as a stream."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_stream(stream: DataFrame, state: VersionedSite, keys: list[str], order: Column, rules: dict[str, Callable], checkpoint: str, buckets: int = 8):
    """Keep one row a key, merged by rules; within a batch the last by order wins. Returns the running query.

    The state lies in buckets of the key's hash, a table each: a batch rewrites those it touches, in one
    commit whose note is the batch's number. A batch that is replayed finds its number there.
    """
    columns = stream.columns

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        known = state.numbers()
        if known and int(state.note()) >= batch_id:
            return
        delta = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).persist()
        old = state.tables() if known else {}
        touched = sorted(r["_bucket"] for r in delta.select("_bucket").distinct().collect())  # at most as many as buckets
        changed = {}
        for k in touched:
            own = delta.where(F.col("_bucket") == k).drop("_bucket")
            changed[f"bucket{k}"] = M.upsert(old[f"bucket{k}"], own, keys, rules) if f"bucket{k}" in old else own
        if changed:
            state.commit(changed, note=str(batch_id))
        delta.unpersist()

    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def layer_stream(stream: DataFrame, state: LayeredTable, keys: list[str], order: Column, rules: dict[str, Callable], checkpoint: str):
    """As upsert_stream(), into a table in layers: a batch writes its own keys' rows, and not the buckets that they lie in.

    The number of the batch is the note of its commit. A stream is its table's only writer of notes; other writers of
    other keys may commit between its batches. Returns the running query.
    """
    columns = stream.columns

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        done = [int(n) for n in (state.note(v) for v in reversed(state.numbers())) if n is not None and n.isdigit()][:1]
        if done and done[0] >= batch_id:
            return
        delta = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*").persist()
        if not delta.isEmpty():
            retried(state, lambda change: change.upsert(delta, rules), note=str(batch_id))
        delta.unpersist()

    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_state(state: VersionedSite) -> DataFrame:
    """All buckets of one pinned version."""
    tables = list(state.tables().values())
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def newest_wins(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def mark_hosts(state: DataFrame, marks: DataFrame, now: int) -> DataFrame:
    """host, health, until. marks: host, health ('gone' or 'unreachable'). A mark lasts its time; gone is never downgraded while it lasts."""
    ttl = F.when(F.col("health") == "gone", F.lit(GONE_S)).otherwise(F.lit(UNREACHABLE_S))
    fresh = marks.groupBy("host").agg(F.min("health").alias("health")).select("host", "health", (F.lit(now) + ttl).cast("long").alias("until"))
    still_gone = lambda _: ~((F.col("o.health") == "gone") & (F.col("o.until") > now) & (F.col("n.health") != "gone"))
    return M.upsert(state, fresh, ["host"], {"health": M.keep_new, "until": M.keep_new}, where=still_gone)


def health(state: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """host and health now: a mark that has run out counts as alive."""
    live = state.where(F.col("until") > now).select("host", "health")
    return hosts.join(live, "host", "left").select("host", F.coalesce("health", F.lit("alive")).alias("health"))
