"""The job queue as plans over a jobs table: enqueue, claim, complete, fail, recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.merge import fail_if_missing

#: Kinds whose jobs are appended without a look at what is there and deleted when done.
EPHEMERAL = ("page.sync",)
#: Priority of each kind.
PRIORITIES = {"shell.sync": 35, "discover": 30, "revision.head": 20, "out.update": 18, "page.sync": 15, "file.fetch": 10, "revision.old": 8, "backfill": 5}
MAX_ATTEMPTS = 8
#: Jobs of one site that run at a time.
SITE_JOBS = 4
#: Kinds that reschedule themselves; a site is seeded with one job of each.
PERIODIC = ("shell.sync", "discover", "out.update", "backfill")
#: Rows of claimed ids that apply_claim() broadcasts.
BROADCAST_IDS = 1 << 20


def backoff_seconds(attempts: Column) -> Column:
    """10 s, doubled each attempt after the first, an hour at most."""
    steps = F.greatest(F.lit(0), F.least(F.lit(10), attempts - 1)).cast("int")
    return F.least(F.pow(F.lit(2), steps).cast("long") * 10, F.lit(3600).cast("long"))


def claim(jobs: DataFrame, now: int, limit: int) -> DataFrame:
    """Due pending jobs, by priority, then run_at, then id: now running, one attempt more."""
    due = jobs.where((F.col("status") == "pending") & (F.col("run_at") <= now))
    top = due.orderBy(F.desc("priority"), "run_at", "id").limit(limit)
    return top.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now).cast("long")})


def claim_by_site(jobs: DataFrame, now: int, per_site: int = SITE_JOBS) -> DataFrame:
    """As claim(), for all sites at once (column site): each site has at most per_site jobs running, those that run already included.

    The greatest of each site are found by a ranked filter, which every task applies to its own rows before they
    move: a site with most of all jobs sends per_site rows a task.
    """
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "run_at", "id")
    due = jobs.where((F.col("status") == "pending") & (F.col("run_at") <= now)).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_site)
    busy = jobs.where("status = 'running'").groupBy("site").agg(F.count(F.lit(1)).alias("_busy"))
    free = due.join(busy, "site", "left").where(F.col("_place") <= per_site - F.coalesce("_busy", F.lit(0)))
    return free.select(jobs.columns).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now).cast("long")})


def numbered(new: DataFrame, jobs: DataFrame, first_id: int = 1) -> DataFrame:
    """new (kind, payload, ...; each pair once) with ids of their own: one after another behind the greatest id of jobs, from first_id at least.

    The order is by a hash. Counts by its first 12 bits give every range its first number, so that no task numbers all.
    """
    hashed = new.withColumn("_h", F.xxhash64("kind", "payload")).withColumn("_head", F.shiftright("_h", 52))
    counts = hashed.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_head", F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # 4,096 rows at most
    last = jobs.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(first_id - 1)).cast("long").alias("_last"))
    place = F.row_number().over(Window.partitionBy("_head").orderBy("_h", "kind", "payload"))
    out = hashed.withColumn("_place", place).join(F.broadcast(starts), "_head").crossJoin(F.broadcast(last))  # one row
    return out.withColumn("id", F.col("_last") + F.col("_start") + F.col("_place")).drop("_h", "_head", "_n", "_start", "_last", "_place")


def apply_claim(jobs: DataFrame, claimed: DataFrame, limit: int | None = None) -> DataFrame:
    """The whole table after a claim. limit: the one of the claim; its ids are broadcast only up to BROADCAST_IDS."""
    ids = claimed.select("id")
    ids = F.broadcast(ids) if limit is not None and limit <= BROADCAST_IDS else ids
    return jobs.join(ids, "id", "left_anti").unionByName(claimed.select(jobs.columns))


def periodic_seeds(spark: SparkSession, first_id: int, now: int) -> DataFrame:
    """One job of each periodic kind, to be enqueued when a site is opened: known ones are left alone there."""
    rows = [(first_id + i, kind, "{}", PRIORITIES[kind], now, 0) for i, kind in enumerate(PERIODIC)]
    return spark.createDataFrame(rows, "id long, kind string, payload string, priority long, run_at long, max_attempts long")


def status_report(jobs: DataFrame, files: DataFrame, revisions: DataFrame, now: int) -> DataFrame:
    """metric, value: the console's lines, in one pass a table."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("status").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit(f"{name}."), "status").alias("metric"), "value")

    def spread(row: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns))
        return row.select(F.explode(pairs).alias("p")).select("p.*")

    content = revisions.agg(F.count(F.lit(1)).alias("revisions.known"), F.count("content").alias("revisions.stored"), F.count_distinct("page_id").alias("pages"))
    due = jobs.agg(F.count_if((F.col("status") == "pending") & (F.col("run_at") <= now)).alias("jobs.due"))
    renamed = content.toDF("revisions_known", "revisions_stored", "pages")
    lines = spread(renamed).unionByName(spread(due.toDF("jobs_due")))
    return counted(jobs, "jobs").unionByName(counted(files, "files")).unionByName(lines)


def enqueue(jobs: DataFrame, new: DataFrame, resurrect: bool = False) -> DataFrame:
    """new: id, kind, payload, priority, run_at, max_attempts. Identity is (kind, payload), except for ephemeral kinds.

    A known job is left alone; with resurrect, one that is done or dead becomes
    pending again with the new run_at and priority, no attempts and no error.
    """
    fresh = new.withColumns({"status": F.lit("pending"), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string")}).select(jobs.columns)
    ephemeral = F.col("kind").isin(*EPHEMERAL)
    durable = fresh.where(~ephemeral).dropDuplicates(["kind", "payload"])
    added = durable.join(jobs.where(~ephemeral).select("kind", "payload"), ["kind", "payload"], "left_anti").select(jobs.columns)
    if resurrect:
        wake = durable.select("kind", "payload", F.col("run_at").alias("_run_at"), F.col("priority").alias("_priority"))
        met = jobs.join(wake, ["kind", "payload"], "left")
        back = F.col("_run_at").isNotNull() & F.col("status").isin("done", "dead") & ~ephemeral
        changes = {"run_at": F.col("_run_at"), "priority": F.col("_priority"), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "status": F.lit("pending")}
        jobs = met.select([F.when(back, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns])
    return jobs.unionByName(added).unionByName(fresh.where(ephemeral))


def complete(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """finished: id, resched (null: once). Ephemeral jobs go; periodic ones become pending at resched without an error.

    Attempts stay as they are. A finished id that is no job any more fails the plan when it runs.
    """
    met = jobs.join(finished.select("id", "resched", F.lit(True).alias("_f")), "id", "left")
    met = met.where(~(F.coalesce("_f", F.lit(False)) & F.col("kind").isin(*EPHEMERAL)))
    again = F.col("_f") & F.col("resched").isNotNull()
    status = F.when(again, F.lit("pending")).when(F.col("_f"), F.lit("done")).otherwise(F.col("status"))
    run_at = F.when(again, F.col("resched")).otherwise(F.col("run_at"))
    error = F.when(again, F.lit(None).cast("string")).otherwise(F.col("last_error"))
    out = met.withColumns({"status": status, "run_at": run_at, "last_error": error}).select(jobs.columns)
    return fail_if_missing(out, jobs, finished, ["id"], "jobs vanished before completion: ")


def fail(jobs: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """failed: id, error, permanent. Dead at once if permanent or out of attempts (max_attempts 0: never), else pending after a backoff.

    A failed id that is no job any more fails the plan when it runs.
    """
    met = jobs.join(failed.select("id", "error", "permanent", F.lit(True).alias("_f")), "id", "left")
    dead = F.col("permanent") | ((F.col("max_attempts") > 0) & (F.col("attempts") >= F.col("max_attempts")))
    out = met.withColumns({
        "status": F.when(F.col("_f"), F.when(dead, F.lit("dead")).otherwise(F.lit("pending"))).otherwise(F.col("status")),
        "run_at": F.when(F.col("_f") & ~dead, F.lit(now) + backoff_seconds(F.col("attempts"))).otherwise(F.col("run_at")),
        "last_error": F.when(F.col("_f"), F.col("error")).otherwise(F.col("last_error")),
    }).select(jobs.columns)
    return fail_if_missing(out, jobs, failed, ["id"], "jobs vanished before failure was recorded: ")


def recover(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "running", F.lit("pending")).otherwise(F.col("status")))


def next_wake(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "pending").agg(F.min("run_at").alias("next_wake"))


def stats(jobs: DataFrame, files: DataFrame, revisions: DataFrame, now: int, errors: int = 5) -> DataFrame:
    """One row: counts by status as sorted arrays, scalars, and the first dead errors."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        grouped = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        return grouped.agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias(name))

    scalars = jobs.agg(F.count_if((F.col("status") == "pending") & (F.col("run_at") <= now)).alias("due"))
    content = revisions.agg(F.count(F.lit(1)).alias("revisions"), F.count("content").alias("stored"), F.count_distinct("page_id").alias("pages"))
    dead = jobs.where("status = 'dead'").orderBy("id").limit(errors).agg(F.array_sort(F.collect_list(F.struct("id", "last_error"))).alias("dead_errors"))
    out = counts(jobs, "jobs")
    for part in (counts(files, "files"), scalars, content, dead):  # one row each
        out = out.crossJoin(part)
    return out
