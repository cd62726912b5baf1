"""Repairs of the files and jobs tables, as pure plans: new state = f(old state). Running one twice changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import urls
from strandline.operators import merge, queue

FETCH = "file.fetch"


@dataclass
class Repaired:
    """files and jobs after the repair, and orphans: hashes of blobs that nothing refers to any more."""

    files: DataFrame
    jobs: DataFrame
    orphans: DataFrame


def payload(path: Column) -> Column:
    """The fetch job's payload of a file row."""
    return F.to_json(F.struct(path.alias("path")))


def is_pipe_junk(path: Column) -> Column:
    """No file has such a path: a pipe in it, or no file below the page."""
    return path.like("%|%") | (path == "local--files/") | (path.like("local--files/%") & ~path.like("local--files/%/%"))


def row_key(site: str, path: Column) -> Column:
    """The canonical key of a row: a relative path is lifted onto the site's own host first."""
    lifted = F.concat(F.lit(f"http://{site}{urls.FLEET[0]}/"), path)
    return urls.fleet_row_key(F.lit(site), F.when(path.contains("://"), path).otherwise(lifted))


def references(revisions: DataFrame, site: str) -> DataFrame:
    """path of every file that any stored revision refers to, canonical and once."""
    base = F.lit(f"http://{site}{urls.FLEET[0]}")
    found = revisions.where("content is not null").select(F.explode(X.mined_references(F.col("content"), base)).alias("ref"))
    return found.select(urls.fleet_row_key(F.lit(site), F.col("ref")).alias("path")).distinct()


def seeded(files: DataFrame, refs: DataFrame, now: int) -> DataFrame:
    """files with a pending row for each reference that has none."""
    blank = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in ("path", "status", "first_seen")]
    fresh = refs.select("path", F.lit("pending").alias("status"), F.lit(now).cast("long").alias("first_seen"), *blank)
    return merge.insert_or_ignore(files, fresh.select(files.columns), ["path"])


def armed(files: DataFrame, jobs: DataFrame, first_id: int, now: int) -> DataFrame:
    """jobs with a fetch for each pending file; done and dead ones wake up again."""
    pending = files.where("status = 'pending'").select(payload(F.col("path")).alias("payload"))
    new = pending.select(F.lit(FETCH).alias("kind"), "payload", F.lit(queue.PRIORITIES[FETCH]).cast("long").alias("priority"), F.lit(now).cast("long").alias("run_at"), F.lit(queue.MAX_ATTEMPTS).cast("long").alias("max_attempts"))
    return queue.enqueue(jobs, queue.numbered(new.dropDuplicates(["payload"]), jobs, first_id), resurrect=True)


def without_jobs(jobs: DataFrame, paths: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """jobs without the fetches of these paths, of the given statuses only."""
    doomed = paths.select(payload(F.col("path")).alias("payload"), F.lit(FETCH).alias("kind")).distinct()
    if statuses is None:
        return jobs.join(doomed, ["kind", "payload"], "left_anti").select(jobs.columns)
    doomed = doomed.crossJoin(jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string"))
    return jobs.join(doomed, ["kind", "payload", "status"], "left_anti").select(jobs.columns)


def unreferenced(candidates: DataFrame, files: DataFrame) -> DataFrame:
    return candidates.where("sha256 is not null").select("sha256").distinct().join(files.select("sha256"), "sha256", "left_anti")


def repair_references(files: DataFrame, jobs: DataFrame, revisions: DataFrame, site: str, now: int, first_id: int) -> Repaired:
    """Drop junk rows, reset error pages that were saved, seed mined references, fold spellings onto one row, arm fetches."""
    junk = files.where(is_pipe_junk(F.col("path"))).select("path")
    soft = (F.col("status") == "saved") & F.col("content_type").eqNullSafe(F.lit("text/html"))
    lost = files.where(soft).select("sha256")
    kept = files.join(junk, "path", "left_anti")
    cleared = {"status": F.lit("pending"), "sha256": None, "size": None, "content_type": None, "saved_at": None}
    reset = kept.select([F.when(soft, F.lit(None).cast(files.schema[c].dataType) if cleared[c] is None else cleared[c]).otherwise(F.col(c)).alias(c) if c in cleared else F.col(c) for c in files.columns])
    # Junk by its own key may come back as a reference under the clean one.
    grown = seeded(reset, references(revisions, site), now).withColumn("_key", row_key(site, F.col("path")))
    rank = F.when(F.col("status") == "saved", 2).when(F.col("status") == "missing", 1).otherwise(0)
    best = merge.best_of_group(grown, ["_key"], [-rank, F.col("path")])
    merged = best.select([F.col("_key").alias(c) if c == "path" else F.col(c) for c in files.columns])
    winners = best.select("_key", F.col("path").alias("_path"), F.col("sha256").alias("_sha"))
    losers = grown.join(winners, "_key").where("path <> _path and status = 'saved' and not (sha256 <=> _sha)").select("sha256")
    respelled = grown.where("path <> _key").select("path")
    left = without_jobs(without_jobs(jobs, junk, ("pending",)), respelled)
    return Repaired(merged, armed(merged, left, first_id, now), unreferenced(lost.unionByName(losers), merged))


def repair_brackets(files: DataFrame, jobs: DataFrame, revisions: DataFrame, site: str, now: int, first_id: int) -> Repaired:
    """Drop rows whose key holds an open bracket, with all their jobs; seed and arm what they were meant to name."""
    junk = files.where(F.col("path").contains("["))
    kept = seeded(files.join(junk.select("path"), "path", "left_anti"), references(revisions, site), now)
    left = without_jobs(jobs, junk.select("path"))
    return Repaired(kept, armed(kept, left, first_id, now), unreferenced(junk.select("sha256"), kept))
