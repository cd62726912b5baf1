"""Import of an older archive's tree into a site's tables, as one commit that may be repeated.

Journals give pages and revision rows, revision files their content, the tree
of links attachments, wikitext further references; what is still missing gets
fetch jobs. Watermark and shell go to the key-value table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees, urls
from strandline.operators import merge, queue, repair
from strandline.operators.versions import VersionedSite

SCHEMAS = {
    "pages": "page_id long, slug string, title string, tags string, updated_at long, discovered_at long",
    "revisions": "page_id long, rev_no long, rev_id string, ts long, author long, content string, fetched_at long",
    "denied": "page_id long, rev_no long, reason string",
    "files": "path string, url string, sha256 string, size long, status string, first_seen long, saved_at long, content_type string",
    "jobs": "id long, kind string, payload string, priority long, status string, run_at long, attempts long, max_attempts long, last_error string",
    "meta": "key string, value string",
}
REVISION_FETCH = "revision.fetch"


def empty_site(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def _fail(problem: Column, message: Column) -> Column:
    return F.when(problem, F.raise_error(message)).otherwise(F.lit(True))


def checked_files(files: DataFrame, site: str) -> DataFrame:
    """Revision files (key, rel, f: parsed header and body); one that is broken, in another page's folder or of another site fails the plan."""
    bad = F.col("f").isNull() | ~F.col("f.page_id").eqNullSafe(F.col("key").try_cast("bigint")) | ~F.col("f.site").eqNullSafe(F.lit(site))
    return files.withColumn("_ok", _fail(bad, F.concat(F.lit("revision file of another page or site: "), "rel"))).where("_ok").drop("_ok")


def checked_journals(journals: DataFrame) -> DataFrame:
    """Journals (key, journal); one whose key is no page's number fails the plan."""
    bad = F.col("key").try_cast("bigint").isNull()
    return journals.withColumn("_ok", _fail(bad, F.concat(F.lit("journal of no page: "), F.coalesce("key", F.lit("null"))))).where("_ok").drop("_ok")


def imported_pages(old: DataFrame, journals: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Journals first, then the header of the greatest revision's file, in whatever order files are read; discovered_at of known pages stays."""
    empty = F.lit("[]")
    from_journal = journals.select(F.col("key").try_cast("bigint").alias("page_id"), F.coalesce("journal.slug", F.lit("")).alias("slug"), F.coalesce("journal.title", F.lit("")).alias("title"), F.coalesce(F.to_json("journal.tags"), empty).alias("tags"), F.lit(-1).cast("long").alias("_at"))
    from_file = files.select("f.page_id", "f.slug", "f.title", F.coalesce(F.to_json("f.tags"), empty).alias("tags"), F.col("f.revision").alias("_at"))
    best = from_journal.unionByName(from_file).where("page_id is not null").groupBy("page_id").agg(F.max_by(F.struct("slug", "title", "tags"), "_at").alias("p"))
    delta = best.select("page_id", "p.*", F.lit(None).cast("long").alias("updated_at"), F.lit(now).cast("long").alias("discovered_at"))
    return merge.upsert(old, delta, ["page_id"], dict.fromkeys(("slug", "title", "tags"), merge.keep_new))


def imported_revisions(old: DataFrame, journals: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Journal rows where nothing is known; a revision file's header and body replace what is."""
    null = lambda t: F.lit(None).cast(t)
    rows = journals.select(F.col("key").try_cast("bigint").alias("page_id"), F.explode("journal.revisions").alias("r")).select("page_id", "r.rev_no", "r.rev_id", "r.ts", "r.author", null("string").alias("content"), null("long").alias("fetched_at"))
    known = merge.insert_or_ignore(old, rows.where("page_id is not null"), ["page_id", "rev_no"])
    content = files.select("f.page_id", F.col("f.revision").alias("rev_no"), F.col("f.revision_id").alias("rev_id"), F.col("f.timestamp").alias("ts"), "f.author", F.col("f.body").alias("content"), F.lit(now).cast("long").alias("fetched_at"))
    content = content.groupBy("page_id", "rev_no").agg(F.max(F.struct("ts", "rev_id", "author", "content", "fetched_at")).alias("c")).select("page_id", "rev_no", "c.rev_id", "c.ts", "c.author", "c.content", "c.fetched_at")
    return merge.upsert(known, content, ["page_id", "rev_no"], dict.fromkeys(("rev_id", "ts", "author", "content", "fetched_at"), merge.keep_new))


def imported_files(old: DataFrame, links: DataFrame, site: str, now: int) -> DataFrame:
    """links: link (host/path), sha256 (null: not of the sharded layout), size, head (first bytes). Saved rows win; a link without a hash waits."""
    url = F.concat(F.lit("https://"), "link")
    keyed = links.select(urls.fleet_row_key(F.lit(site), url).alias("path"), url.alias("url"), "sha256", "size", "head")
    one = keyed.groupBy("path").agg(F.min_by(F.struct("url", "sha256", "size", "head"), F.struct(F.col("sha256").isNull(), "url")).alias("l")).select("path", "l.*")
    saved = F.col("sha256").isNotNull()
    delta = one.select("path", "url", "sha256", "size", F.when(saved, F.lit("saved")).otherwise(F.lit("pending")).alias("status"), F.lit(now).cast("long").alias("first_seen"), F.when(saved, F.lit(now)).cast("long").alias("saved_at"), F.when(saved, trees.sniff(F.col("head"), F.col("path"))).alias("content_type"))
    found = merge.upsert(old, delta.where("sha256 is not null"), ["path"], dict.fromkeys(("sha256", "size", "status", "content_type"), merge.keep_new))
    return merge.insert_or_ignore(found, delta.where("sha256 is null"), ["path"])


def import_jobs(revisions: DataFrame, denied: DataFrame, jobs: DataFrame, first_id: int, now: int) -> DataFrame:
    """A fetch job for each revision without content that is not denied, numbered behind jobs; the head of a page goes first."""
    wanted = revisions.where("content is null").join(denied.select("page_id", "rev_no"), ["page_id", "rev_no"], "left_anti")
    heads = revisions.groupBy("page_id").agg(F.max("rev_no").alias("head"))
    rows = wanted.join(heads, "page_id").select(F.to_json(F.struct("page_id", "rev_no", "rev_id")).alias("payload"), (F.col("rev_no") == F.col("head")).alias("is_head"))
    priority = F.when(F.col("is_head"), F.lit(queue.PRIORITIES["revision.head"])).otherwise(F.lit(queue.PRIORITIES["revision.old"])).cast("long")
    new = rows.select(F.lit(REVISION_FETCH).alias("kind"), "payload", priority.alias("priority"), F.lit(now).cast("long").alias("run_at"), F.lit(queue.MAX_ATTEMPTS).cast("long").alias("max_attempts"))
    return queue.numbered(new.dropDuplicates(["payload"]), jobs, first_id)


def import_site(state: dict[str, DataFrame], journals: DataFrame, files: DataFrame, links: DataFrame, site: str, now: int, first_id: int = 1, watermark: str | None = None, shell: str | None = None) -> dict[str, DataFrame]:
    """The site's tables after the import; a second import of the same tree changes nothing but times."""
    spark = journals.sparkSession
    files, journals = checked_files(files, site), checked_journals(journals)
    revisions = imported_revisions(state["revisions"], journals, files, now)
    newest = revisions.groupBy("page_id").agg(F.max("ts").alias("_newest"))
    pages = imported_pages(state["pages"], journals, files, now).join(newest, "page_id", "left")
    pages = pages.withColumn("updated_at", F.coalesce("updated_at", "_newest")).select(state["pages"].columns)
    mined = repair.references(files.select(F.col("f.body").alias("content")), site)
    file_rows = repair.seeded(imported_files(state["files"], links, site, now), mined, now)
    jobs = queue.enqueue(state["jobs"], import_jobs(revisions, state["denied"], state["jobs"], first_id, now))
    jobs = repair.armed(file_rows, jobs, first_id, now)
    entries = [(k, v) for k, v in (("saved_up_to", watermark), ("shell", shell)) if v is not None]
    meta = merge.replace_rows(state["meta"], spark.createDataFrame(entries, SCHEMAS["meta"]), ["key"])
    return {"pages": pages, "revisions": revisions, "denied": state["denied"], "files": file_rows, "jobs": jobs, "meta": meta}


def import_into(site_tables: VersionedSite, **inputs) -> int:
    """import_site() on the newest version, committed at once; nothing is left behind if it fails."""
    before = max(site_tables.numbers(), default=0)
    state = empty_site(site_tables.spark) | (site_tables.tables() if before else {})
    return site_tables.commit(import_site(state, **inputs), expected=before, note="import")
