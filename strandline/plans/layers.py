"""Tables in layers, the feed as a source, migrations and claims of all sites, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import merge as M
from strandline.operators import migrations, queue
from strandline.operators.layered import LayeredTable
from strandline.operators.versions import VersionedSite
from strandline.plans.catalog import NOW
from strandline.sources import blob_sink, feed_source
from strandline.sources import tables as T
from strandline.session import shared_folder
from strandline.streaming import discovery

PAGE = ["page_id", "slug", "title", "updated_at"]
#: New page numbers begin here.
NEW = 10_000_000


def _pages(s, d):
    return T.pages(s, d).select(PAGE)


def five_changes(s, d) -> LayeredTable:
    """Pages: a merge by rules, a deletion, new rows, rows that win whole, and a deletion of some of these; a compaction in between."""
    p = _pages(s, d)
    table = LayeredTable(s, shared_folder(s, "layers"))
    table.create(p, ["page_id"])
    synced = p.where("page_id % 3 = 0").select("page_id", F.concat("slug", F.lit("-x")).alias("slug"), F.upper("title").alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") * 99).alias("updated_at"))
    table.upsert(synced, {"slug": M.keep_new, "updated_at": M.new_or_old})
    table.delete(p.where("page_id % 7 = 0").select("page_id"))
    fresh = p.where("page_id % 5 = 0").select((F.col("page_id") + NEW).alias("page_id"), F.concat(F.lit("new-"), "slug").alias("slug"), "title", F.lit(None).cast("long").alias("updated_at"))
    table.insert_or_ignore(fresh.unionByName(p.where("page_id % 10 = 1")))
    table.compact()
    table.upsert(p.where("page_id % 14 = 0").select("page_id", F.lit("back").alias("slug"), "title", "updated_at"))
    table.delete(fresh.where("page_id % 2 = 0").select("page_id"))
    return table


def layered_pages(s, d):
    return five_changes(s, d).read()


def layered_feed(s, d):
    """What differs between the table after its second change and now."""
    rows = five_changes(s, d).changes(3)
    return rows.select("page_id", "kind", F.col("before.slug").alias("before"), F.col("after.slug").alias("after"))


def two_completions(s, d):
    """Jobs: two writers complete the running jobs of even and of odd numbers, both on the first version; the second moves behind the first."""
    jobs = T.jobs(s, d)
    table = LayeredTable(s, shared_folder(s, "layers"))
    table.create(jobs, ["id"])
    running = jobs.where("status = 'running'")
    one, two = table.begin(exact=True), table.begin(exact=True)
    for change, rest in ((one, 0), (two, 1)):
        mine = change.read_keys(running.where(F.col("id") % 2 == rest))
        change.upsert(queue.complete(mine, mine.select("id", F.when(F.col("id") % 3 == 0, F.lit(NOW + 60)).cast("long").alias("resched"))))
        gone = mine.where(F.col("kind").isin(*queue.EPHEMERAL)).select("id")
        change.delete(gone)
    two.commit("odd")
    one.commit("even")
    return table.read().select("id", "kind", "status", "run_at", "attempts", "last_error")


def feed_upserts(s, d):
    """The feed as pages of 200, streamed newest first through the source into a table in layers: the newest entry of each slug."""
    folder = shared_folder(s, "pages")
    feed = T.feed(s, d)
    feed_source.write_feed(feed, folder)
    table = LayeredTable(s, shared_folder(s, "layers"))
    table.create(s.createDataFrame([], feed_source.SCHEMA), ["slug"])
    stream = feed_source.feed_source(s, folder)
    discovery.layer_stream(stream, table, ["slug"], F.struct("ts", "rev_no"), dict.fromkeys(("rev_no", "ts", "author"), M.keep_new), shared_folder(s, "stream")).awaitTermination()
    return table.read()


def _old_site(s, d) -> VersionedSite:
    """A site as version 2 left it: jobs of all kinds with priorities of their time."""
    site = VersionedSite(s, shared_folder(s, "site"))
    tables, _, _ = migrations.migrated({}, migrations.Context(s, "demo", 1, []), upto=2)
    kinds = ["shell.sync", "file.fetch", "theme.crawl", "page.sync", "out.update", "revision.fetch"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    jobs = T.jobs(s, d).withColumn("kind", kind).withColumn("payload", F.concat(F.lit('{"n":'), "id", F.lit("}")))
    packed = T.out_state(s, d).select("page_id", "packed_revs", F.lit(5).cast("long").alias("packed_at"))
    site.commit(tables | {"jobs": jobs, "out_state": packed}, note="schema 2")
    return site


def migrated_jobs(s, d):
    site = _old_site(s, d)
    migrations.migrate(site, "demo", NOW)
    return site.tables()["jobs"].select("id", "kind", "priority", "run_at")


def migrated_state(s, d):
    site = _old_site(s, d)
    migrations.migrate(site, "demo", NOW)
    tables = site.tables()
    version = tables["meta"].where("key = 'schema_version'").select(F.col("value").cast("long").alias("schema"))
    return tables["out_state"].select("page_id", "packed_revs", "packed_at", "archive_sha256").crossJoin(F.broadcast(version))  # one row


def site_claims(s, d):
    """Jobs of 1,000 sites, one of which has a third of them: four of each run."""
    site = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 999))
    running = F.when((F.col("status") == "running") & (F.col("id") % 5 != 0), F.lit("done")).otherwise(F.col("status"))
    jobs = T.jobs(s, d).withColumn("site", site).withColumn("status", running)
    return queue.claim_by_site(jobs, NOW).select("id", "site", "status", "attempts")


def stored_texts(s, d):
    """Every document's text stored as an object: what the manifest says of each hash, and what lies in the store."""
    root = shared_folder(s, "objects")
    blob_sink.store_blobs(s.read.parquet(f"{d}/documents.parquet").select(F.col("text").cast("binary").alias("content")), root)
    noted = blob_sink.manifest(s, root).groupBy("sha256").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("values"))
    return noted.join(blob_sink.list_blobs(s, root).select("sha256", F.col("size").alias("stored")), "sha256", "full_outer")


def swept_objects(s, d):
    """Objects that are left when those without a saved file row have been marked and swept."""
    root = shared_folder(s, "objects")
    blob_sink.store_blobs(s.read.parquet(f"{d}/documents.parquet").select(F.col("text").cast("binary").alias("content")), root)
    marks, live = blob_sink.open_marks(s, shared_folder(s, "marks")), T.files(s, d)
    blob_sink.mark(marks, blob_sink.list_blobs(s, root), live, NOW)
    blob_sink.sweep(marks, live, root, NOW + 100, 60)
    return blob_sink.list_blobs(s, root).select("sha256", "size")


def import_numbers(s, d):
    """Jobs of an import: how many, how many numbers, and the least and greatest."""
    from strandline.plans.site import imported

    return imported(s, d, "jobs").agg(F.count(F.lit(1)).alias("jobs"), F.count_distinct("id").alias("numbers"), F.count_distinct("kind", "payload").alias("payloads"), (F.min("id") >= 1).alias("behind"))


QUERIES = {
    "m17_layered_changes": layered_pages,
    "m17_change_feed": layered_feed,
    "m17_rebased_completions": two_completions,
    "s13_feed_source": feed_upserts,
    "s01_migrated_jobs": migrated_jobs,
    "s01_migrated_state": migrated_state,
    "t01_claims_by_site": site_claims,
    "k01_stored_texts": stored_texts,
    "j08_swept_objects": swept_objects,
    "u09_import_numbers": import_numbers,
}

_P = f"(SELECT page_id, slug, title, updated_at FROM {T.SQL['pages']})"
_AFTER = f"""o AS {_P},
  a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN slug || '-x' ELSE slug END AS slug, title,
    CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN page_id * 99 ELSE updated_at END AS updated_at FROM o),
  b AS (SELECT * FROM a WHERE page_id % 7 <> 0),
  c AS (SELECT * FROM b UNION ALL SELECT page_id + {NEW}, 'new-' || slug, title, NULL FROM o WHERE page_id % 5 = 0
    UNION ALL SELECT * FROM o WHERE page_id % 10 = 1 AND page_id % 7 = 0),
  e AS (SELECT * FROM c WHERE NOT (page_id % 14 = 0 AND page_id < {NEW}) UNION ALL SELECT page_id, 'back', title, updated_at FROM o WHERE page_id % 14 = 0),
  f AS (SELECT * FROM e WHERE page_id < {NEW} OR page_id % 2 <> 0)"""

ORACLE = {
    "m17_layered_changes": f"WITH {_AFTER} SELECT * FROM f",
    "m17_change_feed": f"""WITH {_AFTER} SELECT coalesce(b.page_id, f.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'insert' WHEN f.page_id IS NULL THEN 'delete' ELSE 'update' END AS kind,
  b.slug AS before, f.slug AS after FROM b FULL JOIN f ON b.page_id = f.page_id
  WHERE b.page_id IS NULL OR f.page_id IS NULL OR (b.slug, b.title, b.updated_at) IS DISTINCT FROM (f.slug, f.title, f.updated_at)""",
    "m17_rebased_completions": f"""SELECT id, kind, CASE WHEN status <> 'running' THEN status WHEN id % 3 = 0 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN status = 'running' AND id % 3 = 0 THEN {NOW + 60} ELSE run_at END::BIGINT AS run_at, attempts, CASE WHEN status = 'running' AND id % 3 = 0 THEN NULL ELSE last_error END AS last_error
  FROM {T.SQL['jobs']} WHERE NOT (status = 'running' AND kind = 'page.sync')""",
    "s13_feed_source": f"SELECT slug, rev_no, ts, author FROM {T.SQL['feed']} QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ts DESC, rev_no DESC) = 1",
    "s01_migrated_jobs": f"""WITH j AS (SELECT id, (['shell.sync', 'file.fetch', 'theme.crawl', 'page.sync', 'out.update', 'revision.fetch'])[id % 6 + 1] AS kind, priority, status, run_at FROM {T.SQL['jobs']})
  SELECT id, kind, CASE kind WHEN 'shell.sync' THEN 35 WHEN 'file.fetch' THEN 10 WHEN 'theme.crawl' THEN 10 WHEN 'page.sync' THEN 15 WHEN 'out.update' THEN 18 ELSE priority END::BIGINT AS priority,
  CASE WHEN kind = 'shell.sync' AND status = 'pending' THEN 0 ELSE run_at END::BIGINT AS run_at FROM j""",
    "s01_migrated_state": f"SELECT page_id, packed_revs, 5::BIGINT AS packed_at, NULL::VARCHAR AS archive_sha256, 8::BIGINT AS schema FROM {T.SQL['out_state']}",
    "t01_claims_by_site": f"""WITH j AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || (id % 999) END AS site, CASE WHEN status = 'running' AND id % 5 <> 0 THEN 'done' ELSE status END AS st FROM {T.SQL['jobs']}),
  r AS (SELECT site, count(*) AS busy FROM j WHERE st = 'running' GROUP BY site),
  k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, run_at, id) AS place FROM j WHERE st = 'pending' AND run_at <= {NOW})
  SELECT id, k.site AS site, 'running' AS status, attempts + 1 AS attempts FROM k LEFT JOIN r ON k.site = r.site WHERE place <= 4 - coalesce(busy, 0)""",
    "k01_stored_texts": """SELECT sha256(coalesce(text, '')) AS sha256, max(strlen(coalesce(text, ''))) AS size, count(*) AS values, max(strlen(coalesce(text, ''))) AS stored FROM documents GROUP BY 1""",
    "j08_swept_objects": f"SELECT DISTINCT sha256, size FROM {T.SQL['files']} WHERE sha256 IS NOT NULL",
    "u09_import_numbers": """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  d AS (SELECT count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM c WHERE turn % 3 <> 0)),
  f AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 = 0)),
  m AS (SELECT count(DISTINCT conv_id) AS n FROM c WHERE turn % 3 = 0)
  SELECT d.n + f.n + m.n AS jobs, d.n + f.n + m.n AS numbers, d.n + f.n + m.n AS payloads, true AS behind FROM d, f, m""",
}
