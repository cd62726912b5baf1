"""Page catalog, joins, aggregations, window-like computations and top-k over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import merge, queue
from strandline.operators.publication import decide_archives, page_catalog
from strandline.sources import tables as T

NOW = 1_546_300_800


def pages_to_pack(pages: DataFrame, revs: DataFrame, out_state: DataFrame) -> DataFrame:
    """Every page with its catalog row and what was packed; pages without revisions count 0."""
    cat = page_catalog(revs).withColumnRenamed("updated_at", "last_at")
    joined = pages.select("page_id", "slug", "tags").join(cat, "page_id", "left").join(out_state, "page_id", "left")
    return joined.select(
        F.col("page_id").cast("string").alias("id"), "slug", X.tags_of(F.col("tags")).alias("tags"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("revisions_stored", "revisions_known", "max_rev")),
        "created_by", "created_at", "updated_by", F.col("last_at").alias("updated_at"), "packed_revs", "archive_sha256",
    )


def head_flags(revs: DataFrame) -> DataFrame:
    """Each revision with whether it is its page's newest one, over all revisions."""
    head = F.max("rev_no").over(Window.partitionBy("page_id"))
    return revs.withColumn("is_head", F.col("rev_no") == head)


def backfill(revs: DataFrame, denied: DataFrame) -> DataFrame:
    """Revisions without content that nobody refused, and whether each is a head."""
    return head_flags(revs).where("content is null").join(denied.select("page_id", "rev_no"), ["page_id", "rev_no"], "left_anti").select("page_id", "rev_no", "rev_id", "is_head")


def stale_pages(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed pages that are unknown or older than listed."""
    return listing.join(known.select("slug", F.coalesce("updated_at", F.lit(0)).alias("stored")), "slug", "left").where("stored is null or stored < listed_at").select("slug", "listed_at")


def watermark_scan(feed: DataFrame, watermark: dict) -> DataFrame:
    """Changes newer than the stored watermark row: everything before the first row that equals it or is older.

    The feed is newest first by (ts, rev_no). Rows that share the watermark's ts
    but stand before it come again. The stop is a key, found by one aggregation,
    so no window over the whole feed is needed.
    """
    equal = (F.col("slug") == watermark["slug"]) & (F.col("rev_no") == watermark["rev_no"]) & (F.col("ts") == watermark["ts"]) & (F.col("author") == watermark["author"])
    candidates = feed.where(F.col("ts") >= watermark["ts"])
    stop = candidates.where(equal).agg(F.max(F.struct("ts", "rev_no")).alias("stop"))
    return candidates.crossJoin(F.broadcast(stop)).where("stop is null or ts > stop.ts or (ts = stop.ts and rev_no > stop.rev_no)").drop("stop")


def new_watermark(feed: DataFrame) -> DataFrame:
    return feed.agg(F.max_by(F.struct("slug", "rev_no", "ts", "author"), F.struct("ts", "rev_no")).alias("w")).select("w.*")


def canonical_files(files: DataFrame) -> DataFrame:
    """Rows by canonical key; of several spellings the best (saved, then missing) stays, then the smallest path."""
    keyed = files.where(~F.col("path").contains("|") & ~F.col("path").contains("[")).withColumn("key", X_folded(F.col("path")))
    rank = F.when(F.col("status") == "saved", 2).when(F.col("status") == "missing", 1).otherwise(0)
    return merge.best_of_group(keyed, ["key"], [-rank, F.col("path"), F.col("first_seen")])


def X_folded(url):
    from strandline.functions.urls import folded_key

    return folded_key(url)


def _q(name, build):
    def run(spark, d):
        return build(lambda table: getattr(T, table)(spark, d))

    return run


def _listing(t):
    return t("pages").where("page_id % 3 <> 0").select("slug", (F.col("page_id") * 55).alias("listed_at")).unionByName(t("feed").select(F.col("slug"), F.col("ts").alias("listed_at")).groupBy("slug").agg(F.max("listed_at").alias("listed_at")))


WATERMARK = {"slug": "u0", "rev_no": -1, "ts": 1_705_000_000, "author": "none"}


def _known_watermark(t):
    """A watermark that is a row of the feed: the newest at or before a fixed time."""
    row = t("feed").where("ts <= 1705500000").orderBy(F.desc("ts"), F.desc("rev_no")).first()
    return row.asDict() if row else WATERMARK


_BUILD = {
    "u01_page_catalog": lambda t: page_catalog(t("revisions")),
    "j01_pages_to_pack": lambda t: pages_to_pack(t("pages"), t("revisions"), t("out_state")).drop("tags"),
    "j02_backfill": lambda t: backfill(t("revisions"), t("denied_revisions")),
    "j04_head_flags": lambda t: head_flags(t("revisions")).select("page_id", "rev_no", "is_head"),
    "j05_updated_at_fill": lambda t: t("pages").join(t("revisions").groupBy("page_id").agg(F.max("ts").alias("m")), "page_id", "left").select("page_id", F.coalesce("updated_at", "m").alias("updated_at")),
    "j06_stale_pages": lambda t: stale_pages(_listing(t), t("pages")),
    "j07_fetch_gate": lambda t: t("files").select("path", "first_seen").join(t("files").where("status in ('saved','missing')").select("path").distinct(), "path", "left_anti"),
    "j08_orphan_blobs": lambda t: t("files").where("sha256 is not null and path like '%|%'").select("sha256").distinct().join(t("files").where("sha256 is not null and path not like '%|%'").select("sha256"), "sha256", "left_anti"),
    "j10_missing_semi": lambda t: t("files").select("path", "first_seen").join(t("files").where("status = 'missing'").select("path"), "path", "left_semi"),
    "j11_payload_join": lambda t: t("jobs").select("id", "payload").join(t("pages").select("page_id", F.to_json(F.struct(F.col("page_id").alias("id"))).alias("payload")), "payload").select("id", "page_id"),
    "a01_counts": lambda t: t("jobs").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "pending").alias("pending")),
    "a02_status_counts": lambda t: t("jobs").groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "a03_next_wake": lambda t: queue.next_wake(t("jobs")),
    "a04_max_rev": lambda t: t("pages").select("page_id").join(t("revisions").groupBy("page_id").agg(F.max("rev_no").alias("m")), "page_id", "left").select("page_id", F.coalesce("m", F.lit(-1).cast("long")).alias("max_rev_sync"), F.coalesce("m", F.lit(0).cast("long")).alias("max_rev_publish")),
    "a05_first_last_revision": lambda t: page_catalog(t("revisions")).select("page_id", "created_by", "created_at", "updated_by", "updated_at"),
    "a06_stored_known": lambda t: page_catalog(t("revisions")).select("page_id", "revisions_stored", "revisions_known"),
    "a07_distinct_sha": lambda t: t("files").where("sha256 is not null").select("sha256").distinct(),
    "a08_newest": lambda t: t("revisions").agg(F.max("ts").alias("newest_ts"), F.max("rev_no").alias("head_rev")),
    "a09_site_stats": lambda t: queue.stats(t("jobs"), t("files"), t("revisions"), NOW).select(F.col("jobs")[0]["n"].alias("jobs_first"), F.size("jobs").cast("long").alias("job_states"), F.size("files").cast("long").alias("file_states"), "due", "revisions", "stored", "pages", F.array_join(F.transform("dead_errors", lambda e: e["last_error"]), ",").alias("errors")),
    "a10_canonical_files": lambda t: canonical_files(t("files")).select("key", "path", "status", "first_seen"),
    "a13_sorted_dedup": lambda t: t("revisions").groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_set("author")), ",").alias("authors")),
    "a14_publication_counters": lambda t: decide_archives(page_catalog(t("revisions")).join(t("out_state"), "page_id", "left")).groupBy("decision").agg(F.count(F.lit(1)).alias("n")),
    "w04_take_while": lambda t: watermark_scan(t("feed"), _known_watermark(t)),
    "i01_watermark_scan": lambda t: watermark_scan(t("feed"), WATERMARK),
    "i01_new_watermark": lambda t: new_watermark(t("feed")),
    "i02_distinct_slugs": lambda t: watermark_scan(t("feed"), WATERMARK).select("slug").dropDuplicates(["slug"]),
    "i04_above_max_rev": lambda t: t("feed").select("slug", "rev_no").join(t("feed").where("ts < 1705000000").groupBy("slug").agg(F.max("rev_no").alias("m")), "slug", "left").where("rev_no > coalesce(m, -1)").select("slug", "rev_no"),
    "t01_claim": lambda t: queue.claim(t("jobs"), NOW, 50).select("id", "attempts", "status", "claimed_at"),
    "t02_dead_errors": lambda t: t("jobs").where("status = 'dead'").orderBy("id").limit(5).select("id", "last_error"),
    "t05_grants": lambda t: t("jobs").where("status = 'running'").orderBy(F.desc("priority"), "id").limit(200).select("id", ((F.row_number().over(Window.orderBy(F.desc("priority"), "id")) - 1) * 2000).cast("long").alias("granted_ms")),
    "p03_null_safe": lambda t: t("pages").join(t("out_state"), "page_id").where(~F.col("archive_sha256").eqNullSafe(F.sha2(F.col("page_id").cast("string"), 256))).select("page_id"),
    "p04_junk_paths": lambda t: t("files").where(F.col("path").ilike("%|JUNK%") | F.col("path").contains("[")).select("path", "first_seen"),
    "p06_in_top_k": lambda t: t("jobs").join(t("jobs").where("status = 'pending'").orderBy(F.desc("priority"), "run_at", "id").limit(20).select("id"), "id", "left_semi").select("id", "kind"),
    "p10_tags": lambda t: t("pages").select("page_id", F.array_join(X.tags_of(F.col("tags")), ",").alias("tags")),
    "p14_entry_names": lambda t: t("jobs").select("id", X.entry_name(F.col("id")).alias("entry"), X.page_shards(F.col("id")).alias("shard")),
    "s06_watermarks": lambda t: t("pages").select("slug", F.coalesce("updated_at", F.lit(0).cast("long")).alias("updated_at")),
    "s07_revision_scan": lambda t: t("revisions").where("page_id = 1 and content is not null").select("rev_no", "rev_id", "ts", "author", "content"),
    "s08_file_manifest": lambda t: t("files").select("path", "sha256", "size", "content_type", "status"),
}


QUERIES = {name: _q(name, build) for name, build in _BUILD.items()}

R, D, P, FI, J, O, FE = (T.SQL[k] for k in ("revisions", "denied", "pages", "files", "jobs", "out_state", "feed"))
_CAT = f"""(SELECT page_id, count(content) AS revisions_stored, count(*) AS revisions_known, coalesce(max(rev_no), 0) AS max_rev,
  arg_min(author, rev_no) FILTER (WHERE content IS NOT NULL) AS created_by, arg_min(ts, rev_no) FILTER (WHERE content IS NOT NULL) AS created_at,
  arg_max(author, rev_no) FILTER (WHERE content IS NOT NULL) AS updated_by, arg_max(ts, rev_no) FILTER (WHERE content IS NOT NULL) AS updated_at FROM {R} GROUP BY page_id)"""
_LIST = f"(SELECT slug, page_id * 55 AS listed_at FROM {P} WHERE page_id % 3 <> 0 UNION ALL SELECT slug, max(ts) FROM {FE} GROUP BY slug)"
_CLAIM = f"(SELECT * FROM {J} WHERE status = 'pending' AND run_at <= {NOW} ORDER BY priority DESC, run_at, id LIMIT 50)"
_KEY = r"'https://' || regexp_replace(regexp_replace(regexp_replace(path, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\.', '')"

ORACLE = {
    "u01_page_catalog": f"SELECT * FROM {_CAT}",
    "j01_pages_to_pack": f"""SELECT p.page_id::VARCHAR AS id, slug, coalesce(revisions_stored, 0) AS revisions_stored, coalesce(revisions_known, 0) AS revisions_known, coalesce(max_rev, 0) AS max_rev,
      created_by, created_at, updated_by, c.updated_at, packed_revs, archive_sha256 FROM {P} p LEFT JOIN {_CAT} c USING (page_id) LEFT JOIN {O} o USING (page_id)""",
    "j02_backfill": f"""SELECT page_id, rev_no, rev_id, rev_no = (SELECT max(rev_no) FROM {R} x WHERE x.page_id = r.page_id) AS is_head FROM {R} r
      WHERE content IS NULL AND NOT EXISTS (SELECT 1 FROM {D} d WHERE d.page_id = r.page_id AND d.rev_no = r.rev_no)""",
    "j04_head_flags": f"SELECT page_id, rev_no, rev_no = max(rev_no) OVER (PARTITION BY page_id) AS is_head FROM {R}",
    "j05_updated_at_fill": f"SELECT page_id, coalesce(updated_at, m) AS updated_at FROM {P} LEFT JOIN (SELECT page_id, max(ts) AS m FROM {R} GROUP BY page_id) USING (page_id)",
    "j06_stale_pages": f"SELECT slug, listed_at FROM {_LIST} l LEFT JOIN (SELECT slug, coalesce(updated_at, 0) AS stored FROM {P}) k USING (slug) WHERE stored IS NULL OR stored < listed_at",
    "j07_fetch_gate": f"SELECT path, first_seen FROM {FI} WHERE path NOT IN (SELECT path FROM {FI} WHERE status IN ('saved', 'missing'))",
    "j08_orphan_blobs": f"SELECT DISTINCT sha256 FROM {FI} WHERE sha256 IS NOT NULL AND path LIKE '%|%' AND sha256 NOT IN (SELECT sha256 FROM {FI} WHERE sha256 IS NOT NULL AND path NOT LIKE '%|%')",
    "j10_missing_semi": f"SELECT path, first_seen FROM {FI} WHERE path IN (SELECT path FROM {FI} WHERE status = 'missing')",
    "j11_payload_join": f"SELECT id, page_id FROM {J} j JOIN {P} p ON j.payload = '{{\"id\":' || p.page_id || '}}'",
    "a01_counts": f"SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'pending') AS pending FROM {J}",
    "a02_status_counts": f"SELECT status, count(*) AS n FROM {J} GROUP BY status",
    "a03_next_wake": f"SELECT min(run_at) AS next_wake FROM {J} WHERE status = 'pending'",
    "a04_max_rev": f"SELECT page_id, coalesce(m, -1) AS max_rev_sync, coalesce(m, 0) AS max_rev_publish FROM {P} LEFT JOIN (SELECT page_id, max(rev_no) AS m FROM {R} GROUP BY page_id) USING (page_id)",
    "a05_first_last_revision": f"SELECT page_id, created_by, created_at, updated_by, updated_at FROM {_CAT}",
    "a06_stored_known": f"SELECT page_id, revisions_stored, revisions_known FROM {_CAT}",
    "a07_distinct_sha": f"SELECT DISTINCT sha256 FROM {FI} WHERE sha256 IS NOT NULL",
    "a08_newest": f"SELECT max(ts) AS newest_ts, max(rev_no) AS head_rev FROM {R}",
    "a09_site_stats": f"""SELECT (SELECT count(*) FROM {J} WHERE status = (SELECT min(status) FROM {J})) AS jobs_first, (SELECT count(DISTINCT status) FROM {J}) AS job_states,
      (SELECT count(DISTINCT status) FROM {FI}) AS file_states, (SELECT count(*) FROM {J} WHERE status = 'pending' AND run_at <= {NOW}) AS due,
      (SELECT count(*) FROM {R}) AS revisions, (SELECT count(content) FROM {R}) AS stored, (SELECT count(DISTINCT page_id) FROM {R}) AS pages,
      (SELECT string_agg(last_error, ',' ORDER BY id) FROM (SELECT * FROM {J} WHERE status = 'dead' ORDER BY id LIMIT 5)) AS errors""",
    "a10_canonical_files": f"""SELECT key, path, status, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'saved' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END DESC, path, first_seen) AS rn
      FROM (SELECT *, {_KEY} AS key FROM {FI} WHERE path NOT LIKE '%|%' AND path NOT LIKE '%[%')) WHERE rn = 1""",
    "a13_sorted_dedup": f"SELECT page_id, string_agg(DISTINCT author, ',' ORDER BY author) AS authors FROM {R} GROUP BY page_id",
    "a14_publication_counters": f"""SELECT CASE WHEN revisions_stored = 0 THEN 'none' WHEN packed_revs = revisions_stored THEN CASE WHEN archive_sha256 IS NOT NULL THEN 'reuse' ELSE 'adopt' END ELSE 'repack' END AS decision,
      count(*) AS n FROM {_CAT} LEFT JOIN {O} USING (page_id) GROUP BY 1""",
    "w04_take_while": f"""SELECT f.* FROM {FE} f, (SELECT ts, rev_no FROM {FE} WHERE ts <= 1705500000 ORDER BY ts DESC, rev_no DESC LIMIT 1) w WHERE f.ts > w.ts OR (f.ts = w.ts AND f.rev_no > w.rev_no)""",
    "i01_watermark_scan": f"SELECT * FROM {FE} WHERE ts >= 1705000000",
    "i01_new_watermark": f"SELECT * FROM {FE} ORDER BY ts DESC, rev_no DESC LIMIT 1",
    "i02_distinct_slugs": f"SELECT DISTINCT slug FROM {FE} WHERE ts >= 1705000000",
    "i04_above_max_rev": f"SELECT f.slug, f.rev_no FROM {FE} f LEFT JOIN (SELECT slug, max(rev_no) AS m FROM {FE} WHERE ts < 1705000000 GROUP BY slug) USING (slug) WHERE f.rev_no > coalesce(m, -1)",
    "t01_claim": f"SELECT id, attempts + 1 AS attempts, 'running' AS status, {NOW}::BIGINT AS claimed_at FROM {_CLAIM}",
    "t02_dead_errors": f"SELECT id, last_error FROM {J} WHERE status = 'dead' ORDER BY id LIMIT 5",
    "t05_grants": f"SELECT id, (row_number() OVER (ORDER BY priority DESC, id) - 1) * 2000 AS granted_ms FROM (SELECT * FROM {J} WHERE status = 'running' ORDER BY priority DESC, id LIMIT 200)",
    "p03_null_safe": f"SELECT page_id FROM {P} JOIN {O} USING (page_id) WHERE archive_sha256 IS DISTINCT FROM sha256(page_id::VARCHAR)",
    "p04_junk_paths": f"SELECT path, first_seen FROM {FI} WHERE path ILIKE '%|JUNK%' OR path LIKE '%[%'",
    "p06_in_top_k": f"SELECT id, kind FROM {J} WHERE id IN (SELECT id FROM {J} WHERE status = 'pending' ORDER BY priority DESC, run_at, id LIMIT 20)",
    "p10_tags": f"SELECT page_id, CASE WHEN json_valid(tags) THEN array_to_string(from_json(tags, '[\"VARCHAR\"]'), ',') ELSE '' END AS tags FROM {P}",
    "p14_entry_names": f"""SELECT id, 'r' || CASE WHEN length(id::VARCHAR) < 3 THEN lpad(id::VARCHAR, 3, '0') ELSE id::VARCHAR END || '.txt' AS entry,
      substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || substr(s, 5) AS shard FROM (SELECT id, CASE WHEN length(id::VARCHAR) < 5 THEN lpad(id::VARCHAR, 5, '0') ELSE id::VARCHAR END AS s FROM {J})""",
    "s06_watermarks": f"SELECT slug, coalesce(updated_at, 0) AS updated_at FROM {P}",
    "s07_revision_scan": f"SELECT rev_no, rev_id, ts, author, content FROM {R} WHERE page_id = 1 AND content IS NOT NULL",
    "s08_file_manifest": f"SELECT path, sha256, size, content_type, status FROM {FI}",
}
