"""Publications of a site in layers over the driver's tables: all of it, then what a few edits changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import changed
from strandline.operators import publication as P
from strandline.operators.layered import LayeredTable
from strandline.session import shared_folder
from strandline.sources import blob_sink
from strandline.sources import tables as T
from strandline.sources.shard_tree import shard_tree

SHELL = '{"title": "T", "subtitle": "s", "theme_roots": []}'
#: Number of the revision that edits add.
ADDED = 1_000


def render(stored):
    """Revision files of stored revisions beside their pages."""
    return stored.select("page_id", "rev_no", X.revision_text(F.col("title"), F.col("tags"), F.col("page_id"), F.lit("site"), F.col("slug"), F.col("rev_no"), F.col("rev_id"), F.col("page_id") * 7, F.col("ts"), F.col("content")).alias("raw"))


def _tables(s, d):
    pages = T.pages(s, d).select("page_id", "slug", "title", "tags")
    known = T.revisions(s, d).where("page_id is not null and rev_no is not null")
    revisions = known.groupBy("page_id", "rev_no").agg(*(F.min(c).alias(c) for c in ("rev_id", "ts", "author", "content")))
    path = F.concat(F.lit("http://f.example.org/"), "first_seen")
    files = T.files(s, d).where("first_seen is not null").groupBy(path.alias("path")).agg(*(F.min(c).alias(c) for c in ("sha256", "size", "content_type", "status", "first_seen")))
    return pages, revisions, files


def _site(s, d) -> changed.Site:
    tables = {t: LayeredTable(s, shared_folder(s, "layers")) for t in ("pages", "revisions", "files", "packed")}
    pages, revisions, files = _tables(s, d)
    tables["pages"].create(pages, ["page_id"])
    tables["revisions"].create(revisions, ["page_id", "rev_no"], by=["page_id"])
    tables["files"].create(files, ["path"])
    return changed.Site("site", **tables)


def _edit(s, d, site: changed.Site) -> None:
    """Titles, pages that go, new revisions, sizes of files and files that go."""
    pages, revisions, files = _tables(s, d)
    site.pages.begin().upsert(pages.where("page_id % 50 = 0 and page_id % 31 <> 7").withColumn("title", F.upper("title"))).delete(pages.where("page_id % 31 = 7").select("page_id")).commit()
    number = F.lit(ADDED).cast(revisions.schema["rev_no"].dataType).alias("rev_no")
    added = pages.where("page_id % 20 = 3").select("page_id", number, F.concat(F.lit("a"), "page_id").alias("rev_id"), F.lit(5).cast(revisions.schema["ts"].dataType).alias("ts"), F.lit("new").alias("author"), F.lit("added").alias("content"))
    site.revisions.upsert(added)
    site.files.begin().upsert(files.where("first_seen % 40 = 0").withColumn("size", F.coalesce("size", F.lit(0)) + 1)).delete(files.where("first_seen % 41 = 1 and first_seen % 40 <> 0").select("path")).commit()


def _twice(s, d) -> tuple[P.Store, changed.Site, int]:
    """Store and site after two publications, and the version of what was packed by the first."""
    site, store = _site(s, d), P.Store(s, shared_folder(s, "out"))
    changed.publish_changes(store, site, SHELL, render)
    first = site.packed.pinned(None)
    _edit(s, d, site)
    changed.publish_changes(store, site, SHELL, render)
    return store, site, first


def changed_pages(s, d):
    """The published pages after the edits, and whether the second publication packed them."""
    store, site, first = _twice(s, d)
    again = site.packed.changes(first).where("kind <> 'delete'").select(F.col("page_id").cast("string").alias("id"), F.lit(True).alias("again"))
    return P.read_publication(store)[1].join(again, "id", "left").select(
        F.col("id").cast("long").alias("id"), "slug", "title", "revisions_stored", "max_rev", F.col("archive").isNotNull().alias("archived"), F.coalesce("again", F.lit(False)).alias("repacked")
    )


def changed_files(s, d):
    """The published files after the edits."""
    return P.read_publication(_twice(s, d)[0])[2]


def archives_back(s, d):
    """Names and content of what the archives of the second publication hold, found through its pages."""
    store, _, _ = _twice(s, d)
    pages = P.read_publication(store)[1].where("archive is not null").select(F.col("id").cast("long").alias("page_id"), "archive_sha256")
    held = s.read.format("binaryFile").option("pathGlobFilter", "*.zst").option("recursiveFileLookup", True).load(f"{store.root}/objects/archives")
    found = held.select(F.regexp_extract("path", r"([0-9a-f]{64})\.zst$", 1).alias("archive_sha256"), F.col("content").alias("bytes"))
    return P.unpack_pages(pages.join(found, "archive_sha256")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last"))


def tree_of_texts(s, d):
    """Every document's text as a file under the shards of its hash, read back as a tree: key and bytes of each file."""
    root = shared_folder(s, "tree")
    blob_sink.store_blobs(s.read.parquet(f"{d}/documents.parquet").select(F.col("text").cast("binary").alias("content")), root)
    return shard_tree(s, root, depth=3).select("key", F.octet_length("raw").cast("long").alias("size"))


QUERIES = {"s09_shard_tree": tree_of_texts, "u06_changed_publication": changed_pages, "u08_changed_files": changed_files, "u08_published_archives": archives_back}

R, PG, FI = (T.SQL[k] for k in ("revisions", "pages", "files"))
_REVISIONS = f"""(SELECT page_id, rev_no, min(content) AS content FROM {R} WHERE page_id IS NOT NULL AND rev_no IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT page_id, {ADDED}, 'added' FROM {PG} WHERE page_id % 20 = 3)"""
_BLOB = "'files_ca/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || substr(sha256, 5)"

ORACLE = {
    "s09_shard_tree": "SELECT DISTINCT sha256(coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS size FROM documents",
    "u06_changed_publication": f"""WITH c AS (SELECT page_id, count(content) AS n, max(rev_no) AS m FROM {_REVISIONS} GROUP BY 1)
  SELECT page_id AS id, slug, CASE WHEN page_id % 50 = 0 THEN upper(title) ELSE title END AS title, coalesce(n, 0)::BIGINT AS revisions_stored, coalesce(m, 0)::BIGINT AS max_rev,
    coalesce(n, 0) > 0 AS archived, page_id % 20 = 3 AS repacked FROM {PG} LEFT JOIN c USING (page_id) WHERE page_id % 31 <> 7""",
    "u08_changed_files": f"""WITH f AS (SELECT 'http://f.example.org/' || first_seen AS path, first_seen, min(sha256) AS sha256, min(size) AS size, min(content_type) AS content_type, min(status) AS status
    FROM {FI} WHERE first_seen IS NOT NULL GROUP BY 1, 2)
  SELECT path, sha256, CASE WHEN first_seen % 40 = 0 THEN coalesce(size, 0) + 1 ELSE size END::BIGINT AS size, content_type, status, {_BLOB} AS blob FROM f WHERE first_seen % 41 <> 1 OR first_seen % 40 = 0""",
    "u08_published_archives": f"""SELECT page_id, count(*) AS n, max('r' || CASE WHEN rev_no < 1000 THEN lpad(rev_no::VARCHAR, 3, '0') ELSE rev_no::VARCHAR END || '.txt') AS last
  FROM {_REVISIONS} WHERE content IS NOT NULL AND page_id IN (SELECT page_id FROM {PG} WHERE page_id % 31 <> 7) GROUP BY 1""",
}
