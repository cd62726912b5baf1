"""Publication, crawling, imported formats and host health over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import urls
from strandline.operators import graph, publication
from strandline.operators.publication import decide_archives, page_catalog
from strandline.plans.scalars import _revision_files
from strandline.sources import legacy
from strandline.sources import tables as T
from strandline.streaming import discovery


def stylesheets(s, d):
    """One a customer, importing the two below it and one above it: cycles, gaps, binaries, fragments, relative and quoted targets."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("long").cast("string"), F.lit(".css"))
    css = F.concat(F.lit("@import url('"), name(2 * k), F.lit("');\n@import \""), name(2 * k + 1), F.lit("#x\";\n@import url(../t/"), name(F.floor(k / 3)), F.lit(");\na{b:url(i"), k.cast("string"), F.lit(".png)} c{d:url("), name(2 * k), F.lit(")}"))
    rows = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 13 <> 5")
    return rows.select(F.concat(F.lit("http://h.example.org/t/"), name(k)).alias("url"), F.when(k % 11 != 7, css).alias("css"))


def _crawl(s, d):
    return graph.crawl_documents(s.createDataFrame([("http://H.example.org:80/t/c1.css",)], "url string"), stylesheets(s, d))


def crawled(s, d):
    visited, _ = _crawl(s, d)
    return visited.select(urls.normalize_url(F.col("url")).alias("url"), F.col("depth").cast("long").alias("depth"), "kind")


def crawled_assets(s, d):
    return _crawl(s, d)[1]


def resolved_assets(s, d):
    """Every asset beside hosts that are gone or unreachable, rows that are saved and captured answers."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("http://h"), (k % 5).cast("string"), F.lit(".example.org/i"), k.cast("string"), F.lit(".png"))
    rows = s.read.parquet(f"{d}/customer.parquet").select(k, url.alias("url"))
    hosts = s.createDataFrame([("h2.example.org", "gone"), ("h3.example.org", "unreachable")], "host string, health string")
    captured = rows.where("c_custkey % 7 < 5").select("url", F.when(F.col("c_custkey") % 7 < 3, 200).otherwise(404).alias("status"))
    return rows, graph.resolve_assets(rows, rows.where("c_custkey % 3 = 0"), hosts, captured)


def marker(s, d):
    rows, resolved = resolved_assets(s, d)
    visited = rows.select("url", F.when(F.col("c_custkey") % 50 == 0, F.lit("failed")).otherwise(F.lit("css")).alias("kind"))
    out = graph.crawl_marker(s.createDataFrame([("b",), ("a",)], "url string"), visited, resolved)
    return out.select(F.array_join("roots", ",").alias("roots"), F.sha2(F.array_join("failed", ","), 256).alias("failed"))


def packed(s, d):
    """Every page, at the production level; the bytes are read back from the archive."""
    out = publication.checked_counts(publication.pack_pages(_revision_files(s, d)), page_catalog(T.revisions(s, d)))
    return publication.unpack_pages(out).select("page_id", "name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def marked(s, d):
    feed = T.feed(s, d)
    state = feed.where("rev_no % 3 = 0").groupBy(F.col("slug").alias("host")).agg(F.max("ts").alias("m")).select("host", F.when(F.col("m") % 2 == 0, F.lit("gone")).otherwise(F.lit("unreachable")).alias("health"), (F.col("m") + 1000).alias("until"))
    marks = feed.where("rev_no % 5 = 0").select(F.col("slug").alias("host"), F.when(F.col("rev_no") % 2 == 0, F.lit("gone")).otherwise(F.lit("unreachable")).alias("health"))
    return discovery.mark_hosts(state, marks, 1_706_000_000)


QUERIES = {
    "r01_crawl": crawled,
    "r01_assets": crawled_assets,
    "r02_resolver": lambda s, d: resolved_assets(s, d)[1],
    "r03_marker": marker,
    "k08_archives": packed,
    "u02_archive_decisions": lambda s, d: decide_archives(page_catalog(T.revisions(s, d)).join(T.out_state(s, d), "page_id", "left")).select("page_id", "decision"),
    "u04_file_entries": lambda s, d: publication.file_entries(T.files(s, d)),
    "k03_new_objects": lambda s, d: publication.new_objects(T.files(s, d).where("sha256 is not null").select("sha256"), T.files(s, d).where("sha256 is not null and first_seen % 2 = 0").select("sha256")),
    "s17_envelope": lambda s, d: T.feed(s, d).select("rev_no", legacy.envelope(F.concat(F.lit('{"status":"'), F.when(F.col("rev_no") % 3 == 0, F.lit("no_permission")).otherwise(F.lit("ok")), F.lit('","body":"'), "slug", F.lit('"}'))).alias("e")).select("rev_no", "e.body", "e.refused"),
    "f45_snapshots_above": lambda s, d: legacy.snapshots_above(s.createDataFrame([('{"entries":[{"type":"edit","revNumber":4,"createdAt":"2026-01-02T03:04:05Z","user":{"id":9},"meta":{"version_id":"v4"}},{"type":"new","revNumber":3,"createdAt":"2026-01-01T00:00:00Z","meta":{"source":{"version_id":"v3"}}},{"type":"tags","revNumber":5,"meta":{}},{"type":"new","revNumber":1,"meta":{"version_id":"v1"}}]}',)], "log string"), 2),
    "i14_host_marks": marked,
    "i14_health": lambda s, d: discovery.health(marked(s, d), T.feed(s, d).select(F.col("slug").alias("host")).distinct(), 1_706_100_000),
    "x01_adjacent_pairs": lambda s, d: T.pages(s, d).select("page_id", F.size(X.mined_references(F.array_join(F.transform(F.sequence(F.lit(0), F.col("page_id") % 4), lambda i: F.concat(F.lit("local--files/a/"), (i % 3).cast("string"))), " "), F.lit("http://m"))).cast("long").alias("n")),
}

FE, FI, R, O, P = (T.SQL[k] for k in ("feed", "files", "revisions", "out_state", "pages"))
_NAME = "'http://h.example.org/t/c' || {} || '.css'"
_CSS = "(SELECT c_custkey AS k, c_custkey % 11 = 7 AS bin FROM customer WHERE c_custkey % 13 <> 5)"
_WALK = f"""WITH RECURSIVE w(k, depth) AS (SELECT 1::BIGINT, 0 UNION
    SELECT CASE i WHEN 0 THEN 2 * w.k WHEN 1 THEN 2 * w.k + 1 ELSE w.k // 3 END, w.depth + 1 FROM w JOIN {_CSS} c ON c.k = w.k AND NOT c.bin, (VALUES (0), (1), (2)) t(i) WHERE w.depth < 40),
  v AS (SELECT k, min(depth)::BIGINT AS depth FROM w GROUP BY k),
  n AS (SELECT v.k, depth, CASE WHEN bin IS NULL THEN 'failed' WHEN bin THEN 'binary' ELSE 'css' END AS kind FROM v LEFT JOIN {_CSS} c ON c.k = v.k)"""
_ASSET = "'http://h' || (c_custkey % 5) || '.example.org/i' || c_custkey || '.png'"
_OUTCOME = f"""(SELECT c_custkey AS k, {_ASSET} AS url, CASE WHEN c_custkey % 3 = 0 THEN 'saved' WHEN c_custkey % 5 = 2 THEN 'missing' WHEN c_custkey % 5 = 3 THEN 'failed'
  WHEN c_custkey % 7 IN (3, 4) THEN 'missing' WHEN c_custkey % 7 < 3 THEN 'stored' ELSE 'failed' END AS outcome FROM customer)"""
_HEAD = """'---' || chr(10) || 'title: "T' || '\\\\' || '\\"' || page_id || '"' || chr(10) || 'tags: ["' || author || '", "a \\"b\\""]'"""
_STATE = f"(SELECT slug AS host, CASE WHEN max(ts) % 2 = 0 THEN 'gone' ELSE 'unreachable' END AS health, max(ts) + 1000 AS until FROM {FE} WHERE rev_no % 3 = 0 GROUP BY slug)"
_MARK = f"(SELECT slug AS host, min(CASE WHEN rev_no % 2 = 0 THEN 'gone' ELSE 'unreachable' END) AS health FROM {FE} WHERE rev_no % 5 = 0 GROUP BY slug)"
_HOSTS = f"""(SELECT host, CASE WHEN keep THEN oh ELSE nh END AS health, CASE WHEN keep THEN ou ELSE nu END AS until FROM (
  SELECT coalesce(o.host, n.host) AS host, o.health AS oh, o.until AS ou, n.health AS nh, 1706000000 + CASE WHEN n.health = 'gone' THEN {discovery.GONE_S} ELSE {discovery.UNREACHABLE_S} END AS nu,
    n.host IS NULL OR coalesce(o.health = 'gone' AND o.until > 1706000000 AND n.health <> 'gone', false) AS keep FROM {_STATE} o FULL OUTER JOIN {_MARK} n ON o.host = n.host))"""

ORACLE = {
    "r01_crawl": f"{_WALK} SELECT {_NAME.format('k')} AS url, depth, kind FROM n",
    "r01_assets": f"{_WALK} SELECT 'http://h.example.org/t/i' || k || '.png' AS url FROM n WHERE kind = 'css'",
    "r02_resolver": f"SELECT url, outcome FROM {_OUTCOME}",
    "r03_marker": f"SELECT 'a,b' AS roots, sha256(string_agg(url, ',' ORDER BY url)) AS failed FROM {_OUTCOME} WHERE outcome IN ('failed', 'missing') OR k % 50 = 0",
    "k08_archives": f"""SELECT page_id, 'r' || CASE WHEN length(rev_no::VARCHAR) < 3 THEN lpad(rev_no::VARCHAR, 3, '0') ELSE rev_no::VARCHAR END || '.txt' AS name,
      sha256({_HEAD} || chr(10) || 'page_id: "' || page_id || '"' || chr(10) || 'site: "site"' || chr(10) || 'slug: "p:' || page_id || '"' || chr(10) || 'revision: ' || rev_no || chr(10) || 'revision_id: "' || rev_id || '"' || chr(10)
        || 'author: ' || page_id * 7 || chr(10) || 'timestamp: ' || ts || chr(10) || '---' || chr(10) || content || chr(10)) AS sha256 FROM {R} WHERE content IS NOT NULL""",
    "u02_archive_decisions": f"""SELECT page_id, CASE WHEN c = 0 THEN 'none' WHEN packed_revs = c THEN CASE WHEN archive_sha256 IS NOT NULL THEN 'reuse' ELSE 'adopt' END ELSE 'repack' END AS decision
      FROM (SELECT page_id, count(content) AS c FROM {R} GROUP BY page_id) LEFT JOIN {O} USING (page_id)""",
    "u04_file_entries": f"""SELECT path, '{{"path":"' || path || '","sha256":' || coalesce('"' || sha256 || '"', 'null') || ',"size":' || coalesce(size::VARCHAR, 'null') || ',"content_type":' || coalesce('"' || content_type || '"', 'null')
      || ',"status":"' || status || '","blob":' || coalesce('"files_ca/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || substr(sha256, 5) || '"', 'null') || '}}' AS entry FROM {FI}""",
    "k03_new_objects": f"SELECT DISTINCT sha256 FROM {FI} WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM {FI} WHERE sha256 IS NOT NULL AND first_seen % 2 = 0)",
    "s17_envelope": f"SELECT rev_no, CASE WHEN rev_no % 3 <> 0 THEN slug END AS body, CASE WHEN rev_no % 3 = 0 THEN 'no_permission' END AS refused FROM {FE}",
    "f45_snapshots_above": "SELECT * FROM (VALUES (4::BIGINT, 'v4', 1767323045::BIGINT, 9::BIGINT), (3, 'v3', 1767225600, 0)) t(rev_no, version_id, ts, author)",
    "i14_host_marks": f"SELECT host, health, until::BIGINT AS until FROM {_HOSTS}",
    "i14_health": f"SELECT h.host, coalesce(s.health, 'alive') AS health FROM (SELECT DISTINCT slug AS host FROM {FE}) h LEFT JOIN (SELECT * FROM {_HOSTS} WHERE until > 1706100000) s ON s.host = h.host",
    "x01_adjacent_pairs": f"SELECT page_id, least(page_id % 4 + 1, 3) AS n FROM {P}",
}
