"""Further operators of the inventory over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import urls
from strandline.operators import graph, publication, queue
from strandline.operators import merge as M
from strandline.plans import catalog
from strandline.plans.catalog import NOW, stale_pages
from strandline.plans.changes import _file_state, _unique_jobs
from strandline.sources import tables as T


def _conv(s, d):
    return s.read.parquet(f"{d}/conversations.parquet")


def _web(s, d):
    return T.web_pages(s, d)


def _kv(s, d):
    """A key-value table."""
    return T.pages(s, d).select(F.concat(F.lit("k"), "page_id").alias("key"), F.col("slug").alias("value"))


def _text(column, *parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias(column)


def _cookies(s, d):
    """Headers that add, replace, and say nothing."""
    k = F.col("page_id").cast("string")
    headers = F.array(F.when(F.col("page_id") % 3 == 0, F.lit("; Path=/")).otherwise(F.concat(F.lit(" session=n"), k, F.lit("; Path=/; HttpOnly"))), F.concat(F.lit("token = t"), k, F.lit(" ;Secure")), F.lit("=bad"), F.lit("broken; x=y"))
    jar = F.create_map(F.lit("theme"), F.lit("x"), F.lit("session"), F.col("slug"))
    return T.pages(s, d).select("page_id", X.cookie_header(X.merge_cookies(jar, headers)).alias("header"))


def _assets_minus_imports(s, d):
    """A stylesheet a document: what it references and does not import."""
    k = F.col("doc_id").cast("string")
    css = F.concat(F.lit("@import url('i"), k, F.lit(".css'); a{b:url(i"), k, F.lit(".css)} c{d:url(a"), k, F.lit(".png)}"), F.when(F.col("doc_id") % 2 == 0, F.lit(" e{f:url(../b.png)}")).otherwise(F.lit("")))
    edges = graph.document_edges(s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("http://h.example.org/s/d"), k, F.lit(".css")).alias("url"), css.alias("css")))
    return edges.where("kind = 'asset'").select("src", "dst").join(edges.where("kind = 'import'").select("src", "dst"), ["src", "dst"], "left_anti").select("src", F.col("dst").alias("asset"))


def _merge_losers(s, d):
    """Every fourth row has a second spelling with another scheme and a fragment."""
    files = T.files(s, d).select("path", "status", "first_seen")
    again = files.where("first_seen % 4 = 0").select(F.concat(F.regexp_replace("path", r"^http://(www\.)?", "https://"), F.lit("#again")).alias("path"), F.lit("pending").alias("status"), (F.col("first_seen") + 1_000_000_000).alias("first_seen"))
    rows = files.unionByName(again).where(~F.col("path").contains("|") & ~F.col("path").contains("[")).withColumn("key", urls.folded_key(F.col("path")))
    rank = F.when(F.col("status") == "saved", 2).when(F.col("status") == "missing", 1).otherwise(0)
    best = M.best_of_group(rows, ["key"], [-rank, F.col("path"), F.col("first_seen")]).select("key", F.col("path").alias("best"), F.col("first_seen").alias("seen"))
    return rows.join(best, "key").where("path <> best or first_seen <> seen").select("path", "first_seen")


_BUILD = {
    "f01_page_id": lambda s, d: _web(s, d).select("page_id", X.page_id(_text("h", "x WIKIREQUEST.info.pageId = ", F.col("page_id"), ";", F.col("html"))).alias("pid")),
    "f04_landing_slug": lambda s, d: _web(s, d).select("page_id", X.landing_slug(_text("h", 'pageUnixName = "s', F.col("page_id"), '"; ', F.col("html"))).alias("slug")),
    "f06_css_imports": lambda s, d: _web(s, d).select("page_id", F.array_join(X.css_imports(_text("c", "@import url('a", F.col("page_id"), ".css') screen; @import \"b.css\"; x{} @import url(c.css);")), " ").alias("found")),
    "f07_theme_roots_base": lambda s, d: _web(s, d).select("page_id", F.array_join(X.theme_roots(_text("h", '<style id="internal-style">@import url(/', X.BASE_THEME, ");", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("@import url(/own"), "page_id", F.lit(".css);"))).otherwise(F.lit("")), "</style>", F.col("html"))), " ").alias("roots")),
    "f19_author": lambda s, d: _web(s, d).select("page_id", X.author(F.when(F.col("page_id") % 2 == 0, _text("a", '<span data-id="', F.col("page_id"), '">')).otherwise(_text("a", '<a onclick="userInfo(', F.col("page_id") * 2, ')">'))).alias("author")),
    "f21_take_until_stop": lambda s, d: _web(s, d).select("page_id", X.until_stop(F.concat("url", F.lit("|"), F.coalesce("html", F.lit("")))).alias("taken")),
    "f24_link_tags": lambda s, d: _web(s, d).select("page_id", X.link_attribute(X.link_tags(_text("h", '<link rel=stylesheet href="/s', F.col("page_id"), '.css"><linkx href="no">', F.col("html")))[0], "href").alias("href")),
    "f33_quoted_list": lambda s, d: T.pages(s, d).select("page_id", F.array_join(X.quoted_list(_text("l", '["', F.col("slug"), '", "a, b"]')), "/").alias("items")),
    "f37_watermark": lambda s, d: T.feed(s, d).select("rev_no", X.key_values(_text("t", "slug: ", F.col("slug"), "\nrevision: ", F.col("rev_no"), "\ntimestamp: ", F.col("ts"), "\n")).alias("m")).select("rev_no", F.col("m")["slug"].alias("slug"), F.col("m")["timestamp"].try_cast("bigint").alias("ts")),
    "f41_error_policy": lambda s, d: T.jobs(s, d).select("id", X.error_policy(X.error_class((F.col("id") % 40 + 395).cast("int"))).alias("p")).select("id", F.coalesce("p.permanent", F.lit(False)).alias("permanent"), F.col("p.backoff").cast("long").alias("backoff")),
    "f43_payload": lambda s, d: T.revisions(s, d).select("page_id", "rev_no", F.to_json(F.struct("page_id", "rev_id", "rev_no")).alias("payload")),
    "f46_utf8": lambda s, d: _conv(s, d).select("conv_id", "turn", X.is_utf8(_bytes_of_turns()).alias("valid")),
    "f48_cookie_merge": _cookies,
    "j03_correlated_counts": lambda s, d: T.revisions(s, d).groupBy("page_id").agg(F.count("content").alias("stored"), F.max("rev_no").alias("head")),
    "j09_assets_minus_imports": _assets_minus_imports,
    "a11_reference_union": lambda s, d: T.revisions(s, d).where("content is not null").select("page_id", F.explode(X.mined_references(_text("c", "local--files/p/", F.col("author"), " x"), F.lit("http://m"))).alias("ref")).distinct(),
    "a12_ordered_distinct": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(X.once_in_order(F.split("text", " ")), " ").alias("kept")),
    "a15_import_counters": lambda s, d: T.revisions(s, d).agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("metas"), F.count("content").alias("contents"), F.count_if(F.col("content").isNull()).alias("fetch_jobs")),
    "w02_first_value": lambda s, d: catalog.page_catalog(T.revisions(s, d)).select("page_id", "created_by"),
    "w05_adjacent_pairs": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.adjacent_pairs(F.split("text", r"\. ")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["before"], F.lit("|"), x["after"])), "#")).alias("pairs")),
    "w06_sequence": lambda s, d: T.revisions(s, d).select("page_id", "rev_no", F.row_number().over(Window.partitionBy("page_id").orderBy("rev_no")).cast("long").alias("seq")),
    "t03_ordered_digest": lambda s, d: T.revisions(s, d).groupBy("page_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rev_no", "rev_id"))), lambda r: r["rev_id"]), ","), 256).alias("digest")),
    "t04_reverse_head": lambda s, d: T.revisions(s, d).orderBy(F.desc("ts")).limit(10).select("page_id", "rev_no", "ts"),
    "t06_first_match": lambda s, d: _web(s, d).select("page_id", F.try_element_at(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.lit(1)).alias("first")),
    "t07_last_match": lambda s, d: _web(s, d).select("page_id", F.try_element_at(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.lit(-1)).alias("last")),
    "m08_file_refs": lambda s, d: M.insert_or_ignore(_file_state(s, d).select("path", "status"), T.files(s, d).select(F.concat("path", F.when(F.col("first_seen") % 2 == 0, F.lit("?new")).otherwise(F.lit(""))).alias("path"), F.lit("pending").alias("status")), ["path"]),
    "m10_key_value_upsert": lambda s, d: M.upsert(_kv(s, d), _kv(s, d).select(F.concat("key", F.when(F.length("key") % 2 == 0, F.lit("x")).otherwise(F.lit(""))).alias("key"), F.lit("v2").alias("value")), ["key"], {"value": M.keep_new}),
    "m16_rename_key": lambda s, d: _file_state(s, d).select(urls.folded_key(F.col("path")).alias("path"), "first_seen"),
    "g04_canonical_row_key": lambda s, d: T.pages(s, d).select("page_id", urls.fleet_row_key(F.lit("s"), F.concat(F.lit("http://s"), F.lit(urls.FLEET[0]), F.lit("/local--files/"), F.translate("slug", "-", ":"))).alias("key")),
    "g05_merge_losers": _merge_losers,
    "g06_junk": lambda s, d: T.files(s, d).where(F.col("path").contains("|") | F.col("path").contains("[") | ~F.col("path").rlike("local--files/[^/]+/.+")).select("path", "first_seen"),
    "g07_listed_key": lambda s, d: T.pages(s, d).select("page_id", urls.own_row_key(F.lit("h.org"), F.concat(F.lit("http://www.h.org/local--files/"), "slug", F.lit("/a.png"))).alias("key")),
    "r04_recrawl": lambda s, d: graph.recrawl_needed(
        T.pages(s, d).select(F.col("slug").alias("site"), F.array("title").alias("roots")),
        T.pages(s, d).where("page_id % 4 <> 0").select(F.col("slug").alias("site"), F.array(F.when(F.col("page_id") % 3 == 0, F.lit("other")).otherwise(F.col("title"))).alias("roots"), F.when(F.col("page_id") % 5 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("failed")),
    ),
    "i03_listing_diff": lambda s, d: stale_pages(T.pages(s, d).select("slug", (F.col("page_id") * 60 + F.col("page_id") % 2).alias("listed_at")), T.pages(s, d)),
    "i05_durable_dedup": lambda s, d: _unique_jobs(s, d).where("kind <> 'page.sync'").select("id", "payload"),
    "i06_ephemeral_done": lambda s, d: queue.complete(T.jobs(s, d), T.jobs(s, d).where("kind = 'page.sync' and status = 'running'").select("id", F.lit(None).cast("long").alias("resched"))).select("id", "status"),
    "i12_backfill_sweep": lambda s, d: catalog.backfill(T.revisions(s, d), T.denied_revisions(s, d)).select(F.concat(F.lit("rev:"), "page_id", F.lit("/"), "rev_no").alias("job"), F.when(F.col("is_head"), F.lit(queue.PRIORITIES["revision.head"])).otherwise(F.lit(queue.PRIORITIES["revision.old"])).cast("long").alias("priority")).unionByName(T.files(s, d).where("status = 'pending'").select(F.concat(F.lit("file:"), "path").alias("job"), F.lit(queue.PRIORITIES["file.fetch"]).cast("long").alias("priority")).distinct()),
    "i15_next_wake": lambda s, d: queue.next_wake(T.jobs(s, d)),
    "s04_point_lookups": lambda s, d: T.revisions(s, d).join(T.pages(s, d).where("page_id < 20").select("page_id", "slug"), "page_id").select("page_id", "rev_no", "slug"),
    "s04_lookups_all": lambda s, d: T.revisions(s, d).join(T.pages(s, d).select("page_id", "slug"), "page_id").select("page_id", "rev_no", "slug"),
    "s05_existence": lambda s, d: T.revisions(s, d).join(T.denied_revisions(s, d), ["page_id", "rev_no"], "left_semi").select("page_id", "rev_no"),
    "s15_revisions_above": lambda s, d: T.revisions(s, d).where("rev_no > 2").select("page_id", "rev_no", "rev_id", "ts"),
    "p05_in_list": lambda s, d: T.jobs(s, d).where(F.col("status").isin("pending", "dead")).select("id"),
    "p07_defaults": lambda s, d: T.pages(s, d).select("page_id", F.coalesce("updated_at", F.lit(-1).cast("long")).alias("updated_at")),
    "p12_nullable_ref": lambda s, d: T.files(s, d).select("first_seen", "path", X.blob_path(F.col("sha256")).alias("blob")),
    "u03_count_guard": lambda s, d: publication.checked_counts(T.revisions(s, d).where("content is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), catalog.page_catalog(T.revisions(s, d))),
    "u06_changed_cache": lambda s, d: T.out_state(s, d).join(catalog.page_catalog(T.revisions(s, d)).select("page_id", "revisions_stored"), "page_id").where(~F.col("packed_revs").eqNullSafe(F.col("revisions_stored"))).select("page_id"),
    "now_due": lambda s, d: T.jobs(s, d).where((F.col("status") == "pending") & (F.col("run_at") <= NOW)).agg(F.count(F.lit(1)).alias("due")),
}

def _bytes_of_turns():
    """Texts as bytes: sound ones, ones that end within a character, and ones with a byte that no text has."""
    text = F.col("text").cast("binary")
    third = (F.col("conv_id") + F.col("turn")) % 3
    return F.when(third == 0, text).when(third == 1, F.concat(text, F.unhex(F.lit("E282")))).otherwise(F.concat(F.unhex(F.lit("FF")), text))


QUERIES = dict(_BUILD)

R, D, P, FI, J, O, FE = (T.SQL[k] for k in ("revisions", "denied", "pages", "files", "jobs", "out_state", "feed"))
_FS = f"(SELECT path, sha256, size, status, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_seen) AS rn FROM {FI}) WHERE rn = 1)"
_FOLD = r"'https://' || regexp_replace(regexp_replace(regexp_replace(path, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\.', '')"
_BEST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'saved' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END DESC, path, first_seen) AS rn
  FROM (SELECT *, {_FOLD} AS key FROM {FI} WHERE path NOT LIKE '%|%' AND path NOT LIKE '%[%')))"""
_KV = f"(SELECT 'k' || page_id AS key, slug AS value FROM {P})"
_BF = f"(SELECT page_id, rev_no, rev_no = (SELECT max(rev_no) FROM {R} x WHERE x.page_id = r.page_id) AS is_head FROM {R} r WHERE content IS NULL AND NOT EXISTS (SELECT 1 FROM {D} d WHERE d.page_id = r.page_id AND d.rev_no = r.rev_no))"

ORACLE = {
    "f01_page_id": "SELECT page_id, page_id::VARCHAR AS pid FROM pages",
    "f04_landing_slug": "SELECT page_id, 's' || page_id AS slug FROM pages",
    "f06_css_imports": "SELECT page_id, 'a' || page_id || '.css b.css c.css' AS found FROM pages",
    "f07_theme_roots_base": "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN '/own' || page_id || '.css' ELSE '' END AS roots FROM pages",
    "f19_author": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id ELSE page_id * 2 END AS author FROM pages",
    "f21_take_until_stop": "SELECT page_id, url AS taken FROM pages",
    "f24_link_tags": "SELECT page_id, '/s' || page_id || '.css' AS href FROM pages",
    "f33_quoted_list": f"SELECT page_id, slug || '/a, b' AS items FROM {P}",
    "f37_watermark": f"SELECT rev_no, slug, ts FROM {FE}",
    "f41_error_policy": f"SELECT id, c IN (403, 404) AS permanent, CASE WHEN c = 429 THEN 30 ELSE 5 END::BIGINT AS backoff FROM (SELECT id, id % 40 + 395 AS c FROM {J})",
    "f43_payload": f"""SELECT page_id, rev_no, '{{"page_id":' || page_id || ',"rev_id":"' || rev_id || '","rev_no":' || rev_no || '}}' AS payload FROM {R}""",
    "f46_utf8": "SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN (conv_id + turn) % 3 = 0 END AS valid FROM conversations",
    "f48_cookie_merge": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'session=' || slug ELSE 'session=n' || page_id END || '; theme=x; token=t' || page_id AS header FROM {P}",
    "j03_correlated_counts": f"SELECT DISTINCT page_id, (SELECT count(content) FROM {R} x WHERE x.page_id = r.page_id) AS stored, (SELECT max(rev_no) FROM {R} x WHERE x.page_id = r.page_id) AS head FROM {R} r",
    "j09_assets_minus_imports": "SELECT 'http://h.example.org/s/d' || doc_id || '.css' AS src, 'http://h.example.org/s/a' || doc_id || '.png' AS asset FROM documents UNION ALL SELECT 'http://h.example.org/s/d' || doc_id || '.css', 'http://h.example.org/b.png' FROM documents WHERE doc_id % 2 = 0",
    "a11_reference_union": f"SELECT DISTINCT page_id, 'http://m/local--files/p/' || author AS ref FROM {R} WHERE content IS NOT NULL",
    "a12_ordered_distinct": """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
  f AS (SELECT doc_id, w, min(pos) AS pos FROM w GROUP BY doc_id, w), k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS kept FROM f GROUP BY doc_id)
  SELECT doc_id, kept FROM documents LEFT JOIN k USING (doc_id)""",
    "a15_import_counters": f"SELECT count(DISTINCT page_id) AS pages, count(*) AS metas, count(content) AS contents, count(*) - count(content) AS fetch_jobs FROM {R}",
    "w02_first_value": f"SELECT page_id, arg_min(author, rev_no) FILTER (WHERE content IS NOT NULL) AS created_by FROM {R} GROUP BY page_id",
    "w05_adjacent_pairs": "SELECT doc_id, len(p) - 1 AS n, md5(array_to_string(list_transform(range(1, len(p)), lambda i: p[i] || '|' || p[i + 1]), '#')) AS pairs FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)",
    "w06_sequence": f"SELECT page_id, rev_no, row_number() OVER (PARTITION BY page_id ORDER BY rev_no) AS seq FROM {R}",
    "t03_ordered_digest": f"SELECT page_id, sha256(string_agg(rev_id, ',' ORDER BY rev_no, rev_id)) AS digest FROM {R} GROUP BY page_id",
    "t04_reverse_head": f"SELECT page_id, rev_no, ts FROM {R} ORDER BY ts DESC LIMIT 10",
    "t06_first_match": "SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1] AS first FROM pages",
    "t07_last_match": "SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[-1] AS last FROM pages",
    "m08_file_refs": f"SELECT path, status FROM {_FS} UNION ALL SELECT DISTINCT path || '?new', 'pending' FROM {FI} WHERE first_seen % 2 = 0",
    "m10_key_value_upsert": f"SELECT key, CASE WHEN length(key) % 2 = 1 THEN 'v2' ELSE value END AS value FROM {_KV} UNION ALL SELECT key || 'x', 'v2' FROM {_KV} WHERE length(key) % 2 = 0",
    "m16_rename_key": f"SELECT {_FOLD} AS path, first_seen FROM {_FS}",
    "g04_canonical_row_key": f"SELECT page_id, 'http://s.wikidot.com/local--files/' || replace(slug, '-', ':') AS key FROM {P}",
    "g05_merge_losers": f"""SELECT path, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY {_FOLD} ORDER BY CASE status WHEN 'saved' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END DESC, path, first_seen) AS rn FROM
      (SELECT path, status, first_seen FROM {FI} UNION ALL SELECT regexp_replace(path, '^http://(www[.])?', 'https://') || '#again', 'pending', first_seen + 1000000000 FROM {FI} WHERE first_seen % 4 = 0)
      WHERE path NOT LIKE '%|%' AND path NOT LIKE '%[%') WHERE rn > 1""",
    "g06_junk": f"SELECT path, first_seen FROM {FI} WHERE path LIKE '%|%' OR path LIKE '%[%'",
    "g07_listed_key": f"SELECT page_id, 'https://h.org/local--files/' || slug || '/a.png' AS key FROM {P}",
    "r04_recrawl": f"SELECT slug AS site, page_id % 4 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0 AS needed FROM {P}",
    "i03_listing_diff": f"SELECT slug, page_id * 60 + page_id % 2 AS listed_at FROM {P} WHERE coalesce(updated_at, 0) < page_id * 60 + page_id % 2",
    "i05_durable_dedup": f"SELECT min(id) AS id, payload FROM {J} WHERE kind <> 'page.sync' GROUP BY kind, payload",
    "i06_ephemeral_done": f"SELECT id, status FROM {J} WHERE NOT (kind = 'page.sync' AND status = 'running')",
    "i12_backfill_sweep": f"SELECT 'rev:' || page_id || '/' || rev_no AS job, CASE WHEN is_head THEN 20 ELSE 8 END::BIGINT AS priority FROM {_BF} UNION ALL SELECT DISTINCT 'file:' || path, 10 FROM {FI} WHERE status = 'pending'",
    "i15_next_wake": f"SELECT min(run_at) AS next_wake FROM {J} WHERE status = 'pending'",
    "s04_point_lookups": f"SELECT page_id, rev_no, slug FROM {R} JOIN {P} USING (page_id) WHERE page_id < 20",
    "s04_lookups_all": f"SELECT page_id, rev_no, slug FROM {R} JOIN {P} USING (page_id)",
    "s05_existence": f"SELECT page_id, rev_no FROM {D}",
    "s15_revisions_above": f"SELECT page_id, rev_no, rev_id, ts FROM {R} WHERE rev_no > 2",
    "p05_in_list": f"SELECT id FROM {J} WHERE status IN ('pending', 'dead')",
    "p07_defaults": f"SELECT page_id, coalesce(updated_at, -1) AS updated_at FROM {P}",
    "p12_nullable_ref": f"SELECT first_seen, path, 'files_ca/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || substr(sha256, 5) AS blob FROM {FI}",
    "u03_count_guard": f"SELECT page_id, count(content) AS n FROM {R} GROUP BY page_id HAVING count(content) > 0",
    "u06_changed_cache": f"SELECT page_id FROM {O} JOIN (SELECT page_id, count(content) AS c FROM {R} GROUP BY page_id) USING (page_id) WHERE packed_revs IS DISTINCT FROM c",
    "now_due": f"SELECT count(*) AS due FROM {J} WHERE status = 'pending' AND run_at <= {NOW}",
}
