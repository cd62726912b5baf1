"""Import, repair, snapshots and captured answers as whole pipelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees, urls
from strandline.operators import queue, repair, site_import
from strandline.plans.catalog import NOW
from strandline.sources import captured
from strandline.sources import tables as T

SITE = "demo"
HOST = f"http://{SITE}{urls.FLEET[0]}"


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _key(prefix, column="doc_id", suffix=""):
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix))


def broken_files(s, d):
    """A row a document: relative, absolute and respelled keys, junk with pipes and brackets, error pages that were saved."""
    k = F.col("doc_id")
    kind = k % 6
    path = (F.when(kind == 0, _key("local--files/p/a", suffix=".png")).when(kind == 1, _key("local--files/p/b", suffix=".png|w=5")).when(kind == 2, _key("http://www.other.wdfiles.com/local--files/m/c", suffix=".png"))
            .when(kind == 3, _key("local--files/nav%3Aside/d", suffix=".png")).when(kind == 4, _key("local--files/p/e", suffix=".mp3[!--")).otherwise(_key("local--files/p/f", suffix=".html")))
    saved = kind.isin(0, 2, 3, 5)
    rows = _docs(s, d).select("doc_id", path.alias("path"), F.lit(None).cast("string").alias("url"), F.when(saved, F.sha2(k.cast("string"), 256)).alias("sha256"), F.when(saved, k).alias("size"), F.when(saved, F.lit("saved")).otherwise(F.lit("pending")).alias("status"),
                              k.alias("first_seen"), F.when(saved, k).alias("saved_at"), F.when(kind == 5, F.lit("text/html")).when(saved, F.lit("image/png")).alias("content_type"))
    null = lambda t: F.lit(None).cast(t)
    # The second spelling of each row of kind 2: pending, to be folded onto the saved one.
    twins = rows.where("doc_id % 6 = 2").select("doc_id", _key("https://other.wikidot.com/local--files/m/c", suffix=".png").alias("path"), null("string").alias("url"), null("string").alias("sha256"), null("long").alias("size"), F.lit("pending").alias("status"), "first_seen", null("long").alias("saved_at"), null("string").alias("content_type"))
    return rows.unionByName(twins).drop("doc_id")


def broken_jobs(s, d):
    """A pending fetch a row, some done and dead, keyed by the rows' own spellings."""
    rows = broken_files(s, d)
    k = F.col("first_seen")
    status = F.when(k % 4 == 1, F.lit("done")).when(k % 4 == 3, F.lit("dead")).otherwise(F.lit("pending"))
    return rows.select((k * 2 + F.col("path").startswith("https").cast("long")).alias("id"), F.lit(repair.FETCH).alias("kind"), repair.payload(F.col("path")).alias("payload"), F.lit(5).cast("long").alias("priority"), status.alias("status"), F.lit(7).cast("long").alias("run_at"), F.lit(3).cast("long").alias("attempts"), F.lit(8).cast("long").alias("max_attempts"), F.when(status == "dead", F.lit("x")).alias("last_error"))


def referring(s, d):
    """Wikitext that names what each junk row was meant to name, and the colon spelling of kind 3."""
    kind = F.col("doc_id") % 6
    text = F.when(kind == 1, _key("see local--files/p/b", suffix=".png|w=5 ")).when(kind == 3, _key("[local--files/nav:side/d", suffix=".png]")).when(kind == 4, _key("local--files/p/e", suffix=".mp3[!-- x --]"))
    return _docs(s, d).select(text.alias("content"))


def _repaired(s, d, which, step=repair.repair_references):
    out = step(broken_files(s, d), broken_jobs(s, d), referring(s, d), SITE, NOW, 1 << 45)
    return getattr(out, which)


def _shown(jobs):
    """Ids of new jobs are hashes; what counts is which jobs there are."""
    return jobs.select("kind", "payload", "status", "priority", "attempts", "last_error")


def legacy_inputs(s, d):
    """Journals of all conversations, files of every third turn, and a link a document."""
    conversations = s.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null and turn is not null")
    key = F.col("conv_id").cast("string")
    rows = F.transform(F.array_sort(F.collect_set("turn")), lambda t: F.concat(t.cast("string"), F.lit("\tr"), t.cast("string"), F.lit("\t"), (t * 10).cast("string"), F.lit("\t7")))
    journals = conversations.groupBy("conv_id").agg(rows.alias("rows")).select(key.alias("key"), X.journal(F.concat(F.lit("slug: s"), key, F.lit('\ntitle: "T'), key, F.lit('"\ntags: ["a", "b"]\n'), F.array_join("rows", "\n"), F.lit("\n"))).alias("journal"))
    third = conversations.where("turn % 3 = 0").dropDuplicates(["conv_id", "turn"])
    text = X.revision_text(F.concat(F.lit("T"), key), F.array(F.lit("a")), F.col("conv_id"), F.lit(SITE), F.concat(F.lit("s"), key), F.col("turn"), F.concat(F.lit("f"), F.col("turn").cast("string")), F.lit(9), F.col("turn") * 100, F.concat(F.lit("body local--files/x/"), key, F.lit(".png ")))
    files = third.select(key.alias("key"), F.concat(key, F.lit("/r"), F.col("turn").cast("string")).alias("rel"), X.frontmatter(text).alias("f"))
    links = _docs(s, d).select(_key("demo.wdfiles.com/local--files/d/", suffix=".png").alias("link"), F.when(F.col("doc_id") % 4 != 0, F.sha2(F.col("doc_id").cast("string"), 256)).alias("sha256"), F.col("doc_id").alias("size"), F.lit(bytearray(b"\x89PNG\r\n\x1a\n")).alias("head"))
    return journals, files, links


def imported(s, d, which):
    journals, files, links = legacy_inputs(s, d)
    out = site_import.import_site(site_import.empty_site(s), journals, files, links, SITE, NOW, watermark='{"slug":"a"}', shell='{"title":"T","subtitle":""}')
    return out[which]


def report(s, d):
    return queue.status_report(T.jobs(s, d), T.files(s, d), T.revisions(s, d), NOW)


def listed(s, d):
    p = T.pages(s, d)
    answer = F.to_json(F.array(F.struct(F.col("slug").alias("pageId"), F.concat(F.lit("2026-01-02T03:04:05."), F.col("page_id").cast("string"), F.lit("+01:00")).alias("updatedAt"))))
    return captured.article_list(p.select(answer.alias("answer")))


def article(s, d):
    p = T.pages(s, d)
    answer = F.to_json(F.struct(F.col("page_id").alias("uid"), F.when(F.col("page_id") % 2 == 0, F.col("title")).alias("title"), F.array(F.col("slug")).alias("tags")))
    return captured.articles(p.select("slug", answer.alias("answer"))).select("slug", "page_id", "title", F.array_join("tags", ",").alias("tags"), "content")


def versions(s, d):
    r = T.revisions(s, d)
    return captured.versions(r.select(F.col("page_id").cast("string").alias("slug"), "rev_no", F.to_json(F.struct(F.col("content").alias("source"))).alias("answer")))


def file_keys(s, d):
    p = T.pages(s, d)
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("a%3Ab.png").alias("name")), F.struct(F.concat(F.lit("n"), F.col("page_id").cast("string"), F.lit(".png")).alias("name"))).alias("files")))
    return captured.file_names(p.select("slug", answer.alias("answer")), "h.org")


def sources(s, d):
    r = T.revisions(s, d)
    body = F.concat(F.lit('<div class="page-source">s'), "rev_no", F.lit("<br />\nt</div>"))
    answer = F.when(F.col("rev_no") % 3 == 0, F.lit('{"status":"no_permission"}')).otherwise(F.to_json(F.struct(F.lit("ok").alias("status"), body.alias("body"))))
    return captured.source_rows(r.select("rev_id", answer.alias("answer")))


def captured_pages(s, d):
    head = F.concat(F.lit('﻿<script>WIKIREQUEST.info.pageId = '), F.col("page_id").cast("string"), F.lit(';</script><div id="page-title"> P'), F.col("page_id").cast("string"), F.lit('</div><div class="page-tags"><a>x</a><a>y</a></div>'))
    rows = captured.page_rows(T.web_pages(s, d).select(F.concat(head, F.coalesce("html", F.lit(""))).alias("html")))
    return rows.select("page_id", "title", F.array_join("tags", ",").alias("tags"), F.substring("html", 1, 8).alias("begins"))


def linked_roots(s, d):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<link rel="stylesheet" href="/-/static/app.css?v=1"><link rel="stylesheet" href="/-/static/fontawesome/x.css"><link rel="icon" href="/i.css"><link href="/local--files/t/'), k, F.lit('.css?v=9" rel="stylesheet"><link rel="stylesheet" href="https://cdn.example.net/'), k, F.lit('.css?v=2">'))
    links = T.web_pages(s, d).select("page_id", F.posexplode(X.stylesheet_links(html)).alias("at", "href"))
    urls_of = links.select("page_id", "at", urls.resolve_url(F.lit("https://h.org/"), F.col("href")).alias("url")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("urls"))
    return urls_of.select("page_id", F.array_join(X.linked_theme_roots(F.col("urls"), F.lit("h.org")), " ").alias("roots"))


def file_links(s, d):
    """Links of a listing, once each, as canonical keys of the site's own host."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="/local--files/p%3Aq/'), k, F.lit('.jpg">1</a><a href="http://www.h.org/local--files/p:q/'), k, F.lit('.jpg#x">2</a><a href="/q">3</a><a href="https://h.org/local--files/z/'), k, F.lit('.png">4</a>'), F.coalesce("html", F.lit("")))
    T.web_pages(s, d).select("page_id", html.alias("t")).createOrReplaceTempView("file_keys_input")
    s.udtf.register("file_keys", trees.FileLinks)
    found = s.sql("SELECT page_id, f.href FROM file_keys_input, LATERAL file_keys(t) f")
    return found.select("page_id", urls.own_row_key(F.lit("h.org"), urls.resolve_url(F.lit("https://h.org/"), F.col("href"))).alias("path")).distinct()


def _seeded_once(s, d):
    """All jobs; the first of them is a periodic one that died, which seeding leaves alone."""
    first = F.col("id") == 1
    changed = {"kind": F.lit("discover"), "payload": F.lit("{}"), "status": F.lit("dead")}
    return T.jobs(s, d).withColumns({c: F.when(first, v).otherwise(F.col(c)) for c, v in changed.items()})


QUERIES = {
    "u10_repair_files": lambda s, d: _repaired(s, d, "files").select("path", "sha256", "status", "content_type"),
    "u10_repair_jobs": lambda s, d: _shown(_repaired(s, d, "jobs")),
    "u10_repair_orphans": lambda s, d: _repaired(s, d, "orphans"),
    "u10_brackets_files": lambda s, d: _repaired(s, d, "files", repair.repair_brackets).select("path", "status"),
    "u10_brackets_jobs": lambda s, d: _shown(_repaired(s, d, "jobs", repair.repair_brackets)),
    "u09_import_pages": lambda s, d: imported(s, d, "pages"),
    "u09_import_revisions": lambda s, d: imported(s, d, "revisions"),
    "u09_import_files": lambda s, d: imported(s, d, "files"),
    "u09_import_jobs": lambda s, d: _shown(imported(s, d, "jobs")),
    "u09_import_meta": lambda s, d: imported(s, d, "meta"),
    "k11_status_report": report,
    "i13_periodic_seeds": lambda s, d: queue.enqueue(_seeded_once(s, d), queue.periodic_seeds(s, 50_000_000, NOW)).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("jobs"), F.max("priority").alias("priority")),
    "s18_article_list": listed,
    "s18_articles": article,
    "s18_versions": versions,
    "s18_files": file_keys,
    "s16_sources": sources,
    "s14_pages": captured_pages,
    "f26_linked_theme_roots": linked_roots,
    "f16_file_keys": file_links,
    "f38_shell_text": lambda s, d: T.pages(s, d).select("page_id", X.shell_text(F.concat(F.lit('a"'), "title"), F.lit("x\ny"), F.when(F.col("page_id") % 3 == 0, F.col("slug")).when(F.col("page_id") % 3 == 1, F.lit("")), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("r1"), F.col("slug"))).otherwise(F.array().cast("array<string>"))).alias("shell")),
    "p13_object_paths": lambda s, d: T.out_state(s, d).select("page_id", X.object_path(F.col("archive_sha256"), "archives", ".zst").alias("archive"), X.root_path(F.col("archive_sha256")).alias("root")),
}

R, P, FI, J = (T.SQL[k] for k in ("revisions", "pages", "files", "jobs"))
_SHA = "sha256(doc_id::VARCHAR)"
_PAY = "'{{\"path\":\"' || {} || '\"}}'"
# What a document's row is keyed by before and after the repair.
_OLD = """CASE doc_id % 6 WHEN 0 THEN 'local--files/p/a' || doc_id || '.png' WHEN 1 THEN 'local--files/p/b' || doc_id || '.png|w=5' WHEN 2 THEN 'http://www.other.wdfiles.com/local--files/m/c' || doc_id || '.png'
  WHEN 3 THEN 'local--files/nav%3Aside/d' || doc_id || '.png' WHEN 4 THEN 'local--files/p/e' || doc_id || '.mp3[!--' ELSE 'local--files/p/f' || doc_id || '.html' END"""
_NEW = f"""CASE doc_id % 6 WHEN 0 THEN '{HOST}/local--files/p/a' || doc_id || '.png' WHEN 1 THEN '{HOST}/local--files/p/b' || doc_id || '.png' WHEN 2 THEN 'http://other.wikidot.com/local--files/m/c' || doc_id || '.png'
  WHEN 3 THEN '{HOST}/local--files/nav:side/d' || doc_id || '.png' WHEN 4 THEN '{HOST}/local--files/p/e' || doc_id || '.mp3' ELSE '{HOST}/local--files/p/f' || doc_id || '.html' END"""
_ST = "CASE doc_id % 4 WHEN 1 THEN 'done' WHEN 3 THEN 'dead' ELSE 'pending' END"


def _job(path, status, priority, attempts, error, where):
    return f"SELECT 'file.fetch' AS kind, {_PAY.format(f'({path})')} AS payload, {status} AS status, {priority}::BIGINT AS priority, {attempts}::BIGINT AS attempts, {error}::VARCHAR AS last_error FROM documents WHERE {where}"


_TWIN = "'https://other.wikidot.com/local--files/m/c' || doc_id || '.png'"
_C = "(SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
_FILES = f"""(SELECT '{HOST}/local--files/d/' || doc_id || '.png' AS path, 'https://demo.wdfiles.com/local--files/d/' || doc_id || '.png' AS url, CASE WHEN doc_id % 4 <> 0 THEN {_SHA} END AS sha256, doc_id AS size,
    CASE WHEN doc_id % 4 <> 0 THEN 'saved' ELSE 'pending' END AS status, {NOW}::BIGINT AS first_seen, CASE WHEN doc_id % 4 <> 0 THEN {NOW}::BIGINT END AS saved_at, CASE WHEN doc_id % 4 <> 0 THEN 'image/png' END AS content_type FROM documents
  UNION ALL SELECT DISTINCT '{HOST}/local--files/x/' || conv_id || '.png', NULL, NULL, NULL, 'pending', {NOW}, NULL, NULL FROM {_C} WHERE turn % 3 = 0)"""

ORACLE = {
    "u10_repair_files": f"""SELECT {_NEW} AS path, CASE WHEN doc_id % 6 IN (0, 2, 3) THEN {_SHA} END AS sha256, CASE WHEN doc_id % 6 IN (0, 2, 3) THEN 'saved' ELSE 'pending' END AS status, CASE WHEN doc_id % 6 IN (0, 2, 3) THEN 'image/png' END AS content_type FROM documents
      UNION ALL SELECT '{HOST}/' || ({_OLD}), NULL, 'pending', NULL FROM documents WHERE doc_id % 6 = 4""",
    "u10_repair_jobs": f"""{_job(_OLD, _ST, 5, 3, "(CASE WHEN doc_id % 4 = 3 THEN 'x' END)", "doc_id % 6 = 1 AND doc_id % 4 IN (1, 3)")}
      UNION ALL {_job(_NEW, "'pending'", 10, 0, 'NULL', 'doc_id % 6 IN (1, 4, 5)')}
      UNION ALL {_job(f"'{HOST}/' || ({_OLD})", "'pending'", 10, 0, 'NULL', 'doc_id % 6 = 4')}""",
    "u10_repair_orphans": f"SELECT {_SHA} AS sha256 FROM documents WHERE doc_id % 6 = 5",
    "u10_brackets_files": f"""SELECT {_OLD} AS path, CASE WHEN doc_id % 6 IN (0, 2, 3, 5) THEN 'saved' ELSE 'pending' END AS status FROM documents WHERE doc_id % 6 <> 4
      UNION ALL SELECT {_TWIN}, 'pending' FROM documents WHERE doc_id % 6 = 2 UNION ALL SELECT {_NEW}, 'pending' FROM documents WHERE doc_id % 6 IN (1, 3, 4)""",
    "u10_brackets_jobs": f"""{_job(_OLD, _ST, 5, 3, "(CASE WHEN doc_id % 4 = 3 THEN 'x' END)", 'doc_id % 6 IN (0, 2, 3, 5)')}
      UNION ALL {_job(_OLD, "'pending'", "(CASE WHEN doc_id % 4 IN (1, 3) THEN 10 ELSE 5 END)", "(CASE WHEN doc_id % 4 IN (1, 3) THEN 0 ELSE 3 END)", 'NULL', 'doc_id % 6 = 1')}
      UNION ALL {_job(_TWIN, "'pending'", "(CASE WHEN doc_id % 4 IN (1, 3) THEN 10 ELSE 5 END)", "(CASE WHEN doc_id % 4 IN (1, 3) THEN 0 ELSE 3 END)", 'NULL', 'doc_id % 6 = 2')}
      UNION ALL {_job(_NEW, "'pending'", 10, 0, 'NULL', 'doc_id % 6 IN (1, 3, 4)')}""",
    "u09_import_pages": f"""SELECT conv_id AS page_id, 's' || conv_id AS slug, 'T' || conv_id AS title, CASE WHEN max(turn) FILTER (WHERE turn % 3 = 0) IS NULL THEN '["a","b"]' ELSE '["a"]' END AS tags,
      max(CASE WHEN turn % 3 = 0 THEN turn * 100 ELSE turn * 10 END)::BIGINT AS updated_at, {NOW}::BIGINT AS discovered_at FROM {_C} GROUP BY conv_id""",
    "u09_import_revisions": f"""SELECT conv_id AS page_id, turn AS rev_no, CASE WHEN turn % 3 = 0 THEN 'f' ELSE 'r' END || turn AS rev_id, CASE WHEN turn % 3 = 0 THEN turn * 100 ELSE turn * 10 END AS ts, CASE WHEN turn % 3 = 0 THEN 9 ELSE 7 END::BIGINT AS author,
      CASE WHEN turn % 3 = 0 THEN 'body local--files/x/' || conv_id || '.png ' END AS content, CASE WHEN turn % 3 = 0 THEN {NOW}::BIGINT END AS fetched_at FROM {_C}""",
    "u09_import_files": f"SELECT * FROM {_FILES}",
    "u09_import_jobs": f"""SELECT 'revision.fetch' AS kind, '{{"page_id":' || conv_id || ',"rev_no":' || turn || ',"rev_id":"r' || turn || '"}}' AS payload, 'pending' AS status, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 20 ELSE 8 END::BIGINT AS priority, 0::BIGINT AS attempts, NULL::VARCHAR AS last_error
      FROM {_C} QUALIFY turn % 3 <> 0 UNION ALL SELECT 'file.fetch', {_PAY.format('path')}, 'pending', 10, 0, NULL FROM {_FILES} WHERE status = 'pending'""",
    "u09_import_meta": """SELECT * FROM (VALUES ('saved_up_to', '{"slug":"a"}'), ('shell', '{"title":"T","subtitle":""}')) t(key, value)""",
    "k11_status_report": f"""SELECT 'jobs.' || status AS metric, count(*) AS value FROM {J} GROUP BY status UNION ALL SELECT 'files.' || status, count(*) FROM {FI} GROUP BY status
      UNION ALL SELECT 'revisions_known', count(*) FROM {R} UNION ALL SELECT 'revisions_stored', count(content) FROM {R} UNION ALL SELECT 'pages', count(DISTINCT page_id) FROM {R} UNION ALL SELECT 'jobs_due', count(*) FROM {J} WHERE status = 'pending' AND run_at <= {NOW}""",
    "i13_periodic_seeds": f"""WITH j AS (SELECT CASE WHEN id = 1 THEN 'discover' ELSE kind END AS kind, CASE WHEN id = 1 THEN 'dead' ELSE status END AS status, priority FROM {T.SQL['jobs']})
  SELECT kind, status, count(*) AS jobs, max(priority)::BIGINT AS priority FROM (SELECT * FROM j UNION ALL SELECT * FROM (VALUES ('shell.sync', 'pending', 35), ('out.update', 'pending', 18), ('backfill', 'pending', 5)) t(kind, status, priority)
  UNION ALL SELECT 'discover', 'pending', 30 WHERE NOT EXISTS (SELECT 1 FROM j WHERE kind = 'discover')) GROUP BY kind, status""",
    "s18_article_list": f"SELECT slug, 1767319445::BIGINT AS updated_at FROM {P}",
    "s18_articles": f"SELECT slug, page_id, CASE WHEN page_id % 2 = 0 THEN title ELSE '' END AS title, slug AS tags, '' AS content FROM {P}",
    "s18_versions": f"SELECT page_id::VARCHAR AS slug, rev_no, coalesce(content, '') AS content FROM {R}",
    "s18_files": f"SELECT slug, 'https://h.org/local--files/' || slug || '/' || CASE i WHEN 0 THEN 'a:b.png' ELSE 'n' || page_id || '.png' END AS path FROM {P}, (VALUES (0), (1)) t(i)",
    "s16_sources": f"SELECT rev_id, CASE WHEN rev_no % 3 <> 0 THEN 's' || rev_no || chr(10) || 't' END AS content, CASE WHEN rev_no % 3 = 0 THEN 'no_permission' END AS refused FROM {R}",
    "f16_file_keys": "SELECT page_id, 'https://h.org/local--files/' || CASE i WHEN 0 THEN 'p:q/' || page_id || '.jpg' ELSE 'z/' || page_id || '.png' END AS path FROM pages, (VALUES (0), (1)) t(i)",
    "f38_shell_text": f"""SELECT page_id, 'title: "a' || chr(92) || '"' || title || '"' || chr(10) || 'subtitle: "x' || chr(92) || 'ny"' || chr(10) || CASE WHEN page_id % 3 = 0 THEN 'landing: "' || slug || '"' || chr(10) ELSE '' END
      || CASE WHEN page_id % 2 = 0 THEN 'theme_root: r1' || chr(10) || 'theme_root: ' || slug || chr(10) ELSE '' END AS shell FROM {P}""",
    "p13_object_paths": f"SELECT page_id, 'objects/archives/' || substr(archive_sha256, 1, 2) || '/' || substr(archive_sha256, 3, 2) || '/' || archive_sha256 || '.zst' AS archive, 'roots/' || substr(archive_sha256, 1, 2) || '/' || substr(archive_sha256, 3, 2) || '/' || archive_sha256 || '.json' AS root FROM {T.SQL['out_state']}",
    "s14_pages": "SELECT page_id, 'P' || page_id AS title, 'x,y' AS tags, '<script>' AS begins FROM pages",
    "f26_linked_theme_roots": "SELECT page_id, 'https://h.org/local--files/t/' || page_id || '.css https://cdn.example.net/' || page_id || '.css?v=2' AS roots FROM pages",
}
