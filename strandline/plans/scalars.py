"""Scalar functions over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees, urls
from strandline.operators import queue
from strandline.sources import tables as T


def _q(build):
    return lambda spark, d: build(spark, d)


def _pages(spark, d):
    return T.web_pages(spark, d)


def _revision_files(spark, d):
    """Rendered revision files, one for each stored revision."""
    r = T.revisions(spark, d).where("content is not null")
    tags = F.array(F.col("author"), F.lit('a "b"'))
    return r.select("page_id", "rev_no", X.revision_text(F.concat(F.lit('T\\"'), "page_id"), tags, F.col("page_id"), F.lit("site"), F.concat(F.lit("p:"), "page_id"), F.col("rev_no"), F.col("rev_id"), F.col("page_id") * 7, F.col("ts"), F.col("content")).alias("raw"), "content")


_BUILD = {
    "f11_url_host": lambda s, d: _pages(s, d).select("page_id", X.url_host(F.col("url")).alias("host")),
    "f12_decode_colons": lambda s, d: T.pages(s, d).select("page_id", X.decode_colons(F.replace("slug", F.lit("-"), F.lit("%3A"))).alias("slug")),
    "f18_time_class": lambda s, d: T.feed(s, d).select("rev_no", X.time_from_class(F.concat(F.lit("odate time_"), "ts", F.lit(" format"))).alias("ts")),
    "f20_revision_cell": lambda s, d: T.jobs(s, d).select("id", X.revision_of_cell(F.concat(F.lit(" 1."), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"))).alias("rev_no")),
    "f22_error_pages": lambda s, d: _pages(s, d).select("page_id", X.error_page_kind(F.when(F.col("page_id") % 5 == 0, F.lit("<TITLE>The site does not exist</TITLE>")).when(F.col("page_id") % 5 == 2, F.lit("<title>\n\tNot authorized\u00a0\n</title>")).when(F.col("page_id") % 5 == 1, F.lit("<p>The file does not exist</p>")).otherwise(F.col("html"))).alias("kind")),
    "f23_html_title": lambda s, d: _pages(s, d).select("page_id", X.html_title(F.regexp_replace("html", "<title>", "<title>\n\t ")).alias("title")),
    "f25_canonical_slug": lambda s, d: _pages(s, d).select("page_id", X.canonical_landing_slug(F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).alias("slug")),
    "f27_own_host": lambda s, d: _pages(s, d).select("page_id", X.own_host(F.col("url"), F.lit("ththre.example.com")).alias("own")),
    "f28_iso8601": lambda s, d: T.feed(s, d).select("rev_no", X.iso8601(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'.5+02:00'")).alias("ts")),
    "f29_media_type": lambda s, d: T.jobs(s, d).select("id", X.media_type(F.concat(F.lit(" Text/"), "kind", F.lit("; charset=utf-8"))).alias("media")),
    "f31_sha256": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")),
    "f32_yaml_round_trip": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.yaml_unquote(X.yaml_quote(F.concat(F.lit('a\\n"\t'), "text"))).alias("back")),
    "f35_frontmatter": lambda s, d: _revision_files(s, d).select("page_id", "rev_no", X.frontmatter(F.col("raw")).alias("f")).select("page_id", "rev_no", F.col("f.title").alias("title"), F.array_join("f.tags", "/").alias("tags"), F.col("f.page_id").alias("pid"), F.col("f.timestamp").alias("ts"), F.col("f.body").alias("body")),
    "f39_slug": lambda s, d: T.pages(s, d).select("page_id", X.slug(F.concat(F.lit(" "), F.when(F.col("page_id") % 2 == 0, F.lit("Draft:")).otherwise(F.lit("")), "title")).alias("s")).select("page_id", "s.category", "s.name"),
    "f40_backoff": lambda s, d: T.jobs(s, d).select("id", queue.backoff_seconds(F.col("attempts") * 2).alias("wait")),
    "f42_status_class": lambda s, d: T.jobs(s, d).select("id", X.error_class((F.col("id") % 40 + 395).cast("int")).alias("class")),
    "f47_directory_name": lambda s, d: _pages(s, d).select("page_id", X.directory_name(F.concat(F.lit("HTTPS://www."), "page_id", F.lit(".Example.org//"))).alias("dir")),
    "g03_own_key": lambda s, d: _pages(s, d).select("page_id", urls.own_row_key(F.lit("www.ththre.example.com"), F.col("url")).alias("key")),
    "g03_folded_key": lambda s, d: _pages(s, d).select("page_id", urls.folded_key(F.col("url")).alias("key")),
    "k02_blob_path": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.blob_path(F.sha2(F.col("text").cast("binary"), 256)).alias("path")),
    "k09_canonical_json": lambda s, d: T.files(s, d).select("first_seen", "path", F.concat(F.to_json(F.struct("path", "sha256", "size"), {"ignoreNullFields": "false"}), F.lit("\n")).alias("json")),
    "p11_sha_valid": lambda s, d: T.out_state(s, d).select("page_id", X.is_sha256(F.col("archive_sha256")).alias("valid")),
}

QUERIES = {name: _q(build) for name, build in _BUILD.items()}

R, P, FI, J, O, FE = (T.SQL[k] for k in ("revisions", "pages", "files", "jobs", "out_state", "feed"))
ORACLE = {
    "f11_url_host": r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages",
    "f12_decode_colons": f"SELECT page_id, replace(slug, '-', ':') AS slug FROM {P}",
    "f18_time_class": f"SELECT rev_no, ts FROM {FE}",
    "f20_revision_cell": f"SELECT id, 1000 + id % 1000 AS rev_no FROM {J}",
    "f22_error_pages": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'site' WHEN page_id % 5 = 1 THEN 'file' WHEN page_id % 5 = 2 THEN 'auth' END AS kind FROM pages",
    "f23_html_title": "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)', 1)) AS title FROM pages",
    "f25_canonical_slug": r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([^/]+)/?$', 1) AS slug FROM pages",
    "f27_own_host": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') = 'ththre.example.com' AS own FROM pages",
    "f28_iso8601": f"SELECT rev_no, ts - 7200 AS ts FROM {FE}",
    "f29_media_type": f"SELECT id, 'text/' || kind AS media FROM {J}",
    "f31_sha256": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "f32_yaml_round_trip": "SELECT doc_id, 'a\\n\"' || chr(9) || text AS back FROM documents",
    "f35_frontmatter": f"SELECT page_id, rev_no, 'T\\\"' || page_id AS title, author || '/a \"b\"' AS tags, page_id AS pid, ts, content AS body FROM {R} WHERE content IS NOT NULL",
    "f39_slug": f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'draft' END AS category, lower(title) AS name FROM {P}",
    "f40_backoff": f"SELECT id, least(10 * (1::BIGINT << greatest(0, least(10, attempts * 2 - 1))::INT), 3600) AS wait FROM {J}",
    "f42_status_class": f"SELECT id, CASE id % 40 + 395 WHEN 404 THEN 'NotFound' WHEN 403 THEN 'Forbidden' WHEN 429 THEN 'RateLimited' ELSE CASE WHEN id % 40 + 395 >= 400 THEN 'Http' END END AS class FROM {J}",
    "f47_directory_name": "SELECT page_id, 'www.' || page_id || '.example.org' AS dir FROM pages",
    "g03_own_key": r"SELECT page_id, CASE WHEN u LIKE 'https://ththre.example.com/%' THEN 'https://www.' || substr(u, 9) ELSE regexp_replace(url, '#.*$', '') END AS key FROM (SELECT *, 'https://' || regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\.', '') AS u FROM pages)",
    "g03_folded_key": r"SELECT page_id, 'https://' || regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\.', '') AS key FROM pages",
    "k02_blob_path": "SELECT doc_id, 'files_ca/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || substr(sha256(text), 5) AS path FROM documents",
    "k09_canonical_json": f"""SELECT first_seen, path, '{{"path":"' || path || '","sha256":' || coalesce('"' || sha256 || '"', 'null') || ',"size":' || coalesce(size::VARCHAR, 'null') || '}}' || chr(10) AS json FROM {FI}""",
    "p11_sha_valid": f"SELECT page_id, archive_sha256 IS NOT NULL AS valid FROM {O}",
}

#: Vectors for functions that the driver's tables have no input for: (query, function over a literal frame).
LIST_PAGE = (
    '<table class="changes-list"><tr class="changes-list-item"><td class="title"><a href="/alpha-1">A</a></td><td class="revision-no">(rev. 4)</td>'
    '<td><span class="odate time_1700000001 x">.</span></td><td><a onclick="userInfo(77); return false;">u</a></td></tr>'
    '<tr class="changes-list-item"><td class="title"><a href="/draft:beta">B</a></td><td class="revision-no">(new)</td>'
    '<td><span class="odate time_1700000002">.</span></td><td><span class="printuser" data-id="88"></span></td></tr></table>'
)
REVISION_PAGE = (
    '<table><tr><td><input value="900"></td><td>1.299</td><td><span class="odate time_1700000003">.</span><td>x</td>'
    '<td><a onclick="userInfo(5)">u</a></td></tr><tr><td><input value="901"></td><td>1.300</td><td><span class="odate time_1700000004">.</span></td><td><span data-id="6"></span></td></tr></table>'
)
STYLE_PAGE = '<style id="internal-style">@import url(http://x.org/common--theme/base/css/style.css);\n@import "http://x.org/own.css";</style>'
WIKITEXT = "see local--files/page/a.png] and http://m.example.org/local--files/x/b.png or http://o.org/zap local--files/w/u.png\" local--files/local--files/z"


def _table(spark, html, udtf, name):
    spark.udtf.register(name, udtf)
    frame = spark.createDataFrame([(html,)], "html string")
    frame.createOrReplaceTempView(f"{name}_input")
    return spark.sql(f"SELECT f.* FROM {name}_input, LATERAL {name}(html) f")


QUERIES |= {
    "f02_titles": lambda s, d: _pages(s, d).select("page_id", trees.titles(F.concat(F.lit('<div id="header"><h1> Site </h1><h2>Sub</h2></div><p id="page-title">P'), "page_id", F.lit("</p>"), "html")).alias("t")).select("page_id", "t.page", "t.site", "t.subtitle"),
    "f03_tags": lambda s, d: _pages(s, d).select("page_id", F.array_join(trees.page_tags(F.concat(F.lit('<div class="page-tags"><a> x'), "page_id", F.lit("</a><span><a>y</a></span></div>"), "html")), ",").alias("tags")),
    "f05_theme_roots": lambda s, d: s.createDataFrame([(STYLE_PAGE,)], "html string").select(F.array_join(X.theme_imports(F.col("html")), " ").alias("imports"), F.array_join(X.theme_roots(F.col("html")), " ").alias("roots")),
    "f08_css_urls": lambda s, d: s.createDataFrame([("a{b:url('x.png')} c{d:url(y.svg)} e{f:url(data:abc)} g{h:url(x.png)} i{j:url(#z)}",)], "css string").select(F.array_join(X.css_urls(F.col("css")), " ").alias("found")),
    "f09_resolve": lambda s, d: _pages(s, d).select("page_id", urls.resolve_url(F.regexp_replace("url", "[?#].*$", ""), F.lit("../s/./a.css")).alias("resolved")),
    "f10_normalize": lambda s, d: _pages(s, d).select("page_id", urls.normalize_url(F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+", 0))).alias("clean")),
    "f13_page_source": lambda s, d: _pages(s, d).select("page_id", trees.page_source(F.concat(F.lit('<div class="page-source">a &lt;b&gt;<br />'), "page_id", F.lit("</div>"))).alias("source")),
    "f14_change_rows": lambda s, d: _table(s, LIST_PAGE, trees.ChangeRows, "change_rows"),
    "f15_revision_rows": lambda s, d: _table(s, REVISION_PAGE, trees.RevisionRows, "revision_rows"),
    "f16_file_links": lambda s, d: _table(s, '<a href="/local--files/p/a.jpg">1</a><a href="/local--files/p/a.jpg">2</a><a href="/q">3</a>', trees.FileLinks, "file_links"),
    "f30_sniff": lambda s, d: s.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nx"), "a.css"), (bytearray(b"h1 {}"), "t/style.css?v=1"), (bytearray(b"???"), "noext")], "content binary, name string").select("name", trees.sniff(F.col("content"), F.col("name")).alias("media")),
    "f36_journal": lambda s, d: s.createDataFrame([('slug: a:b\ntitle: "T"\ntags: ["x", "y"]\n19\t152\t172\t598\nbad\trow\n18\t146\t165\t311\n',)], "raw string").select(X.journal(F.col("raw")).alias("j")).select("j.slug", "j.title", F.explode("j.revisions").alias("r")).select("slug", "title", "r.rev_no", "r.rev_id", "r.ts", "r.author"),
    "g01_references": lambda s, d: s.createDataFrame([(WIKITEXT,)], "t string").select(F.posexplode(X.mined_references(F.col("t"), F.lit("http://m.example.org"))).alias("position", "url")).select(F.col("position").cast("long"), "url"),
    "g02_fleet_key": lambda s, d: _pages(s, d).select("page_id", urls.fleet_row_key(F.lit("own"), F.concat(F.lit("HTTPS://WWW.S"), "page_id", F.lit(urls.FLEET[1]), F.lit("/a%3Ab/x?v=1#f"))).alias("key")),
}

ORACLE |= {
    "f02_titles": "SELECT page_id, 'P' || page_id AS page, 'Site' AS site, 'Sub' AS subtitle FROM pages",
    "f03_tags": "SELECT page_id, 'x' || page_id || ',y' AS tags FROM pages",
    "f05_theme_roots": "SELECT 'http://x.org/common--theme/base/css/style.css http://x.org/own.css' AS imports, 'http://x.org/own.css' AS roots",
    "f08_css_urls": "SELECT 'x.png y.svg' AS found",
    "f09_resolve": r"""SELECT page_id, CASE WHEN d SIMILAR TO '[a-z]+://[^/]+' THEN d ELSE regexp_replace(d, '/[^/]+$', '') END || '/s/a.css' AS resolved
      FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS d FROM pages)""",
    "f10_normalize": "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/' AS clean FROM pages",
    "f13_page_source": "SELECT page_id, 'a <b>' || page_id AS source FROM pages",
    "f14_change_rows": "SELECT * FROM (VALUES ('alpha-1', 4::BIGINT, 1700000001::BIGINT, 77::BIGINT), ('draft:beta', 0, 1700000002, 88)) t(slug, rev_no, ts, author)",
    "f15_revision_rows": "SELECT * FROM (VALUES ('900', 1299::BIGINT, 1700000003::BIGINT, 5::BIGINT), ('901', 1300, 1700000004, 6)) t(rev_id, rev_no, ts, author)",
    "f16_file_links": "SELECT '/local--files/p/a.jpg' AS href",
    "f30_sniff": "SELECT * FROM (VALUES ('a.css', 'image/png'), ('t/style.css?v=1', 'text/css'), ('noext', NULL)) t(name, media)",
    "f36_journal": "SELECT * FROM (VALUES ('a:b', 'T', 19::BIGINT, '152', 172::BIGINT, 598::BIGINT), ('a:b', 'T', 18, '146', 165, 311)) t(slug, title, rev_no, rev_id, ts, author)",
    "g01_references": "SELECT * FROM (VALUES (0::BIGINT, 'http://m.example.org/local--files/page/a.png'), (1, 'http://m.example.org/local--files/x/b.png'), (2, 'http://m.example.org/local--files/w/u.png'), (3, 'http://m.example.org/local--files/z')) t(position, url)",
    "g02_fleet_key": "SELECT page_id, 'http://s' || page_id || '.wikidot.com/a:b/x?v=1' AS key FROM pages",
}
