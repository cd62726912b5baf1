"""Extractors over whole tables: a marker with the row's key stands before each text, and the text itself is read too.

The queries of the same names without ``_table`` hold the vectors of one row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees
from strandline.sources import legacy
from strandline.sources import tables as T


def _before(marker: str, key: str, text: str):
    """The marker with the key for each %, and the text after it."""
    parts = [F.lit(p) for p in marker.split("%")]
    filled = [x for p in parts for x in (p, F.col(key).cast("string"))][:-1]
    return F.concat(*filled, F.coalesce(F.col(text), F.lit("")))


def _pages(s, d, marker):
    return T.web_pages(s, d).select("page_id", _before(marker, "page_id", "html").alias("t"))


def _documents(s, d, marker):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", _before(marker, "doc_id", "text").alias("t"))


def _rows(s, frame, udtf, name):
    s.udtf.register(name, udtf)
    frame.createOrReplaceTempView(f"{name}_whole")
    return s.sql(f"SELECT page_id, f.* FROM {name}_whole, LATERAL {name}(t) f")


STYLE = '<style id="internal-style">@import url(http://x.org/common--theme/base/css/style.css);\n@import "http://x.org/own%.css";</style>'
IMPORTS = "@import url('a%.css') screen; @import \"b.css\"; x{} @import url(c.css);"
URLS = "a{b:url('x%.png')} c{d:url(y.svg)} e{f:url(data:abc)} g{h:url(x%.png)} i{j:url(#z)}"
SOURCE = '<div class="page-source">a &lt;b&gt;<br />%</div>'
CHANGES = (
    '<table class="changes-list"><tr class="changes-list-item"><td class="title"><a href="/alpha-%">A</a></td><td class="revision-no">(rev. %)</td>'
    '<td><span class="odate time_% x">.</span></td><td><a onclick="userInfo(%); return false;">u</a></td></tr></table>'
)
REVISIONS = '<table><tr><td><input value="%"></td><td>1.299</td><td><span class="odate time_%">.</span></td><td><span data-id="6"></span></td></tr></table>'
LINKS = '<a href="/local--files/p/%.jpg">1</a><a href="/local--files/p/%.jpg">2</a><a href="/q">3</a>'
JOURNAL = 'slug: a:%\ntitle: "T"\ntags: ["x", "y"]\n19\t152\t%\t598\nbad\trow\n'
WIKITEXT = "see local--files/page/%.png] and http://m.example.org/local--files/x/%.png or "


def _sniffed(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), text)).otherwise(text)
    name = F.concat(F.lit("t/"), "doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(".css?v=1")).otherwise(F.lit("")))
    return docs.select("doc_id", trees.sniff(content, name).alias("media"))


def _logged(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    entry = F.struct(F.lit("edit").alias("type"), F.col("doc_id").alias("revNumber"), F.lit("2026-01-02T03:04:05Z").alias("createdAt"), F.struct(F.col("doc_id").alias("id")).alias("user"), F.struct(F.col("text").alias("version_id")).alias("meta"))
    return legacy.snapshots_above(docs.select(F.to_json(F.struct(F.array(entry).alias("entries"))).alias("log")), 2)


QUERIES = {
    "f05_theme_roots_table": lambda s, d: _pages(s, d, STYLE).select("page_id", F.array_join(X.theme_imports(F.col("t")), " ").alias("imports"), F.array_join(X.theme_roots(F.col("t")), " ").alias("roots")),
    "f06_css_imports_table": lambda s, d: _pages(s, d, IMPORTS).select("page_id", F.array_join(X.css_imports(F.col("t")), " ").alias("found")),
    "f08_css_urls_table": lambda s, d: _pages(s, d, URLS).select("page_id", F.array_join(X.css_urls(F.col("t")), " ").alias("found")),
    "f13_page_source_table": lambda s, d: _pages(s, d, SOURCE).select("page_id", trees.page_source(F.col("t")).alias("source")),
    "f14_change_rows_table": lambda s, d: _rows(s, _pages(s, d, CHANGES), trees.ChangeRows, "change_rows"),
    "f15_revision_rows_table": lambda s, d: _rows(s, _pages(s, d, REVISIONS), trees.RevisionRows, "revision_rows"),
    "f16_file_links_table": lambda s, d: _rows(s, _pages(s, d, LINKS), trees.FileLinks, "file_links"),
    "f30_sniff_table": _sniffed,
    "f36_journal_table": lambda s, d: _documents(s, d, JOURNAL).select("doc_id", X.journal(F.col("t")).alias("j")).select("doc_id", "j.slug", "j.title", F.explode("j.revisions").alias("r")).select("doc_id", "slug", "title", "r.rev_no", "r.rev_id", "r.ts", "r.author"),
    "g01_references_table": lambda s, d: _documents(s, d, WIKITEXT).select("doc_id", F.posexplode(X.mined_references(F.col("t"), F.lit("http://m.example.org"))).alias("position", "url")).select("doc_id", F.col("position").cast("long"), "url"),
    "f45_snapshots_above_table": _logged,
}

ORACLE = {
    "f05_theme_roots_table": "SELECT page_id, 'http://x.org/common--theme/base/css/style.css http://x.org/own' || page_id || '.css' AS imports, 'http://x.org/own' || page_id || '.css' AS roots FROM pages",
    "f06_css_imports_table": "SELECT page_id, 'a' || page_id || '.css b.css c.css' AS found FROM pages",
    "f08_css_urls_table": "SELECT page_id, 'x' || page_id || '.png y.svg' AS found FROM pages",
    "f13_page_source_table": "SELECT page_id, 'a <b>' || page_id AS source FROM pages",
    "f14_change_rows_table": "SELECT page_id, 'alpha-' || page_id AS slug, page_id AS rev_no, page_id AS ts, page_id AS author FROM pages",
    "f15_revision_rows_table": "SELECT page_id, page_id::VARCHAR AS rev_id, 1299::BIGINT AS rev_no, page_id AS ts, 6::BIGINT AS author FROM pages",
    "f16_file_links_table": "SELECT page_id, '/local--files/p/' || page_id || '.jpg' AS href FROM pages",
    "f30_sniff_table": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image/png' WHEN text LIKE 'BM%' THEN 'image/bmp' WHEN text LIKE 'ID3%' THEN 'audio/mpeg' WHEN doc_id % 3 = 1 THEN 'text/css' END AS media FROM documents",
    "f36_journal_table": "SELECT doc_id, 'a:' || doc_id AS slug, 'T' AS title, 19::BIGINT AS rev_no, '152' AS rev_id, doc_id AS ts, 598::BIGINT AS author FROM documents",
    "g01_references_table": "SELECT doc_id, p AS position, 'http://m.example.org/local--files/' || CASE p WHEN 0 THEN 'page/' ELSE 'x/' END || doc_id || '.png' AS url FROM documents, (VALUES (0::BIGINT), (1)) v(p)",
    "f45_snapshots_above_table": "SELECT doc_id AS rev_no, text AS version_id, 1767323045::BIGINT AS ts, doc_id AS author FROM documents WHERE doc_id > 2 AND text IS NOT NULL",
}
