"""Scalar extraction as column expressions; all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a mined reference.
STOP = r'"\s\)>\'\]\\\|\['
#: Titles of error pages, and what each says.
ERROR_TITLES = {"the file does not exist": "file", "the site does not exist": "site", "not authorized": "auth"}
#: Fixed value: the stylesheet that every page of the platform imports.
BASE_THEME = "common--theme/base/css/style.css"


def strip(text: Column) -> Column:
    """text without white space at its ends, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def page_id(html: Column) -> Column:
    return first_match(html, r"WIKIREQUEST\.info\.pageId = (\d+)")


def landing_slug(html: Column) -> Column:
    return first_match(html, r"""pageUnixName\s*=\s*(["'])([^"']+)\1""", 2)


def html_title(html: Column) -> Column:
    """Text between the first <title...> and the next tag, '' if there is none."""
    return strip(F.regexp_extract(html, r"<title[^>]*>([^<]*)", 1))


def time_from_class(value: Column) -> Column:
    return first_match(value, r"time_(\d+)").try_cast("bigint")


#: Stylesheets that the second platform ships with every site.
CORE_STYLES = ("/-/static/wikidot-base.css", "/-/static/app.css")
CORE_STYLE_FOLDER = "/-/static/fontawesome/"


def linked_theme_roots(urls: Column, host: Column) -> Column:
    """Stylesheets that a home page links, resolved already: the platform's own go, cache busters of the site's own host are cut, each once."""
    def own(u: Column) -> Column:
        return own_host(u, host)

    cut = F.transform(urls, lambda u: F.when(own(u), F.substring_index(u, "?", 1)).otherwise(u))
    path = lambda u: F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    return F.array_distinct(F.filter(cut, lambda u: ~(own(u) & (path(u).isin(*CORE_STYLES) | path(u).startswith(CORE_STYLE_FOLDER)))))


def stylesheet_links(html: Column) -> Column:
    """href of each link whose rel is stylesheet, in order."""
    tags = F.filter(link_tags(html), lambda t: t.rlike(r"""\srel=["']?stylesheet["']?(\s|$|/)"""))
    return F.filter(F.transform(tags, lambda t: link_attribute(t, "href")), lambda h: h.isNotNull())


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")


def author(element: Column) -> Column:
    return F.coalesce(first_match(element, r"""data-id="(\d+)\""""), first_match(element, r"userInfo\((\d+)\)")).try_cast("bigint")


def revision_of_change(text: Column) -> Column:
    """The last word of the text as a number, parentheses aside; 0 if it is none."""
    words = F.split(strip(F.regexp_replace(text, r"[()]", "")), r"\s+")
    return F.coalesce(F.element_at(words, -1).try_cast("bigint"), F.lit(0).cast("long"))


def revision_of_cell(text: Column) -> Column:
    return F.replace(strip(text), F.lit("."), F.lit("")).try_cast("bigint")


def css_imports(css: Column) -> Column:
    """Targets of @import statements: url(...), with or without quotes, or a quoted string."""
    statements = F.transform(F.slice(F.split(css, "@import"), 2, 1_000_000), lambda s: strip(F.element_at(F.split(s, ";"), 1)))
    def target(s: Column) -> Column:
        inner = F.regexp_replace(strip(F.regexp_extract(s, r"^url\(([^)]*)", 1)), r"""^"?'?|"?'?$""", "")
        quoted = F.regexp_extract(s, r"""(?s)^(["'])(.*)\1$""", 2)
        return F.when(s.startswith("url("), inner).otherwise(quoted)
    return F.filter(F.transform(statements, target), lambda t: t != "")


def theme_imports(html: Column) -> Column:
    """Imports inside the page's own style element."""
    style = F.substring_index(F.regexp_extract(html, r"""(?s)id="internal-style"(.*)""", 1), "</style>", 1)
    return css_imports(style)


def theme_roots(html: Column) -> Column:
    """The last import, unless it is the base theme."""
    last = F.try_element_at(theme_imports(html), F.lit(-1))
    return F.when(last.isNotNull() & ~last.contains(BASE_THEME), F.array(last)).otherwise(F.array().cast("array<string>"))


def css_urls(css: Column) -> Column:
    """Distinct url(...) values in order, without data: and fragments."""
    parts = F.slice(F.split(css, r"url\("), 2, 1_000_000)
    inner = F.transform(parts, lambda p: F.regexp_replace(strip(F.substring_index(p, ")", 1)), r"""^["']|["']$""", ""))
    return F.array_distinct(F.filter(inner, lambda u: (u != "") & ~u.startswith("data:") & ~u.startswith("#")))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def decode_colons(path: Column) -> Column:
    return F.regexp_replace(path, "%3[Aa]", ":")


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def own_host(url: Column, host: Column) -> Column:
    """Whether the URL is on this host, www aside; a relative one is."""
    found = url_host(url)
    return found.isNull() | (bare_host(found) == bare_host(F.lower(host)))


def error_page_kind(html: Column) -> Column:
    lower = F.lower(html)
    title = strip(F.regexp_extract(lower, r"(?s)<title[^>]*>(.*?)</title>", 1))
    kind = F.lit(None).cast("string")
    kind = F.when(lower.contains("the file does not exist"), F.lit("file")).otherwise(kind)
    for text, name in ERROR_TITLES.items():
        kind = F.when(title == text, F.lit(name)).otherwise(kind)
    return kind


def link_attribute(tag: Column, name: str) -> Column:
    return first_match(tag, rf"""\s{name}=["']?([^"'\s>]*)""")


def link_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<(link\s[^>]*)"), F.lit(1))


def canonical_landing_slug(html: Column) -> Column:
    """Last non-empty path segment of the canonical link."""
    tags = F.filter(link_tags(html), lambda t: t.rlike(r"""\srel=["']?canonical["'\s]?"""))
    href = link_attribute(F.try_element_at(tags, F.lit(1)), "href")
    path = F.regexp_extract(F.regexp_replace(href, "^[^:]*://", ""), "^[^/]*/(.*)$", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.nullif(strip(F.element_at(F.split(F.try_element_at(segments, F.lit(-1)), r"[?#]"), 1)), F.lit(""))


def iso8601(text: Column) -> Column:
    """Unix seconds; date and time both needed, the fraction is dropped, no zone means UTC."""
    t = strip(text)
    shape = r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.\d+)?(Z|[+-]\d\d:?\d\d)?$"
    n = [F.regexp_extract(t, shape, k).try_cast("int") for k in range(1, 7)]
    zone = F.regexp_extract(t, shape, 7)
    shift = (F.regexp_extract(zone, r"(\d\d):?(\d\d)$", 1).try_cast("int") * 3600 + F.regexp_extract(zone, r"(\d\d):?(\d\d)$", 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(shift)
    valid = t.rlike(shape) & n[1].between(1, 12) & n[2].between(1, 31) & (n[3] <= 23) & (n[4] <= 59) & (n[5] <= 60)
    # Days roll over within short months.
    first = F.make_date(n[0], F.when(n[1].between(1, 12), n[1]).otherwise(1), F.lit(1))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + n[2] - 1
    return F.when(valid, days.cast("long") * 86_400 + n[3] * 3_600 + n[4] * 60 + n[5] - shift)


def media_type(header: Column) -> Column:
    return F.nullif(F.lower(strip(F.split_part(header, F.lit(";"), F.lit(1)))), F.lit(""))


def yaml_quote(text: Column) -> Column:
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def yaml_unquote(text: Column) -> Column:
    """The inverse of yaml_quote, in one pass: escaped backslashes are set apart first."""
    out = F.regexp_replace(strip(text), r'^"|"$', "")
    out = F.replace(out, F.lit("\\\\"), F.lit("\x00"))
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\x00", "\\")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def quoted_list(text: Column) -> Column:
    inner = strip(F.regexp_replace(strip(text), r"^\[|\]$", ""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, '(?<="), (?=")'), yaml_unquote))


def revision_text(title: Column, tags: Column, pid: Column, site: Column, slug: Column, rev_no: Column, rev_id: Column, who: Column, ts: Column, content: Column) -> Column:
    quoted = [yaml_quote(x.cast("string")) for x in (title, pid, site, slug, rev_id)]
    return F.concat(
        F.lit("---\ntitle: "), quoted[0], F.lit("\ntags: ["), F.array_join(F.transform(tags, yaml_quote), ", "), F.lit("]\npage_id: "), quoted[1], F.lit("\nsite: "), quoted[2], F.lit("\nslug: "), quoted[3],
        F.lit("\nrevision: "), rev_no.cast("string"), F.lit("\nrevision_id: "), quoted[4], F.lit("\nauthor: "), who.cast("string"), F.lit("\ntimestamp: "), ts.cast("string"), F.lit("\n---\n"), content, F.lit("\n"),
    )


def last_wins(pairs: Column) -> Column:
    """Entries (key, value) as a map; the last of a key wins."""
    distinct = F.filter(pairs, lambda p: p["key"].isNotNull())
    return F.map_from_entries(F.aggregate(distinct, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))))


def key_values(text: Column) -> Column:
    """Lines ``key: value`` as a map; the last of a key wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(": "))
    return last_wins(F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.regexp_replace(x, "^[^:]*: ", "").alias("value"))))


def merge_cookies(jar: Column, headers: Column) -> Column:
    """A cookie jar (map) after the answer's headers: name=value before the first semicolon; a header without a name is nothing."""
    def one(header: Column) -> Column:
        pair = F.substring_index(header, ";", 1)
        name = F.when(pair.contains("="), F.nullif(strip(F.substring_index(pair, "=", 1)), F.lit("")))
        return F.struct(name.alias("key"), strip(F.regexp_replace(pair, "^[^=]*=", "")).alias("value"))
    return last_wins(F.concat(F.map_entries(jar), F.transform(headers, one)))


def cookie_header(jar: Column) -> Column:
    """The request header of a jar, names in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(jar)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def adjacent_pairs(parts: Column) -> Column:
    """Neighbours of an array as (before, after), one pair less than it has members."""
    count = F.greatest(F.size(parts) - 1, F.lit(0))
    return F.arrays_zip(F.slice(parts, F.lit(1), count).alias("before"), F.slice(parts, F.lit(2), count).alias("after"))


def frontmatter(raw: Column) -> Column:
    """Header fields and body of a revision file; null where the frame or a field is missing."""
    head = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace(F.regexp_replace(raw, r"(?s)^---\n.*?\n---\n", ""), r"\n\z", "")
    kv = key_values(head)
    get = lambda k: F.try_element_at(kv, F.lit(k))
    fields = F.struct(
        yaml_unquote(get("title")).alias("title"), quoted_list(get("tags")).alias("tags"), yaml_unquote(get("page_id")).try_cast("bigint").alias("page_id"), yaml_unquote(get("site")).alias("site"), yaml_unquote(get("slug")).alias("slug"),
        get("revision").try_cast("bigint").alias("revision"), yaml_unquote(get("revision_id")).alias("revision_id"), get("author").try_cast("bigint").alias("author"), get("timestamp").try_cast("bigint").alias("timestamp"), body.alias("body"),
    )
    whole = get("title").isNotNull() & get("page_id").isNotNull() & get("revision").isNotNull() & get("timestamp").isNotNull()
    return F.when(raw.rlike(r"(?s)^---\n.*?\n---\n") & whole, fields)


def journal(raw: Column) -> Column:
    """slug, title, tags and revisions of a journal: header lines, then tab-separated rows; malformed rows are left out."""
    kv = key_values(raw)
    rows = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.split(x, "\t")), lambda r: F.size(r) == 4)
    revs = F.transform(rows, lambda r: F.struct(r[0].try_cast("bigint").alias("rev_no"), r[1].alias("rev_id"), r[2].try_cast("bigint").alias("ts"), r[3].try_cast("bigint").alias("author")))
    good = F.filter(revs, lambda r: r["rev_no"].isNotNull() & r["ts"].isNotNull() & r["author"].isNotNull())
    get = lambda k: F.try_element_at(kv, F.lit(k))
    return F.struct(get("slug").alias("slug"), yaml_unquote(get("title")).alias("title"), quoted_list(get("tags")).alias("tags"), good.alias("revisions"))


def slug(text: Column) -> Column:
    """category (null) and name: lower case, split at the first colon if both sides have something."""
    low = F.lower(strip(text))
    left, right = F.regexp_extract(low, "^([^:]+):(.+)$", 1), F.regexp_extract(low, "^([^:]+):(.+)$", 2)
    split = (left != "") & (right != "")
    return F.struct(F.when(split, left).alias("category"), F.when(split, right).otherwise(low).alias("name"))


def error_class(status: Column) -> Column:
    """Null below 400, else what the status means."""
    return F.when(status == 404, F.lit("NotFound")).when(status == 403, F.lit("Forbidden")).when(status == 429, F.lit("RateLimited")).when(status >= 400, F.lit("Http"))


def error_policy(kind: Column) -> Column:
    """permanent, and seconds to wait before the next try."""
    return F.struct(kind.isin("NotFound", "Forbidden", "Gone").alias("permanent"), F.when(kind == "Timeout", F.lit(10)).when(kind == "RateLimited", F.lit(30)).otherwise(F.lit(5)).alias("backoff"))


def directory_name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(host)), "^https?://", ""), "/+$", "")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def blob_path(sha: Column, root: str = "files_ca") -> Column:
    """root/ab/cd/rest, null for anything that is no hash."""
    return F.when(is_sha256(sha), F.concat_ws("/", F.lit(root), F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.substring(sha, 5, 60)))


def object_path(sha: Column, kind: str, extension: str) -> Column:
    """objects/kind/ab/cd/hash and extension, null for anything that is no hash."""
    return F.when(is_sha256(sha), F.concat(F.concat_ws("/", F.lit("objects"), F.lit(kind), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha), F.lit(extension)))


def root_path(sha: Column) -> Column:
    return F.when(is_sha256(sha), F.concat(F.concat_ws("/", F.lit("roots"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha), F.lit(".json")))


def shell_text(title: Column, subtitle: Column, landing: Column, theme_roots: Column) -> Column:
    """Site titles; landing only if there is one, theme roots unquoted."""
    lines = F.concat(F.array(F.concat(F.lit("title: "), yaml_quote(title)), F.concat(F.lit("subtitle: "), yaml_quote(subtitle))), F.filter(F.array(F.concat(F.lit("landing: "), yaml_quote(F.nullif(landing, F.lit(""))))), lambda x: x.isNotNull()))
    return F.concat(F.array_join(F.concat(lines, F.transform(theme_roots, lambda r: F.concat(F.lit("theme_root: "), r))), "\n"), F.lit("\n"))


def entry_name(rev_no: Column) -> Column:
    s = rev_no.cast("string")
    return F.concat(F.lit("r"), F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s), F.lit(".txt"))


def page_shards(pid: Column) -> Column:
    s = pid.cast("string")
    s = F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s)
    return F.concat_ws("/", F.substring(s, 1, 2), F.substring(s, 3, 2), F.substring(s, 5, 1_000))


def tags_of(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def mined_references(content: Column, base: Column) -> Column:
    """References to attached files in wikitext, in order and once each.

    The text is cut at the marker and neighbours are paired: what stands before
    tells whether the reference is absolute, what follows is its path. base:
    scheme and host that lift a relative reference.
    """
    pairs = adjacent_pairs(F.split(content, "local--files/"))
    def one(p: Column) -> Column:
        taken = F.regexp_extract(p["after"], f"^([^{STOP}]*)", 1)
        # The scheme must be http(s) as a whole word: letters glued to it make it another scheme.
        origin = F.regexp_extract(p["before"], r"(?:^|[^A-Za-z0-9+.\-])((?i:https?)://[A-Za-z0-9.\-]+)/$", 1)
        return F.when(taken == "", F.lit(None)).otherwise(F.concat(F.when(origin != "", origin).otherwise(base), F.lit("/local--files/"), taken))
    return F.array_distinct(F.filter(F.transform(pairs, one), lambda u: u.isNotNull()))


def until_stop(text: Column) -> Column:
    """What stands before the first character that ends a reference."""
    return F.regexp_extract(text, f"^([^{STOP}]*)", 1)


def is_utf8(data: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(data.cast("string"))


def once_in_order(values: Column) -> Column:
    """Each value once, where it first stands."""
    return F.array_distinct(values)
