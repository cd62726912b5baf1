"""Reachability over reference edges: breadth first, cycles allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import urls
from strandline.session import shared_folder, written


#: Rows of one hop that the next one broadcasts (about 100 bytes each).
BROADCAST_FRONTIER = 1 << 17
SEEN = "url string, key string, depth int, kind string"


def crawl(roots: DataFrame, edges: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visited: url, depth, kind; assets: url). It ends when a hop finds nothing new, however deep that is.

    roots: url. edges: src, dst, kind ('import' or 'asset'). documents: url,
    binary. A url without a document has kind 'failed'; a binary one is not
    descended. Two spellings of one document (fragments, host case, default
    ports) are one: what is seen is compared by normalised URL, which is made
    once. Each hop joins the frontier with the edges, drops what was seen and
    appends one table in the shared folder, so a hop writes its own rows only.
    """
    spark = roots.sparkSession
    folder = shared_folder(spark, "crawl")
    keyed = edges.select(urls.normalize_url(F.col("src")).alias("src"), "dst", urls.normalize_url(F.col("dst")).alias("key"), "kind")
    keyed, _ = written(keyed, f"{folder}/edges")
    judged = documents.select(urls.normalize_url(F.col("url")).alias("key"), "binary").groupBy("key").agg(F.min("binary").alias("binary"))
    known, _ = written(judged, f"{folder}/documents")
    imports = keyed.where("kind = 'import'")

    def visit(found: DataFrame, depth: int) -> tuple[DataFrame, int]:
        """One spelling of each document that is new; the hop's table and its rows."""
        fresh = found.groupBy("key").agg(F.min("url").alias("url"))
        fresh = fresh.join(seen(depth).select("key"), "key", "left_anti") if depth else fresh
        kind = F.when(F.col("binary").isNull(), F.lit("failed")).when(F.col("binary"), F.lit("binary")).otherwise(F.lit("css"))
        return written(fresh.join(known, "key", "left").select("url", "key", F.lit(depth).alias("depth"), kind.alias("kind")), f"{folder}/{depth}")

    def seen(depth: int) -> DataFrame:
        return spark.read.schema(SEEN).parquet(*(f"{folder}/{k}" for k in range(depth)))

    depth = 0
    frontier, rows = visit(roots.select("url", urls.normalize_url(F.col("url")).alias("key")), 0)
    while rows:
        depth += 1
        reached = frontier.where("kind = 'css'").select(F.col("key").alias("src"))
        step = imports.join(F.broadcast(reached) if rows <= BROADCAST_FRONTIER else reached, "src", "left_semi")
        frontier, rows = visit(step.select("key", F.col("dst").alias("url")), depth)
    visited = seen(depth + 1)
    reached = visited.where("kind = 'css'").select(F.col("key").alias("src"))
    wanted = keyed.where("kind = 'asset'").select("src", "dst").join(reached, "src", "left_semi")
    assets = wanted.join(imports.select("src", "dst"), ["src", "dst"], "left_anti")
    return visited.select("url", "depth", "kind"), assets.select(F.col("dst").alias("url")).distinct()


def document_edges(documents: DataFrame) -> DataFrame:
    """src, dst, kind of what stylesheets (url, css) import and reference, each resolved against its own document."""
    read = documents.where("css is not null")
    imports = read.select(F.col("url").alias("src"), F.explode(X.css_imports(F.col("css"))).alias("ref"), F.lit("import").alias("kind"))
    assets = read.select(F.col("url").alias("src"), F.explode(X.css_urls(F.col("css"))).alias("ref"), F.lit("asset").alias("kind"))
    both = imports.unionByName(assets)
    return both.select("src", urls.resolve_url(F.col("src"), F.col("ref")).alias("dst"), "kind").distinct()


def crawl_documents(roots: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """crawl() of captured stylesheets. documents: url, css (null: saved bytes that are no stylesheet)."""
    return crawl(roots, document_edges(documents), documents.select("url", F.col("css").isNull().alias("binary")))


def resolve_assets(assets: DataFrame, saved: DataFrame, hosts: DataFrame, captured: DataFrame) -> DataFrame:
    """url, outcome of each asset: 'saved' already, 'missing' on a host that is gone or where the answer says so,
    'failed' on an unreachable host or without an answer, else 'stored'.

    saved: url. hosts: host, health. captured: url, status (the answer to a fetch).
    """
    host = X.url_host(F.col("url"))
    marked = assets.select("url", host.alias("host")).distinct().join(saved.select("url", F.lit(True).alias("_saved")).distinct(), "url", "left")
    marked = marked.join(hosts.select("host", "health").dropDuplicates(["host"]), "host", "left").join(captured.select("url", "status").dropDuplicates(["url"]), "url", "left")
    outcome = F.when(F.col("_saved"), F.lit("saved")).when(F.col("health") == "gone", F.lit("missing")).when(F.col("health") == "unreachable", F.lit("failed"))
    outcome = outcome.when(F.col("status") == 404, F.lit("missing")).when(F.col("status") == 200, F.lit("stored")).otherwise(F.lit("failed"))
    return marked.select("url", outcome.alias("outcome"))


def crawl_marker(roots: DataFrame, visited: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: the sorted roots, and what must be tried again: failed documents, failed and missing assets."""
    again = visited.where("kind = 'failed'").select("url").unionByName(resolved.where("outcome in ('failed', 'missing')").select("url"))
    failed = again.agg(F.sort_array(F.collect_set("url")).alias("failed"))
    return roots.agg(F.sort_array(F.collect_set("url")).alias("roots")).crossJoin(failed)  # one row each


def recrawl_needed(roots: DataFrame, marker: DataFrame) -> DataFrame:
    """site, needed: no marker, other roots, or failures last time. roots: site, roots; marker: site, roots, failed."""
    old = marker.select("site", F.col("roots").alias("old_roots"), "failed")
    same = F.sort_array("roots") == F.sort_array("old_roots")
    return roots.join(old, "site", "left").select("site", (F.col("old_roots").isNull() | ~F.coalesce(same, F.lit(False)) | (F.size("failed") > 0)).alias("needed"))
