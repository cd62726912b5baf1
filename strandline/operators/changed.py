"""Publication of what changed: the feeds of tables in layers say which pages are rendered and packed again.

A site's pages, revisions and files are tables in layers. What was packed is one too, and its commit notes
which versions of the others it came from, and the root that was made of them. The next publication reads the
feeds from there on: only pages that a row of a page or of a revision names are read, counted, rendered and
packed; entries of all others are taken from the last section as they stand. Objects come before the note, and
HEAD moves last, so a writer may be lost at any time: what it left is found or made again, with the same bytes.

A section that did not change is not written again. Without a note, or once versions that it names were
vacuumed, everything is published anew; archives of pages whose counts are as they were packed stay in use.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import publication as P
from strandline.operators.layered import LayeredTable
from strandline.session import drop_folder, written
from strandline.sources import blob_sink

PACKED = "page_id long, packed_revs long, archive_sha256 string"


@dataclass(frozen=True)
class Site:
    """Tables of a site. pages are keyed by page_id; revisions by page_id and rev_no, in buckets by page_id; files by path; packed by page_id."""

    name: str
    pages: LayeredTable
    revisions: LayeredTable
    files: LayeredTable
    packed: LayeredTable


@dataclass(frozen=True)
class Outcome:
    root: str
    moved: bool
    #: Pages and files that were looked at, and pages that were packed.
    pages: int
    files: int
    packed: int


def _kept(table: LayeredTable, after: int, upto: int) -> bool:
    """Whether the feed between two versions can be read."""
    return set(range(after, upto + 1)) <= set(table.numbers())


def _base(store: P.Store, site: Site, now: dict[str, int]) -> tuple[dict, dict | None]:
    """The last note, and the root it names, if a publication can go on from there."""
    note = json.loads(site.packed.note() or "{}") if site.packed.numbers() else {}
    if not note or not store.exists(P.root_name(note["root"])):
        return note, None
    if not all(_kept(getattr(site, t), note[t], v) for t, v in now.items()):
        return note, None
    return note, json.loads(store.get(P.root_name(note["root"])))


def _catalog(site: Site, now: dict[str, int], touched: DataFrame | None) -> DataFrame:
    """Pages (those touched, if given) with their counts, what was packed of them and the decision."""
    if touched is None:
        pages, revisions, packed = site.pages.read(now["pages"]), site.revisions.read(now["revisions"]), site.packed.read()
    else:
        pages, revisions, packed = site.pages.read_keys(touched, now["pages"]), site.revisions.read_groups(touched, now["revisions"]), site.packed.read_keys(touched)
    counted = P.page_catalog(revisions).withColumnRenamed("updated_at", "last_at")
    rows = pages.select("page_id", "slug", "title", X.tags_of(F.col("tags")).alias("tags")).join(counted, "page_id", "left").join(packed, "page_id", "left")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(c, none).alias(c) for c in ("revisions_stored", "revisions_known", "max_rev")]
    return P.decide_archives(rows.select("page_id", "slug", "title", "tags", *counts, "created_by", "created_at", "updated_by", F.col("last_at").alias("updated_at"), "packed_revs", "archive_sha256"))


def _pack(store: P.Store, site: Site, now: dict[str, int], catalog: DataFrame, render: Callable[[DataFrame], DataFrame], aside: str, level: int) -> tuple[DataFrame, int]:
    """page_id, packed_revs, archive_sha256 of the pages whose archive is missing or behind; their archives are stored."""
    wanted = catalog.where(F.col("decision").isin("repack", "adopt"))
    stored = site.revisions.read_groups(wanted.select("page_id"), now["revisions"]).where("content is not null")
    rendered = render(stored.join(wanted.select("page_id", "slug", "title", "tags"), "page_id"))
    archives, n = written(P.checked_counts(P.pack_pages(rendered, level), wanted), f"{aside}/archives")
    if n:
        blob_sink.store_blobs(archives.select(F.col("bytes").alias("content")), f"{store.root}/objects/archives", ".zst")
    return archives.select("page_id", F.col("n").alias("packed_revs"), F.col("sha256").alias("archive_sha256")), n


def _section(store: P.Store, site: Site, kind: str, base: dict | None, fresh: DataFrame, touched: DataFrame | None, key: str) -> str:
    """fresh: key and entry. Entries of keys that nobody touched come from the section of base."""
    if base is not None:
        old = P.section_entries(store, kind, site.name, base[kind])
        held = F.get_json_object("entry", f"$.{P.ENTRY_KEY[kind]}").cast(fresh.schema[key].dataType)
        fresh = old.select(held.alias(key), "entry").join(touched, key, "left_anti").unionByName(fresh)
    return P.put_section(store, kind, site.name, fresh, key)


def publish_changes(store: P.Store, site: Site, shell: str | None, render: Callable[[DataFrame], DataFrame], level: int = P.ZSTD_LEVEL) -> Outcome:
    """Publish the newest versions of the site's tables.

    render: from revisions that have content, beside slug, title and tags of their page, to page_id, rev_no and raw.
    """
    spark = store.spark
    text = P.shell_text(P.parse_shell(shell)).encode()
    aside = f"{store.root}/_aside/{uuid.uuid4().hex}"
    with store.locked() as owner:
        now = {t: getattr(site, t).pinned(None) for t in ("pages", "revisions", "files")}
        if not site.packed.numbers():
            site.packed.create(spark.createDataFrame([], PACKED), ["page_id"])
        note, base = _base(store, site, now)
        pages = paths = None
        n_pages = n_files = -1
        if base is not None:
            named = [site.pages.changes(note["pages"], now["pages"]), site.revisions.changes(note["revisions"], now["revisions"])]
            pages, n_pages = written(named[0].select("page_id").union(named[1].select("page_id")).distinct(), f"{aside}/touched")
            paths, n_files = written(site.files.changes(note["files"], now["files"]).select("path"), f"{aside}/paths")
        shas, packed = dict(base or {}), 0
        change = None
        if n_pages:
            catalog, rows = written(_catalog(site, now, pages), f"{aside}/catalog")
            fresh, packed = _pack(store, site, now, catalog, render, aside, level)
            newest = F.coalesce(F.col("now.archive_sha256"), F.col("then.archive_sha256"))
            current = catalog.alias("then").join(fresh.alias("now"), "page_id", "left").select("page_id", *(F.col(f"then.{c}") for c in catalog.columns if c not in ("page_id", "archive_sha256")), newest.alias("archive_sha256"))
            shas["pages"] = _section(store, site, "pages", base, P.page_entries(current), pages, "page_id")
            known = site.packed.read() if pages is None else site.packed.read_keys(pages)
            # What is packed of pages that are gone, or of which nothing is stored any more, is forgotten.
            live = catalog.where("revisions_stored > 0").select("page_id")
            change = site.packed.begin().upsert(fresh).delete(known.join(live, "page_id", "left_anti"))
            n_pages = rows if n_pages < 0 else n_pages
        if n_files:
            rows = site.files.read(now["files"]) if paths is None else site.files.read_keys(paths, now["files"])
            shas["files"] = _section(store, site, "files", base, P.file_entries(rows), paths, "path")
            n_files = rows.count() if n_files < 0 else n_files
        shas["shell"] = store.put_object("shell", text)
        root = P.put_root(store, site.name, {k: shas[k] for k in ("pages", "files", "shell")})
        if note != now | {"root": root}:
            change = change or site.packed.begin().upsert(spark.createDataFrame([], PACKED))
            change.commit(json.dumps(now | {"root": root}))
        moved = store.move_head(root, owner)
    drop_folder(spark, aside)
    return Outcome(root, moved, n_pages, n_files, packed)
