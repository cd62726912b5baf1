"""Ordered migrations of a site's tables: every step a version has not seen, in one commit.

The number of steps applied is kept in the site's table ``meta`` under
``schema_version``, so that it is committed with what the steps changed. A site
without tables is created by going through all steps from nothing. A site that
is newer than the steps known here is refused, and so is one whose number
cannot be read. Blobs that steps left without a reference are told to the caller
after the commit: a failure before it changes nothing, one after it leaves
unused blobs and never a row without its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import merge, queue, repair
from strandline.operators.versions import VersionedSite

Tables = dict[str, DataFrame]
VERSION_KEY = "schema_version"

#: The tables of step 1.
FIRST = {
    "meta": "key string, value string",
    "pages": "page_id long, slug string, title string, tags string, updated_at long, discovered_at long",
    "revisions": "page_id long, rev_no long, rev_id string, ts long, author long, content string, fetched_at long",
    "denied": "page_id long, rev_no long, reason string",
    "files": "path string, url string, sha256 string, size long, status string, first_seen long, saved_at long",
    "jobs": "id long, kind string, payload string, priority long, status string, run_at long, attempts long, max_attempts long, last_error string",
    "out_state": "page_id long, packed_revs long, packed_at long",
}


class Newer(RuntimeError):
    """The site was written by a later version."""


@dataclass
class Context:
    """What repairs need to know, and hashes of the blobs that they orphaned."""

    spark: SparkSession
    site: str
    now: int
    orphans: list[DataFrame]


Step = Callable[[Tables, Context], Tables]


def create_tables(tables: Tables, context: Context) -> Tables:
    return {name: context.spark.createDataFrame([], ddl) for name, ddl in FIRST.items() if name not in tables}


def with_column(table: str, column: str, kind: str) -> Step:
    """A step that adds a column of nulls; a table that has it is left alone."""

    def step(tables: Tables, context: Context) -> Tables:
        found = tables[table]
        return {} if column in found.columns else {table: found.withColumn(column, F.lit(None).cast(kind))}

    return step


def retuned(*kinds: str) -> Step:
    """A step that gives all jobs of these kinds, whatever their status, the priority that new ones get."""

    def step(tables: Tables, context: Context) -> Tables:
        priority = F.col("priority")
        for kind in kinds:
            priority = F.when(F.col("kind") == kind, F.lit(PRIORITIES[kind]).cast("long")).otherwise(priority)
        return {"jobs": tables["jobs"].withColumn("priority", priority)}

    return step


def shell_again(tables: Tables, context: Context) -> Tables:
    """Pending shell jobs are due at once."""
    due = (F.col("kind") == "shell.sync") & (F.col("status") == "pending")
    return {"jobs": tables["jobs"].withColumn("run_at", F.when(due, F.lit(0).cast("long")).otherwise(F.col("run_at")))}


def repaired(step: Callable) -> Step:
    """A repair of the file table as a step."""

    def run(tables: Tables, context: Context) -> Tables:
        out = step(tables["files"], tables["jobs"], tables["revisions"], context.site, context.now, 1)
        context.orphans.append(out.orphans)
        return {"files": out.files, "jobs": out.jobs}

    return run


#: Priorities of each kind, those that steps 3 and 4 moved included.
PRIORITIES = queue.PRIORITIES | {"theme.crawl": 10}
STEPS: tuple[Step, ...] = (
    create_tables,
    with_column("files", "content_type", "string"),
    retuned("shell.sync", "file.fetch", "theme.crawl", "page.sync"),
    retuned("out.update"),
    shell_again,
    repaired(repair.repair_references),
    repaired(repair.repair_brackets),
    with_column("out_state", "archive_sha256", "string"),
)


def schema_version(tables: Tables) -> int:
    """Steps that the tables have seen; 0 without tables."""
    if "meta" not in tables:
        return 0
    found = tables["meta"].where(F.col("key") == VERSION_KEY).select("value").head()
    if found is None:
        return 0
    if not found[0] or not found[0].isdigit():
        raise ValueError(f"unreadable schema version: {found[0]!r}")
    return int(found[0])


def migrated(tables: Tables, context: Context, upto: int | None = None, steps: tuple[Step, ...] = STEPS) -> tuple[Tables, int, int]:
    """The tables after all steps up to a number (all of them by default), and the versions before and after."""
    upto = len(steps) if upto is None else upto
    before = schema_version(tables)
    if before > len(steps):
        raise Newer(f"the site has schema version {before}; {len(steps)} are known here")
    found = dict(tables)
    for step in steps[before:upto]:
        found |= step(found, context)
    if upto > before:
        row = context.spark.createDataFrame([(VERSION_KEY, str(upto))], FIRST["meta"])
        found["meta"] = merge.replace_rows(found["meta"], row, ["key"])
    return found, before, max(before, upto)


def migrate(site: VersionedSite, name: str, now: int, upto: int | None = None, steps: tuple[Step, ...] = STEPS) -> tuple[int, list[DataFrame]]:
    """Bring a site up to date in one commit; its schema version, and hashes of blobs that the steps orphaned.

    Nothing is written where nothing is to do, or where a step fails.
    """
    newest = max(site.numbers(), default=0)
    tables = site.tables() if newest else {}
    context = Context(site.spark, name, now, [])
    found, before, after = migrated(tables, context, upto, steps)
    if after > before:
        changed = {k: t for k, t in found.items() if t is not tables.get(k)}
        site.commit(changed, expected=newest, note=f"schema {after}")
        # Held against what was committed: a row that names a blob again keeps it.
        live = site.tables()["files"].select("sha256") if "files" in site.tables() else None
        orphans = [o.join(live, "sha256", "left_anti") if live is not None else o for o in context.orphans]
        return after, orphans
    return after, []
