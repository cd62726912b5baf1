"""Readers of an older archive's file tree, and of captured service answers."""

from __future__ import annotations

import re
import tomllib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.functions import text as X
from strandline.sources.shard_tree import shard_tree


def sharded_journals(spark: SparkSession, root: str) -> DataFrame:
    """key and journal of each file exactly three levels below root; the key is its path without the slashes, and a filter on it prunes folders."""
    return shard_tree(spark, root, depth=3).select("key", X.journal(F.col("raw")).alias("journal"))


def revision_files(spark: SparkSession, root: str) -> DataFrame:
    """Frontmatter of every r*.txt under root; none if there is no such folder. A filter on rel prunes folders."""
    return shard_tree(spark, root, names="r*.txt").select("rel", X.frontmatter(F.col("raw")).alias("f"), "raw")


def import_revisions(journals: DataFrame, files: DataFrame, site: str) -> DataFrame:
    """page_id, rev_no, rev_id, ts, author, content: what the journals know, with the content that files of this site give.

    A file whose page, site or revision differs from its journal gives nothing.
    """
    known = journals.select(F.col("key").try_cast("bigint").alias("page_id"), F.explode("journal.revisions").alias("r")).select("page_id", "r.*").dropDuplicates(["page_id", "rev_no"])
    content = files.where((F.col("f.site") == site) & F.col("f.page_id").isNotNull()).select(F.col("f.page_id").alias("page_id"), F.col("f.revision").alias("rev_no"), F.col("f.body").alias("content"))
    return known.join(content.dropDuplicates(["page_id", "rev_no"]), ["page_id", "rev_no"], "left").select("page_id", "rev_no", "rev_id", "ts", "author", "content")


ENVELOPE = "status string, body string, message string"
LOG = "entries array<struct<type:string,revNumber:bigint,createdAt:string,user:struct<id:bigint>,meta:struct<version_id:string,source:struct<version_id:string>>>>"


def envelope(answer: Column) -> Column:
    """body of an ok answer, else what was refused."""
    e = F.from_json(answer, ENVELOPE)
    return F.struct(F.when(e["status"] == "ok", e["body"]).alias("body"), F.when(e.isNull() | e["status"].isNull(), F.lit("Parse")).when(e["status"] != "ok", e["status"]).alias("refused"))


def snapshots_above(log: DataFrame, max_rev: int) -> DataFrame:
    """rev_no, version_id, ts, author of logged versions above max_rev, once a rev_no (the greatest version_id), newest first."""
    e = log.select(F.explode(F.from_json("log", LOG)["entries"]).alias("e"))
    rows = e.select(F.col("e.revNumber").alias("rev_no"), F.coalesce("e.meta.version_id", "e.meta.source.version_id").alias("version_id"), F.coalesce(X.iso8601(F.col("e.createdAt")), F.lit(0).cast("long")).alias("ts"), F.coalesce("e.user.id", F.lit(0).cast("long")).alias("author"))
    kept = rows.where((F.col("rev_no") > max_rev) & F.col("version_id").isNotNull())
    best = kept.groupBy("rev_no").agg(F.max(F.struct("version_id", "ts", "author")).alias("b")).select("rev_no", "b.*")
    return best.orderBy(F.desc("rev_no"))


#: The settings of an instance and what they are when left out.
SETTINGS = {
    "data_dir": "data",
    "timeout_s": 30,
    "rate_limit_ms": 2000,
    "monitor_interval_s": 1800,
    "shell_interval_s": 86400,
    "out_interval_s": 300,
    "backfill_interval_s": 3600,
    "zstd_level": 19,
}
#: The platforms of sites. One is named by its slug; the other by its host, with a key and a name if need be.
BY_SLUG, BY_HOST = "wikidot", "rufoundation"


@dataclass(frozen=True)
class Site:
    """A configured site: the directory that it is kept in, its platform and address."""

    directory: str
    platform: str
    host: str
    api_key: str | None = None


@dataclass(frozen=True)
class Config:
    """An instance: its settings and its sites in order."""

    name: str
    settings: dict
    sites: tuple[Site, ...]

    @property
    def root(self) -> str:
        return f"{self.settings['data_dir']}/{self.name}"

    def state_dir(self, site: Site) -> str:
        """Private state: the site's tables."""
        return f"{self.root}/meta/{site.directory}"

    def out_dir(self, site: Site) -> str:
        """What is published of the site."""
        return f"{self.root}/out/{site.directory}"


def _only(found: dict, known: set[str], what: str) -> None:
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown fields of {what}: {unknown}")


def _site(found: dict) -> Site:
    _only(found, {"type", "host", "api_key", "name"}, "a site")
    if missing := sorted({"type", "host"} - set(found)):
        raise ValueError(f"a site lacks {missing}")
    if not all(isinstance(v, str) for v in found.values()):
        raise ValueError("a site's fields are texts")
    platform, host = found["type"], found["host"]
    if platform == BY_SLUG:
        if "api_key" in found or "name" in found:
            raise ValueError(f"site {host!r}: api_key and name are for sites of the type {BY_HOST!r}")
        return Site(host, platform, host)
    if platform != BY_HOST:
        raise ValueError(f"site {host!r}: unknown type {platform!r}")
    if not host.strip():
        raise ValueError("a site has an empty host")
    bare = re.sub(r"^https?://", "", host.strip()).rstrip("/")
    # ASCII letters only: the directory is part of published addresses.
    directory = found.get("name", "".join(c.lower() if c.isascii() else c for c in bare))
    return Site(directory, platform, host, found.get("api_key"))


def load_config(text: str) -> Config:
    """An instance from TOML: top-level settings, and [instance] with its name and sites.

    Unknown fields, settings of another kind, no site, and two sites with one directory are errors.
    """
    found = tomllib.loads(text)
    _only(found, {*SETTINGS, "instance"}, "the file")
    settings = {k: v for k, v in found.items() if k != "instance"}
    for key, value in settings.items():
        if type(value) is not type(SETTINGS[key]):
            raise ValueError(f"{key} is no {type(SETTINGS[key]).__name__}: {value!r}")
    for key in ("timeout_s", "rate_limit_ms"):
        if settings.get(key, 0) < 0:
            raise ValueError(f"{key} is negative")
    instance = found.get("instance")
    if not isinstance(instance, dict) or "name" not in instance or "sites" not in instance:
        raise ValueError("no [instance] with a name and sites")
    _only(instance, {"name", "sites"}, "the instance")
    if not instance["sites"]:
        raise ValueError(f"no site is configured for {instance['name']}")
    sites = tuple(_site(x) for x in instance["sites"])
    twice = sorted(d for d, n in Counter(s.directory for s in sites).items() if n > 1)
    if twice:
        raise ValueError(f"two sites share a directory: {twice}")
    return Config(instance["name"], SETTINGS | settings, sites)


class _LinkReader(DataSourceReader):
    """A partition reads the links of one folder, or the whole tree under a folder of the second level."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        import os

        found = [("", False)]
        if os.path.isdir(self.root):
            for one in sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)):
                found.append((one, False))
                found += [(os.path.join(one, e.name), True) for e in os.scandir(os.path.join(self.root, one)) if e.is_dir(follow_symlinks=False)]
        return [InputPartition(x) for x in found]

    def read(self, partition):
        import os

        top, deep = partition.value
        for folder, below, names in os.walk(os.path.join(self.root, top)):
            for name in sorted([*names, *below]):
                path = os.path.join(folder, name)
                if os.path.islink(path):
                    yield os.path.relpath(path, self.root), os.readlink(path)
            if not deep:
                break


class SymlinkTree(DataSource):
    """Rows (link, target) of a tree of symbolic links on a file system that all executors mount."""

    @classmethod
    def name(cls):
        return "symlink_tree"

    def schema(self):
        return "link string, target string"

    def reader(self, schema):
        return _LinkReader(self.options["path"])


def symlink_blobs(spark: SparkSession, root: str) -> DataFrame:
    """path and sha256: the hash is the target's last three segments joined."""
    spark.dataSource.register(SymlinkTree)
    rows = spark.read.format("symlink_tree").option("path", root).load()
    tail = F.regexp_replace("target", r"^.*?([^/]+)/([^/]+)/([^/]+)$", "$1$2$3")
    return rows.select(F.col("link").alias("path"), tail.alias("sha256")).where(X.is_sha256(F.col("sha256")))
