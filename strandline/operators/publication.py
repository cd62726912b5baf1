"""Content-addressed publication: archives, sections, root and the HEAD pointer.

Objects are named by the SHA-256 of their bytes, so writing one twice is
harmless and executors may be lost at any time; HEAD moves last, and only if it
would change. Archives and parts of sections are written by tasks; the driver
strings the parts together and writes the three small objects.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import merge
from strandline.operators.versions import VersionedTable
from strandline.sources import files

FORMAT = 3
PAGE_ENTRY = """id:string,slug:string,title:string,tags:array<string>,revisions_stored:long,revisions_known:long,max_rev:long,
  created_by:string,created_at:long,updated_by:string,updated_at:long,archive:string,archive_sha256:string"""
FILE_ENTRY = "path:string,sha256:string,size:long,content_type:string,status:string,blob:string"
#: What an entry of a section begins with.
ENTRY_KEY = {"pages": "id", "files": "path"}
#: Bytes of a section that one task writes.
PART_BYTES = 64 << 20
ZSTD_LEVEL = 19
#: Bytes of one page's tar that are held before it is compressed.
HELD_BYTES = 32 << 20


@lru_cache(maxsize=4)
def compressor(level: int):
    """One of a worker for all of its pages: setting a high level up takes far longer than a small page."""
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_checksum=False, threads=0)


class _Tape:
    """Where a tar is written: held whole while it is short, compressed as it comes beyond HELD_BYTES."""

    def __init__(self, level: int):
        self.level, self.held, self.out, self.stream = level, io.BytesIO(), io.BytesIO(), None

    def write(self, data: bytes) -> int:
        if self.stream is not None:
            self.stream.write(data)
        else:
            self.held.write(data)
            if self.held.tell() > HELD_BYTES:
                import zstandard

                self.stream = zstandard.ZstdCompressor(level=self.level, write_checksum=False, threads=0).stream_writer(self.out, closefd=False)
                self.stream.write(self.held.getvalue())
                self.held = None
        return len(data)

    def finish(self) -> bytes:
        if self.stream is None:
            # The size is known: the compressor's tables are no larger than the page needs.
            return compressor(self.level).compress(self.held.getvalue())
        self.stream.close()
        return self.out.getvalue()


class Archive:
    """A tar under zstd, fed an entry at a time. The same entries always give the same bytes: which way they take depends on their size alone."""

    def __init__(self, level: int = ZSTD_LEVEL):
        self.tape = _Tape(level)
        self.tar = tarfile.open(fileobj=self.tape, mode="w|", format=tarfile.GNU_FORMAT)
        self.count = 0

    def add(self, name: str, content: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size, info.mtime, info.uid, info.gid, info.mode = len(content), 0, 0, 0, 0o644
        self.tar.addfile(info, io.BytesIO(content))
        self.count += 1

    def finish(self) -> bytes:
        self.tar.close()
        return self.tape.finish()


def archive_bytes(entries: list[tuple[str, bytes]], level: int = ZSTD_LEVEL) -> bytes:
    archive = Archive(level)
    for name, content in entries:
        archive.add(name, content)
    return archive.finish()


def pack_pages(rendered: DataFrame, level: int = ZSTD_LEVEL) -> DataFrame:
    """page_id, n, sha256, bytes: one archive a page. rendered: page_id, rev_no, raw.

    Rows of a page stream in rev_no order through one task; a page's revisions
    are the archive's content, so they must meet, but no page is collected elsewhere.
    """
    parted = rendered.select("page_id", "rev_no", X.entry_name(F.col("rev_no")).alias("name"), "raw").repartition("page_id").sortWithinPartitions("page_id", "rev_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, archive = None, None

        def done() -> pd.DataFrame:
            data = archive.finish()
            return pd.DataFrame({"page_id": [page], "n": [archive.count], "sha256": [hashlib.sha256(data).hexdigest()], "bytes": [data]})

        for batch in batches:
            for pid, name, raw in zip(batch["page_id"], batch["name"], batch["raw"], strict=True):
                if archive is not None and pid != page:
                    yield done()
                    archive = None
                if archive is None:
                    page, archive = pid, Archive(level)
                archive.add(name, raw.encode())
        if archive is not None:
            yield done()

    return parted.mapInPandas(run, "page_id long, n long, sha256 string, bytes binary")


def unpack_pages(packed: DataFrame) -> DataFrame:
    """page_id, name, content of each entry of archives (page_id, bytes), streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for pid, data in zip(batch["page_id"], batch["bytes"], strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    for entry in tar:
                        yield pd.DataFrame({"page_id": [pid], "name": [entry.name], "content": [tar.extractfile(entry).read().decode()]})

    return packed.select("page_id", "bytes").mapInPandas(run, "page_id long, name string, content string")


def checked_counts(packed: DataFrame, catalog: DataFrame) -> DataFrame:
    """packed, failing when it runs if an archive holds another number of revisions than the catalog says."""
    joined = packed.join(catalog.select("page_id", "revisions_stored"), "page_id")
    ok = F.when(F.col("n") != F.col("revisions_stored"), F.raise_error(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(": archive and catalog disagree")))).otherwise(F.lit(True))
    return joined.withColumn("_ok", ok).where("_ok").select(packed.columns)


def page_catalog(revs: DataFrame) -> DataFrame:
    """Counts, head and first/last stored revision of each page; one shuffle on page_id.

    The key a min_by/max_by orders on is null where nothing is stored, so such
    revisions never win; pages with nothing stored get nulls.
    """
    stored_no = F.when(F.col("content").isNotNull(), F.col("rev_no"))
    return revs.groupBy("page_id").agg(
        F.count("content").alias("revisions_stored"),
        F.count(F.lit(1)).alias("revisions_known"),
        F.coalesce(F.max("rev_no"), F.lit(0).cast("long")).alias("max_rev"),
        F.min_by("author", stored_no).alias("created_by"),
        F.min_by("ts", stored_no).alias("created_at"),
        F.max_by("author", stored_no).alias("updated_by"),
        F.max_by("ts", stored_no).alias("updated_at"),
    )


def page_entries(catalog: DataFrame) -> DataFrame:
    """page_id and entry: the canonical JSON of each page, archive fields null where nothing is stored."""
    stored = F.col("revisions_stored") > 0
    sha = F.when(stored, F.col("archive_sha256"))
    sha_of = F.col("archive_sha256")
    archive = F.when(stored, X.object_path(sha_of, "archives", ".zst"))
    entry = F.struct(
        F.col("page_id").cast("string").alias("id"), "slug", "title", "tags", "revisions_stored", "revisions_known", "max_rev",
        *(F.col(c).cast("string").alias(c) if c.endswith("by") else F.col(c) for c in ("created_by", "created_at", "updated_by", "updated_at")),
        archive.alias("archive"), sha.alias("archive_sha256"),
    )
    return catalog.select("page_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def file_entries(file_rows: DataFrame) -> DataFrame:
    entry = F.struct("path", "sha256", "size", "content_type", "status", X.blob_path(F.col("sha256")).alias("blob"))
    return file_rows.select("path", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def shell_text(shell: dict) -> str:
    """Site titles; landing only if there is one, theme roots unquoted."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    lines = [f"title: {quote(shell['title'])}", f"subtitle: {quote(shell['subtitle'])}"]
    if shell.get("landing"):
        lines.append(f"landing: {quote(shell['landing'])}")
    return "".join(f"{x}\n" for x in [*lines, *(f"theme_root: {r}" for r in shell.get("theme_roots", []))])


def object_name(kind: str, sha: str) -> str:
    """The layout of the format; kinds are archives, pages, files and shell."""
    extension = {"archives": ".zst", "pages": ".json", "files": ".json", "shell": ".txt"}[kind]
    return f"objects/{kind}/{sha[:2]}/{sha[2:4]}/{sha}{extension}"


def root_name(sha: str) -> str:
    return f"roots/{sha[:2]}/{sha[2:4]}/{sha}.json"


class Store:
    """Objects under a root folder, through Hadoop's file system of that path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._p(name)).getLen()

    def get(self, name: str) -> bytes:
        return files.read_bytes(self._fs, self._p(name))

    def put(self, name: str, data: bytes) -> None:
        """An object that exists already must have this size."""
        aside = f"{name}.{uuid.uuid4().hex}.part"
        if not self.exists(name):
            files.write_bytes(self._fs, self._p(aside), data)
            if files.move(self.spark, self._p(aside), self._p(name), overwrite=False):
                return
            self._fs.delete(self._p(aside), False)
        if self.size(name) != len(data):
            raise OSError(f"{name} has {self.size(name)} bytes, not {len(data)}")

    def put_object(self, kind: str, data: bytes) -> str:
        sha = hashlib.sha256(data).hexdigest()
        self.put(object_name(kind, sha), data)
        return sha

    def put_list(self, kind: str, opening: str, entries: DataFrame, order: str, closing: str) -> str:
        """An object of the column ``entry`` of all rows in total order, between opening and closing; the hash of its bytes.

        Entries are computed once; tasks then sort and write ranges of the order of about PART_BYTES each, commas between
        entries. The driver's JVM strings the files together and hashes them in the same stream, in a small buffer: a hash
        over all bytes can only be taken in their order. Bytes of the section never enter Python, and no task holds it.
        """
        aside = f"_aside/{uuid.uuid4().hex}"
        seen = Observation()
        size = F.sum(F.octet_length("entry") + 1)
        entries.select(order, "entry").observe(seen, size.alias("bytes")).write.parquet(f"{self.root}/{aside}/rows")
        ranges = -(-(seen.get["bytes"] or 1) // PART_BYTES)
        rows = self.spark.read.schema(entries.select(order, "entry").schema).parquet(f"{self.root}/{aside}/rows")
        dealt = rows.repartitionByRange(ranges, order).sortWithinPartitions(order)
        dealt.select("entry").write.option("lineSep", ",").text(f"{self.root}/{aside}/parts")
        whole = self._p(f"{aside}/whole")
        sha, size = self._join(f"{aside}/parts", whole, opening.encode(), closing.encode())
        if not files.move(self.spark, whole, self._p(object_name(kind, sha)), overwrite=False) and self.size(object_name(kind, sha)) != size:
            raise OSError(f"{object_name(kind, sha)} does not have {size} bytes")
        self._fs.delete(self._p(aside), True)
        return sha

    def _join(self, folder: str, whole, opening: bytes, closing: bytes) -> tuple[str, int]:
        """Hash and size of the file whole: opening, the folder's parts by number without their last comma, closing."""
        parts = [s for s in self._fs.listStatus(self._p(folder)) if s.getPath().getName().startswith("part-") and s.getLen()]
        parts.sort(key=lambda s: int(s.getPath().getName().split("-")[1]))
        digest = self._jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = self._jvm.java.security.DigestOutputStream(self._fs.create(whole, True), digest)
        out.write(bytearray(opening))
        size = len(opening) + len(closing)
        for part in parts:
            length = part.getLen() - (part is parts[-1])
            stream = self._fs.open(part.getPath())
            self._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, length)
            stream.close()
            size += length
        out.write(bytearray(closing))
        out.close()
        return bytes(b & 255 for b in digest.digest()).hex(), size

    @contextmanager
    def locked(self, lease_s: int = 3_600):
        """The exclusive right to publish; gives the owner's token. A lock older than the lease was left by a lost writer and is taken over.

        A writer that outlives its lease finds another token in the lock: it does not delete that, and move_head() refuses it.
        """
        lock, owner = self._p(".publish.lock"), uuid.uuid4().hex
        if not self._fs.createNewFile(lock):
            age = time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000
            taken = self._p(f"_aside/{uuid.uuid4().hex}.lock")
            if age < lease_s or not files.move(self.spark, lock, taken, overwrite=False) or not self._fs.createNewFile(lock):
                raise RuntimeError("another publication is running; try again later")
        files.write_bytes(self._fs, lock, owner.encode())
        try:
            yield owner
        finally:
            if self.owns(owner):
                self._fs.delete(lock, False)

    def owns(self, owner: str) -> bool:
        """Whether the lock is this owner's still."""
        return self.exists(".publish.lock") and self.get(".publish.lock") == owner.encode()

    def head(self) -> str | None:
        if not self.exists("HEAD"):
            return None
        value = self.get("HEAD").decode().strip()
        if len(value) != 64 or value.strip("0123456789abcdef"):
            raise ValueError("HEAD is malformed")
        return value

    def move_head(self, sha: str, owner: str | None = None) -> bool:
        """Whether HEAD changed. It is replaced in one step: a reader meets the old one or the new one. owner: who must hold the lock for it."""
        if owner is not None and not self.owns(owner):
            raise RuntimeError("the lock was taken over by another publication")
        if self.head() == sha:
            return False
        aside = self._p(f"_aside/{uuid.uuid4().hex}.head")
        files.write_bytes(self._fs, aside, f"{sha}\n".encode())
        return files.move(self.spark, aside, self._p("HEAD"), overwrite=True)


def _frame(kind: str, site: str) -> tuple[str, str]:
    """What stands before and behind the entries of a section."""
    return f'{{"v":{FORMAT},"site":{json.dumps(site, ensure_ascii=False)},"{kind}":[', "]}\n"


def put_section(store: Store, kind: str, site: str, entries: DataFrame, order: str) -> str:
    """Write a section as compact JSON in the total order of its key; returns the hash of its bytes."""
    opening, closing = _frame(kind, site)
    return store.put_list(kind, opening, entries, order, closing)


def section_entries(store: Store, kind: str, site: str, sha: str) -> DataFrame:
    """Column entry: the JSON of each entry of a section, as it stands there.

    The file is split like lines of text, at ``},{"id":`` (``"path"`` for files): an entry begins with its key, and a quote
    inside a JSON string is escaped, so this stands between two entries and nowhere else. Each task reads its byte range.
    """
    opening, closing = _frame(kind, site)
    first = f'{{"{ENTRY_KEY[kind]}":'
    value = F.col("value")
    raw = store.spark.read.text(f"{store.root}/{object_name(kind, sha)}", lineSep=f"}},{first}").where(value != opening + closing)
    body = F.when(value.startswith(opening), F.substr(value, F.lit(len(opening) + 1))).otherwise(F.concat(F.lit(first), value))
    last = F.endswith(body, F.lit("}" + closing))
    return raw.select(F.when(last, F.substr(body, F.lit(1), F.length(body) - len(closing))).otherwise(F.concat(body, F.lit("}"))).alias("entry"))


def read_section(store: Store, kind: str, site: str, sha: str) -> DataFrame:
    """A row an entry of a section. An entry that is no JSON fails."""
    schema = f"struct<{ {'pages': PAGE_ENTRY, 'files': FILE_ENTRY}[kind]}>"
    return section_entries(store, kind, site, sha).select(F.from_json("entry", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def parse_shell(value: str | None) -> dict:
    """The stored shell; broken JSON fails the publication, none is an empty one."""
    if value is None:
        return {"title": "", "subtitle": ""}
    shell = json.loads(value)
    if not isinstance(shell, dict) or not {"title", "subtitle"} <= set(shell):
        raise ValueError("the stored shell is malformed")
    return shell


def put_root(store: Store, site: str, shas: dict[str, str]) -> str:
    root = (json.dumps({"v": FORMAT, "site": site, **shas}, separators=(",", ":"), ensure_ascii=False) + "\n").encode()
    sha = hashlib.sha256(root).hexdigest()
    store.put(root_name(sha), root)
    return sha


def publish(store: Store, site: str, pages: DataFrame, file_rows: DataFrame, shell: str | None, out_state: DataFrame | None = None, cache: VersionedTable | None = None) -> tuple[str, bool]:
    """Sections and shell, then root, then the cache, then HEAD; returns the root's hash and whether HEAD moved.

    pages and file_rows come from pinned versions, so they are one snapshot. shell: its stored JSON.
    out_state (page_id, packed_revs, archive_sha256) is what this publication packed; the cache commits a
    version only where rows of it changed.
    """
    with store.locked() as owner:
        text = shell_text(parse_shell(shell)).encode()
        shas = {"pages": put_section(store, "pages", site, page_entries(pages), "page_id"), "files": put_section(store, "files", site, file_entries(file_rows), "path"), "shell": store.put_object("shell", text)}
        sha = put_root(store, site, shas)
        if cache is not None and out_state is not None:
            update_cache(cache, out_state)
        return sha, store.move_head(sha, owner)


def update_cache(cache: VersionedTable, out_state: DataFrame) -> bool:
    """Whether a version was committed: only where packed_revs or the hash of some page changed."""
    if not cache.versions():
        cache.commit(out_state)
        return True
    old = cache.read()
    changed = out_state.join(old, [out_state[c].eqNullSafe(old[c]) for c in ("page_id", "packed_revs", "archive_sha256")], "left_anti")
    if changed.isEmpty():
        return False
    cache.commit(merge.upsert(old, out_state, ["page_id"], dict.fromkeys(("packed_revs", "archive_sha256"), merge.keep_new)))
    return True


def read_publication(store: Store) -> tuple[dict, DataFrame, DataFrame]:
    """Root, pages and files that HEAD points at; pages and files have a row an entry."""
    sha = store.head()
    if sha is None:
        raise FileNotFoundError("nothing is published")
    root = json.loads(store.get(root_name(sha)))
    return root, *(read_section(store, kind, root["site"], root[kind]) for kind in ("pages", "files"))


def verify_publication(store: Store) -> None:
    """Reader's check: every object that HEAD's root names has the hash it is named by."""
    root = read_publication(store)[0]
    for kind in ("pages", "files", "shell"):
        if files.sha256_of(store.spark, store._fs, store._p(object_name(kind, root[kind]))) != root[kind]:
            raise OSError(f"the {kind} object is damaged")


def new_objects(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of wanted (sha256, ...) whose object is not there yet, once each."""
    return wanted.dropDuplicates(["sha256"]).join(present.select("sha256"), "sha256", "left_anti")


def decide_archives(catalog: DataFrame) -> DataFrame:
    """none, reuse, adopt or repack for each page: by what is stored, what was packed and whether its hash is known."""
    return catalog.withColumn("decision", decision(F.col("revisions_stored"), F.col("packed_revs"), F.col("archive_sha256")))


def decision(stored: Column, packed: Column, sha: Column) -> Column:
    return F.when(stored == 0, F.lit("none")).when(packed == stored, F.when(sha.isNotNull(), F.lit("reuse")).otherwise(F.lit("adopt"))).otherwise(F.lit("repack"))
