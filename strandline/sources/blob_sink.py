"""Content-addressed objects as a sink and a source, and their garbage collection.

``df.write.format("blob_store")`` stores column ``content``. A task puts bytes
in their place under their hash (written aside and renamed, so that a lost or
repeated task leaves no half object) and notes what it stored in a part of the
run's manifest, aside. The driver's commit names the parts of the tasks that
count and moves the manifest into place in one step: objects of a run exist for
readers from then on, all at once. An abort drops the manifest; bytes that no
manifest and no row name are slack, which ``mark`` and ``sweep`` remove.

Nothing depends on how often a task ran: bytes are the same under one hash, and
parts of attempts that failed are in no manifest.

Deletion takes two steps. ``mark`` notes objects without a reference, and since
when; an object that is referred to again loses its mark. ``sweep`` deletes what
has been marked for longer than the grace period and still has no reference. An
exact anti-join decides in both: a filter that may err could only spare it for
objects that are dead for certain, and those are the few.

root is a URI that pyarrow's file systems know and every executor reaches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandline.operators.layered import LayeredTable
from strandline.sources.files import blob_name

MANIFEST = "sha256 string, size long, written boolean"
LISTING = "sha256 string, size long, modified long"
MARKS = "sha256 string, since long"


def _store(root: str):
    from pyarrow import fs as stores

    store, base = stores.FileSystem.from_uri(root)
    return store, base.rstrip("/"), stores.FileType


def put_blob(store, base: str, kinds, data: bytes, suffix: str | None = None) -> tuple[str, bool]:
    """The object's hash, and whether it is new. One that is there must have the same size. suffix: objects bear their whole hash and it."""
    sha = hashlib.sha256(data).hexdigest()
    path = f"{base}/{blob_name(sha) if suffix is None else f'{sha[:2]}/{sha[2:4]}/{sha}{suffix}'}"
    known = store.get_file_info(path)
    if known.type != kinds.NotFound:
        if known.size != len(data):
            raise OSError(f"{path} has {known.size} bytes instead of {len(data)}")
        return sha, False
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)
    return sha, True


@dataclass
class Part(WriterCommitMessage):
    """What one task stored: the name of its part of the manifest."""

    name: str
    objects: int


class BlobWriter(DataSourceWriter):
    def __init__(self, root: str, column: int, suffix: str | None = None):
        self.root, self.column, self.suffix, self.run = root, column, suffix, uuid.uuid4().hex

    def write(self, iterator) -> Part:
        store, base, kinds = _store(self.root)
        name, n = f"part-{uuid.uuid4().hex}.json", 0
        store.create_dir(f"{base}/_aside/{self.run}", recursive=True)
        with store.open_output_stream(f"{base}/_aside/{self.run}/{name}") as out:
            for row in iterator:
                data = bytes(row[self.column] or b"")
                sha, fresh = put_blob(store, base, kinds, data, self.suffix)
                out.write(json.dumps({"sha256": sha, "size": len(data), "written": fresh}).encode() + b"\n")
                n += 1
        return Part(name, n)

    def commit(self, messages) -> None:
        store, base, _ = _store(self.root)
        parts = [m.name for m in messages if m is not None and m.objects]
        store.create_dir(f"{base}/_aside/{self.run}", recursive=True)
        with store.open_output_stream(f"{base}/_aside/{self.run}/parts") as out:
            out.write(json.dumps(parts).encode())
        store.create_dir(f"{base}/_manifest", recursive=True)
        store.move(f"{base}/_aside/{self.run}", f"{base}/_manifest/{self.run}")

    def abort(self, messages) -> None:
        store, base, kinds = _store(self.root)
        if store.get_file_info(f"{base}/_aside/{self.run}").type != kinds.NotFound:
            store.delete_dir(f"{base}/_aside/{self.run}")


class _Folder(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ListingReader(DataSourceReader):
    """A partition lists the objects of one folder of the first level."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        store, base, kinds = _store(self.root)
        if store.get_file_info(base).type == kinds.NotFound:
            return []
        from pyarrow import fs as stores

        names = [x.base_name for x in store.get_file_info(stores.FileSelector(base)) if x.type == kinds.Directory]
        return [_Folder(n) for n in sorted(names) if len(n) == 2]

    def read(self, partition: _Folder):
        from pyarrow import fs as stores

        store, base, kinds = _store(self.root)
        if partition is None:  # what Spark passes where there are no partitions
            return
        for inner in store.get_file_info(stores.FileSelector(f"{base}/{partition.name}")):
            if inner.type != kinds.Directory or len(inner.base_name) != 2:
                continue
            for x in store.get_file_info(stores.FileSelector(inner.path)):
                sha = partition.name + inner.base_name + x.base_name
                if x.type == kinds.File and len(sha) == 64:  # no parts of writers that were lost
                    yield sha, x.size, int(x.mtime.timestamp()) if x.mtime else 0


class BlobStore(DataSource):
    """Written: column content. Read: a row an object."""

    @classmethod
    def name(cls) -> str:
        return "blob_store"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are added and never replaced: use mode append")
        return BlobWriter(self.options["path"], schema.fieldNames().index("content"), self.options.get("suffix"))


def store_blobs(rows: DataFrame, root: str, suffix: str | None = None) -> None:
    """Store column content of rows under root; with a suffix, named as a publication names its objects."""
    rows.sparkSession.dataSource.register(BlobStore)
    out = rows.select("content").write.format("blob_store").option("path", root).mode("append")
    (out if suffix is None else out.option("suffix", suffix)).save()


def list_blobs(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(BlobStore)
    return spark.read.format("blob_store").option("path", root).load()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """sha256, size, written of all committed runs, a row a stored value."""
    from pyarrow import fs as stores

    store, base, kinds = _store(root)
    paths = []
    if store.get_file_info(f"{base}/_manifest").type != kinds.NotFound:
        for run in store.get_file_info(stores.FileSelector(f"{base}/_manifest")):
            with store.open_input_stream(f"{run.path}/parts") as file:
                paths += [f"{root.rstrip('/')}/_manifest/{run.base_name}/{name}" for name in json.loads(file.read())]
    return spark.read.schema(MANIFEST).json(paths) if paths else spark.createDataFrame([], MANIFEST)


def open_marks(spark: SparkSession, path: str) -> LayeredTable:
    """The table of marks: one row an object without a reference, and since when."""
    marks = LayeredTable(spark, path)
    if not marks.numbers():
        marks.create(spark.createDataFrame([], MARKS), ["sha256"])
    return marks


def mark(marks: LayeredTable, listed: DataFrame, live: DataFrame, now: int) -> int:
    """Mark listed objects that live (sha256) does not name; drop marks of those that it names, or that are gone. The new version."""
    live = live.where("sha256 is not null").select("sha256").distinct()
    dead = listed.select("sha256").join(live, "sha256", "left_anti")
    change = marks.begin()
    known = marks.read(change.version).select("sha256")
    change.insert_or_ignore(dead.select("sha256", F.lit(now).cast("long").alias("since")))
    change.delete(known.join(dead, "sha256", "left_anti"))
    return change.commit("mark")


def sweep(marks: LayeredTable, live: DataFrame, root: str, now: int, grace_s: int) -> DataFrame:
    """sha256, deleted: objects marked for at least grace_s that live does not name now. Their marks go.

    The rows come from a table that is written before anything is deleted, and an object that is gone is no
    error: a task that runs twice, or a sweep that is repeated after a failure, does the same.
    """
    from strandline.session import shared_folder, written

    live = live.where("sha256 is not null").select("sha256").distinct()
    doomed = marks.read().where(F.col("since") <= now - grace_s).select("sha256").join(live, "sha256", "left_anti")
    doomed, _ = written(doomed, shared_folder(marks.spark, "doomed"))

    def run(batches):
        store, base, kinds = _store(root)
        for batch in batches:
            found = []
            for sha in batch.column("sha256").to_pylist():
                path = f"{base}/{blob_name(sha)}"
                there = store.get_file_info(path).type != kinds.NotFound
                if there:
                    store.delete_file(path)
                found.append(there)
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(found, pa.bool_())], names=["sha256", "deleted"])

    out, _ = written(doomed.mapInArrow(run, "sha256 string, deleted boolean"), shared_folder(marks.spark, "swept"))
    marks.delete(out.select("sha256"), note="sweep")
    return out
