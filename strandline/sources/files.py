"""Small objects and renames through Hadoop's file systems; content-addressed blobs written by executors."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def read_bytes(fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(fs, path, data: bytes) -> None:
    """A small object, replacing what is there."""
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def move(spark: SparkSession, source, target, overwrite: bool) -> bool:
    """Rename in one step; without overwrite False, and nothing moved, if the target is there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    context.mkdir(target.getParent(), None, True)
    try:
        context.rename(source, target, options)
    except Py4JJavaError as error:
        if not overwrite and "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def sha256_of(spark: SparkSession, fs, path) -> str:
    """The hash of an object's bytes, streamed through the JVM."""
    jvm = spark.sparkContext._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = fs.open(path)
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 1 << 16, True)
    return jvm.java.util.HexFormat.of().formatHex(digest.digest())


def blob_name(sha: str) -> str:
    return f"{sha[:2]}/{sha[2:4]}/{sha[4:]}"


def write_blobs(blobs: DataFrame, root: str) -> DataFrame:
    """sha256, size, written of each row's content, stored as root/aa/bb/rest by the executors.

    root: a URI that pyarrow's file systems know and every executor reaches. A
    blob that is there already is left alone; others are written under a name
    of their own and renamed, so a lost or repeated task leaves no half blob.
    """

    def run(batches):
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(root)
        for batch in batches:
            found = []
            for content in batch.column("content").to_pylist():
                data = content or b""
                sha = hashlib.sha256(data).hexdigest()
                path = f"{base}/{blob_name(sha)}"
                fresh = store.get_file_info(path).type == stores.FileType.NotFound
                if fresh:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, path)
                found.append((sha, len(data), fresh))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.bool_())], names=["sha256", "size", "written"])

    return blobs.select("content").mapInArrow(run, "sha256 string, size long, written boolean")


def adopt_blobs(links: DataFrame, root: str) -> DataFrame:
    """path, sha256, size, adopted: files (path, sha256, target) of an older tree, stored as root/aa/bb/rest.

    A hard link where both lie on one local file system, else a copy that is renamed into place.
    """

    def run(batches):
        import os
        import shutil

        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(root)
        for batch in batches:
            sizes, adopted = [], []
            for sha, target in zip(batch.column("sha256").to_pylist(), batch.column("target").to_pylist(), strict=True):
                path = f"{base}/{blob_name(sha)}"
                fresh = store.get_file_info(path).type == stores.FileType.NotFound
                if fresh:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    try:
                        os.link(target, part)
                    except OSError:
                        with open(target, "rb") as source, store.open_output_stream(part) as out:
                            shutil.copyfileobj(source, out, 1 << 20)
                    store.move(part, path)
                sizes.append(store.get_file_info(path).size)
                adopted.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("sha256"), pa.array(sizes, pa.int64()), pa.array(adopted)], names=["path", "sha256", "size", "adopted"])

    return links.select("path", "sha256", "target").mapInArrow(run, "path string, sha256 string, size long, adopted boolean")
