"""Session settings shared by tests, benches and applications."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

#: Settings that suit any cluster; sizes (memory, partitions) stay with the deployer.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("strandline")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"),
    }
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    path = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders that operators wrote under the shared one, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder under the shared one; drop_tables() deletes it."""
    path = f"{checkpoint_root(spark)}/strandline-{what}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_folder(), once nothing reads it any more."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)
    _WRITTEN.pop(path, None)


def drop_tables() -> None:
    """Delete all folders that operators wrote: when their results are stored, and at the process's end."""
    for path, spark in list(_WRITTEN.items()):
        _WRITTEN.pop(path, None)
        try:
            drop_folder(spark, path)
        except Exception:  # the session is gone; its deployer clears the folder
            break


atexit.register(drop_tables)


def written(df, path: str):
    """df written to path and read back, and its rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def cut_lineage(df, eager: bool = True):
    """checkpoint() into the shared folder."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=eager)
