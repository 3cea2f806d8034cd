"""Frames written once and read by many parts of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the
    session names none and runs on one machine, a temporary one that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written_all(**frames: DataFrame) -> list[DataFrame]:
    """Several frames written once, at the same time: their jobs share the cluster."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: written_once(item[1], item[0]), frames.items()))


def folder_of(spark: SparkSession) -> str:
    """Where this application keeps what it writes once."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all that the application wrote once. Frames that read it are of no use
    after that; to be called between pieces of work, or at their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder_of(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_once(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder, under the application's id, and read
    back: what reads it several times neither plans nor computes it again, and a
    lost executor costs only what came after."""
    spark = df.sparkSession
    path = f"{folder_of(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
