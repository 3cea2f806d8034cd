"""What the operators of this subpackage share: texts, shared storage, batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as the contracts of the operators ask.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts handed to one Python step at a time, in bytes.
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) is a
    temporary folder made and entered there; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = known or f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and
    a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it each query's shuffle files go when the query ends, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written`."""
    spark = df.sparkSession
    base = shared_dir(spark).removeprefix("file:").rstrip("/").replace("//", "/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base in folder.replace("//", "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, most_bytes: int = 128 << 20) -> DataFrame:
    """``df``, marked for broadcast if its values take at most ``most_bytes`` with
    16 bytes for each row, else as it is, for a join that shuffles both sides."""
    width = F.lit(16)
    for f in df.schema:
        kind = f.dataType.simpleString()
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16))
    held = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if held <= most_bytes else df


def join_hot(many: DataFrame, one: DataFrame, key: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``many``, of which one key may hold a large part, with
    ``one``, which has a row per key: by broadcast behind a check of its size, else
    by the key and a salt, so that rows of one key spread over ``salts`` tasks."""
    sent = small(one)
    if sent is not one:
        return many.join(sent, key, how)
    salted = one.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("join_salt", F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int"))
    return dealt.join(salted, [key, "join_salt"], how).drop("join_salt")


def slices(batches: Iterator, text: int, most: int = BATCH_BYTES) -> Iterator:
    """Arrow batches cut so that the texts in column ``text`` stay near
    ``most`` bytes; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * most / max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on and serves other steps
