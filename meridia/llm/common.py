"""Shared helpers: the working folder that all machines see, and written tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_BYTES = 8 << 20
_RUN = f"meridia-{uuid.uuid4().hex[:12]}"
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this run inside ``spark.checkpoint.dir``.

    In a local session without that setting a temporary folder takes its place; on a
    cluster, where executors would not share it, the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="meridia-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
            atexit.register(__import__("shutil").rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return f"{base.rstrip('/')}/{_RUN}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage ends there,
    so a lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    out._meridia_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` made, once nothing needs it any longer."""
    remove(df.sparkSession, df._meridia_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases: it does so for plans that
    nothing refers to, as soon as the collectors of both sides have noticed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is. All-ASCII texts take the plain
    ``lower``, which agrees with it there and is many times faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in Arrow batches of about ``ARROW_BYTES``; the usual
    limit counts rows, which says little about texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns under private names, so that others can't clash."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in cols.items()))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
