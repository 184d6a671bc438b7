"""What the operators share: reading tables, cutting lineage, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and leaves all else, UTF-8 included.
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Rows and bytes of one Arrow batch: bound a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one of its own where none is set, in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: what follows neither recomputes it nor loses it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, random: bool = False) -> DataFrame:
    """Like cut, for wide or large tables: as Parquet, which is smaller and read by column.

    Of `random` values, such as hashes, no dictionary is tried and nothing is compressed. Once it is written nothing asks for the shuffles behind it, so their files go at once.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**({"parquet.enable.dictionary": "false", "compression": "none"} if random else {})).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() made, once all that was read from them is itself written."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df does not have yet, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
