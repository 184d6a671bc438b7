"""Tables in the folder that all executors share: lineage cut, and tables made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where tables that are made once stand, by application, source and its state.
_KEPT: dict[tuple, str] = {}


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
    """df written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def made_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from a source, written at its first use in an application and read from then on, while the source's files stay what they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)  # noqa: SLF001
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    top = store.getFileStatus(path)
    files = store.listStatus(path) if top.isDirectory() else [top]
    key = (spark.sparkContext.applicationId, source, name, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _KEPT:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(folder)
        _KEPT[key] = folder
    return spark.read.parquet(_KEPT[key])
