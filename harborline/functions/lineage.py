"""Cutting the lineage of intermediate results that later steps read repeatedly."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves local
    mode only, because executors elsewhere could not reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="harborline-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the session's checkpoint folder and reads them back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet below the shared folder and read back: for wide rows, of which a checkpoint
    takes several times the space. The folder stays until ``removed``."""
    path = f"{shared_folder(df.sparkSession)}/harborline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Removes the folders of tables from ``written``, once nothing reads them any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more. It does so when the driver's
    JVM collects its garbage, which in a job of many steps may be after all of them."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
