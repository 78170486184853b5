"""Tables written to the shared folder, and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 4 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder for
    ``local`` masters only, because executors elsewhere could not reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="harborline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """The rows, written as Parquet, with the writer's options, to a new folder below the shared one and read again.

    This cuts the lineage: a lost executor costs the work since this table, and values such
    as row ids are the same for every reader. The folder belongs to the caller's run."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/harborline-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows, written like ``written`` as a table bucketed by ``key`` into as many buckets as a
    shuffle has partitions: grouping or joining by the key then reads it without another shuffle."""
    spark = df.sparkSession
    table = f"harborline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def give_back() -> None:
    """Returns to the system what this process has freed, so that a Python worker that lives for many groups does
    not keep the sum of what each of them left in pieces."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few literal rows, without a Python task."""
    types = T.StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in types))
    columns = [F.array(*map(F.lit, values)).cast(T.ArrayType(f.dataType)).alias(f.name) for f, values in zip(types, zip(*rows))]
    return spark.range(1).select(F.explode(F.arrays_zip(*columns)).alias("row")).select("row.*")


def text_of(column: str = "text") -> Column:
    """The text as string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SLICE_BYTES`` of the column, at least one row each."""
    values = batch.column(column)
    start, size = 0, 0
    for i in range(batch.num_rows):
        value = values[i]
        size += value.as_buffer().size if value.is_valid else 0
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(
    df: DataFrame, of: Callable[[pa.RecordBatch], list[pa.Array]], schema: str, sized_by: str
) -> DataFrame:
    """Adds the columns that ``of`` makes from a run of rows; they replace columns of the same
    names. ``sized_by`` is the string or binary column by which runs are cut."""
    new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {name.lower() for name in new.names}
    kept = [c for c in df.columns if c.lower() not in taken]
    names = [*kept, *new.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sized_by):
                columns = [part.column(i) for i, c in enumerate(part.schema.names) if c.lower() not in taken]
                yield pa.RecordBatch.from_arrays([*columns, *of(part)], names=names)

    types = T.StructType([*(f for f in df.schema.fields if f.name.lower() not in taken), *new.fields])
    return df.mapInArrow(work, types)
