"""The header lines of CSV files, read on the driver: one line of each file, never its rows."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Files whose first lines are read at the same time.
READERS = 16


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file in any store that Spark reads, unpacked by its suffix; None if empty."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
        return reader.readLine()
    finally:
        stream.close()


def files_of(spark: SparkSession, path) -> list[str]:
    """All files below a path, a pattern or a list of them."""
    jvm = spark._jvm
    listed = spark.read.text(path).inputFiles()
    return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in listed)


def files_by_header(spark: SparkSession, path) -> dict[tuple[str, ...], list[str]]:
    """The files grouped by their column names, in the order of the first file of each group. Files
    without a header line have no rows and are left out."""
    files = files_of(spark, path)
    with ThreadPoolExecutor(READERS) as pool:
        lines = list(pool.map(lambda file: first_line(spark, file), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if line is None:
            continue
        names = tuple(next(csv.reader([line.removeprefix("\ufeff")]), ()))
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{file} has a column twice: {', '.join(names)}")
        groups.setdefault(names, []).append(file)
    return groups
