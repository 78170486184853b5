"""Lets Python workers import this package wherever the driver found it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGES = ("harborline", "workload")


def ship_package(spark: SparkSession) -> None:
    """Sends the packages to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_harborline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for package in PACKAGES:
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, root))
    folder = tempfile.mkdtemp(prefix="harborline-package-")
    path = os.path.join(folder, "harborline_package.zip")
    with open(path, "wb") as file:
        file.write(content.getvalue())
    context.addPyFile(path)
    context._harborline_shipped = True
