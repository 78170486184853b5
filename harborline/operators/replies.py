"""A store of model answers: every distinct prompt is asked once, and a failed run resumes.

A prompt is known by the digest of the model's name, the kind of answer and its text. Before any
call, prompts are reduced to distinct digests, so a prompt that a third of all rows share is asked once,
and an anti-join removes the answered ones. The rest is asked in waves; each wave is one Spark
job whose answers are committed together. A run that fails keeps the waves before, and a lost executor
repeats its own tasks of one wave only. Rows then take their answers by an equality join.

Only valid answers are stored. A prompt without one is asked again by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAVE_PROMPTS = 100_000


class ReplyStore:
    """Answers of one model below ``path``, a folder that all executors share.

    ``asked`` counts the prompts that this object has sent to a model, ``waves`` the committed jobs."""

    def __init__(self, spark: SparkSession, path: str, model: str, wave_prompts: int = WAVE_PROMPTS):
        self.spark, self.path, self.model, self.wave_prompts = spark, path.rstrip("/"), model, wave_prompts
        self.asked = self.waves = 0

    def digest(self, prompt: Column, as_json: bool = True) -> Column:
        kind = "json" if as_json else "text"
        return F.sha2(F.concat(F.lit(f"{self.model}\0{kind}\0"), prompt).cast("binary"), 256)

    def replies(self) -> DataFrame:
        """digest and reply, one row for each stored prompt."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/replies")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "digest string, reply string")
        stored = self.spark.read.schema("digest string, reply string").parquet(f"{self.path}/replies")
        # Runs side by side may have asked the same; the smaller answer counts.
        return stored.groupBy("digest").agg(F.min("reply").alias("reply"))

    def ask_missing(self, prompts: DataFrame, factory: Callable, ask: Callable, as_json: bool = True) -> None:
        """Asks the prompts (digest, prompt) that have no answer yet, each once."""
        missing = prompts.dropDuplicates(["digest"]).join(self.replies().select("digest"), "digest", "left_anti")
        pending = f"{self.path}/pending/{uuid.uuid4().hex}"
        missing.write.parquet(pending)
        missing = self.spark.read.parquet(pending)
        n = missing.count()
        waves = -(-n // self.wave_prompts)
        tasks = self.spark.sparkContext.defaultParallelism

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = factory()
            for batch in batches:
                replies = [ask(client, text, as_json) for text in batch["prompt"]]
                yield pd.DataFrame({"digest": batch["digest"], "reply": pd.Series(replies, dtype=object)})

        for wave in range(waves):
            mine = missing.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave) if waves > 1 else missing
            asked = mine.repartition(tasks, "digest").mapInPandas(run, "digest string, reply string")
            asked.where(F.col("reply").isNotNull()).write.mode("append").parquet(f"{self.path}/replies")
            self.waves += 1
        self.asked += n

    def answered(self, df: DataFrame, prompt: Column, factory: Callable | None, ask: Callable, as_json: bool = True) -> DataFrame:
        """Adds ``reply``, NULL where there is none. Asks at once what is missing; without a factory
        only stored answers are used."""
        rows = df.withColumn("_digest", self.digest(prompt, as_json))
        if factory is not None:
            self.ask_missing(rows.select(F.col("_digest").alias("digest"), prompt.alias("prompt")), factory, ask, as_json)
        stored = self.replies().select(F.col("digest").alias("_digest"), "reply")
        return rows.join(stored, "_digest", "left").drop("_digest")
