"""Batches of model calls that can be taken up again: what is answered stays answered, what failed is asked again.

Replies lie in a table of their own, by the hash of the prompt and the model's name, so equal prompts are asked once, a
second run sends only what has no reply yet, and a changed prompt is a new one. A prompt whose call fails keeps its
error and doesn't stop the others; only a run in which every call fails is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.session import ship
from stackroom.sources.store import exists

Call = Callable[[list[str]], list[str]]
REPLIES = "prompt_hash string, reply string, error string, run int"


class AllFailed(RuntimeError):
    """Every call of a run failed."""


def prompt_hash(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n"), prompt), 256)


def _asked(prompts: list[str], call: Call) -> Iterator[tuple[str | None, str | None]]:
    """(reply, error) of each prompt: together, or one by one if the batch fails."""
    try:
        replies = call(prompts)
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        yield from ((r, None) for r in replies)
    except Exception as e:
        if len(prompts) == 1:
            yield None, f"{type(e).__name__}: {e}"[:2000]
        else:
            for p in prompts:
                yield from _asked([p], call)


class ReplyTable:
    """Replies below a path; each run is a folder that counts once it is whole."""

    def __init__(self, spark: SparkSession, path: str, model: str = "default"):
        self.spark, self.path, self.model = spark, path, model

    def runs(self) -> int:
        n = 0
        while exists(self.spark, f"{self.path}/run={n}/_SUCCESS"):
            n += 1
        return n

    def read(self) -> DataFrame:
        paths = [f"{self.path}/run={n}" for n in range(self.runs())]
        return self.spark.read.schema(REPLIES).option("basePath", self.path).parquet(*paths) if paths else self.spark.createDataFrame([], REPLIES)

    def answered(self) -> DataFrame:
        """One row a prompt: its reply if any run had one, else its last error; sent counts its runs."""
        last = F.struct(F.col("reply").isNotNull(), F.col("run"))
        return self.read().groupBy("prompt_hash").agg(F.max_by("reply", last).alias("reply"), F.max_by("error", last).alias("error"), F.max_by("run", last).alias("run"), F.count(F.lit(1)).alias("sent"))

    def ask(self, rows: DataFrame, prompt: str, call: Call, batch: int = 16, again: bool = False) -> tuple[int, int]:
        """Send the prompts that have no reply yet (all of them with again); how many had one, and how many failed."""
        ship(self.spark)
        number = self.runs()
        todo = rows.filter(F.col(prompt).isNotNull()).groupBy(prompt_hash(F.col(prompt), self.model).alias("prompt_hash")).agg(F.any_value(prompt).alias("prompt"))
        if not again:
            todo = todo.join(self.read().filter("reply is not null").select("prompt_hash").distinct(), "prompt_hash", "left_anti")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                prompts = part["prompt"].tolist()
                got = [x for i in range(0, len(prompts), batch) for x in _asked(prompts[i : i + batch], call)]
                yield pd.DataFrame({"prompt_hash": part["prompt_hash"], "reply": [r for r, _ in got], "error": [e for _, e in got]})

        todo.mapInPandas(run, "prompt_hash string, reply string, error string").write.mode("overwrite").parquet(f"{self.path}/run={number}")
        mine = self.read().filter(F.col("run") == number)
        ok, failed = mine.agg(F.count("reply"), F.count("error")).head()
        if failed and not ok:
            raise AllFailed(f"all {failed} calls failed: {mine.agg(F.max('error')).head()[0]}")
        return ok, failed

    def joined(self, rows: DataFrame, prompt: str, out: str = "reply") -> DataFrame:
        """rows with the reply and the error of their prompts; null prompts have neither."""
        mine = self.answered().select("prompt_hash", F.col("reply").alias(out), "error", "run")
        return rows.withColumn("prompt_hash", prompt_hash(F.col(prompt), self.model)).join(mine, "prompt_hash", "left").drop("prompt_hash")
