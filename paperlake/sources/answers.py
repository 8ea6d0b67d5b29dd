"""A table of model answers, kept by what was asked.

A request is known by the hash of everything that decides its answer: task, prompt, content, model and sampling settings.
So a job that is run again, for the same papers or after a failure, calls the model only for requests that no earlier run
has an answer to, and equal requests of different papers are asked once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.inference import DEFAULT_MAX_TOKENS, IN_FLIGHT, MAX_TOKENS, TEMPERATURE, Client, infer
from paperlake.session import exists, stored

STORED = "request_key string, raw string, error string, attempts int, model string, answered_at timestamp, run string, task string"


def request_key(model: str) -> Column:
    """SHA-256 of what decides an answer; every part goes in with its length, so that none can run into the next."""
    tokens = F.lit(DEFAULT_MAX_TOKENS)
    for task, most in MAX_TOKENS.items():
        tokens = F.when(F.col("task") == task, most).otherwise(tokens)
    parts = [F.lit(model), F.col("task"), F.col("system"), F.col("content"), tokens.cast("string"), F.lit(str(TEMPERATURE))]
    framed = [x for part in parts for x in (F.length(F.coalesce(part, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(part, F.lit("")))]
    return F.sha2(F.concat(*framed), 256)


@dataclass
class AnswerTable:
    """Answers of ``model`` below ``path``, a folder that all executors share; other models' answers can lie there too.

    ``run`` names the job that appends. A failed call is kept with its error, for the record, and asked again by the next
    job.
    """

    spark: SparkSession
    path: str
    model: str
    run: str

    def rows(self) -> DataFrame:
        """Everything that was appended, by all runs and models."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.path)

    def answered(self) -> DataFrame:
        """(request_key, task) of the requests that have an answer: two narrow columns, whatever the answers hold."""
        return self.rows().filter((F.col("model") == self.model) & F.col("raw").isNotNull()).select("request_key", "task")

    def current(self) -> DataFrame:
        """One row per request: its earliest answer, so that an answer once given stays; else its latest failure."""
        given, micros = F.col("raw").isNotNull(), F.unix_micros("answered_at")
        order = F.struct(given.alias("given"), F.when(given, -micros).otherwise(micros).alias("at"), F.col("run"))
        payload = F.struct("raw", "error", "attempts", "run")
        kept = self.rows().filter(F.col("model") == self.model)
        return kept.groupBy("request_key", "task").agg(F.max_by(payload, order).alias("a")).select("request_key", "task", "a.*")

    def append(self, answers: DataFrame) -> None:
        """Append answers, each task of the job for itself as soon as it is done: what it has paid for is there for the
        next run even if this one fails. A task that is tried again may append an answer twice, which reading folds."""
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("task").parquet(self.path)


def answer_requests(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    table: AnswerTable,
    concurrency: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Answer every request, calling the model only for what ``table`` has no answer to.

    ``requests`` and the result are those of :func:`inference.infer`; ``reused`` (boolean) is added: no call was made for
    the row in this run, or it was made for an equal request of an earlier one. Requests are matched by an anti join on
    their keys; contents travel only for those that are asked. Rows whose calls fail carry the error of this run.
    """
    keyed = stored(
        requests.select(
            F.col("paper_id").cast("string").alias("paper_id"), "task", F.col("chunk_no").cast("int").alias("chunk_no"),
            "system", "content", request_key(table.model).alias("request_key"),
        )
    )
    missing = keyed.join(table.answered(), ["request_key", "task"], "left_anti")
    asked = missing.groupBy("request_key", "task").agg(F.first("system").alias("system"), F.first("content").alias("content"))
    called = infer(
        asked.select(F.col("request_key").alias("paper_id"), "task", F.lit(0).alias("chunk_no"), "system", "content"),
        client_factory, concurrency, sleep, in_flight,
    )
    table.append(
        called.select(
            F.col("paper_id").alias("request_key"), "raw", "error", "attempts", F.lit(table.model).alias("model"),
            F.current_timestamp().alias("answered_at"), F.lit(table.run).alias("run"), "task",
        )
    )
    found = keyed.drop("system", "content").join(table.current(), ["request_key", "task"], "left")
    return found.select(
        "paper_id", "task", "chunk_no", "raw", "error", "attempts", (F.col("run") != table.run).alias("reused")
    )


def calls_made(table: AnswerTable) -> DataFrame:
    """(task, requests, failed): how many different requests the run of ``table`` has asked the model."""
    own = table.rows().filter((F.col("run") == table.run) & (F.col("model") == table.model))
    return own.groupBy("task").agg(
        F.count_distinct("request_key").alias("requests"), F.count_if(F.col("raw").isNull()).alias("failed")
    )
