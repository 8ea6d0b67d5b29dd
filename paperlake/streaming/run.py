"""Running a stream over what is there now, into a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperlake.session import new_path, names_in, remove

#: Triggers after which their folders are folded into one.
FOLD_EVERY = 16
#: The state store that keyed state with timers needs.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class LatestRows:
    """What a finished run leaves: the last row of each key, rows dropped as too late, and keys still in state."""

    rows: DataFrame
    late: int
    state_rows: int


class RowLog:
    """Rows of triggers below ``root``, each trigger in a folder of its own; every ``FOLD_EVERY`` of them are folded into
    the last row of each key, so that neither folders nor rows grow with the number of triggers."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: StructType) -> None:
        self.spark, self.root, self.key = spark, root, key
        self.schema = StructType([*fields, StructField("trigger", LongType())])

    def write(self, rows: DataFrame, number: int) -> None:
        """Add a trigger's rows; a trigger that is tried again overwrites what it wrote."""
        numbered = rows.withColumn("trigger", F.lit(number).cast("bigint"))
        numbered.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/rows/batch={number}")
        if number % FOLD_EVERY == FOLD_EVERY - 1:
            bases, before = self._bases(), max(self._bases(number - 1), default=-1)
            self.read(number, before).write.mode("overwrite").parquet(f"{self.root}/base/{number}")
            # What the fold before this one has is not needed to try this trigger again.
            for old in self._numbers("rows", "batch="):
                if old <= before:
                    remove(self.spark, f"{self.root}/rows/batch={old}")
            for old in bases:
                if old < before:
                    remove(self.spark, f"{self.root}/base/{old}")

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        return [int(name[len(prefix):]) for name in names_in(self.spark, f"{self.root}/{folder}") if name.startswith(prefix)]

    def _bases(self, most: int | None = None) -> list[int]:
        """Numbers of the complete folds."""
        found = [n for n in self._numbers("base") if most is None or n <= most]
        return [n for n in found if "_SUCCESS" in names_in(self.spark, f"{self.root}/base/{n}")]

    def read(self, upto: int | None = None, base: int | None = None) -> DataFrame:
        """The last row of each key, with its trigger."""
        base = max(self._bases(), default=-1) if base is None else base
        paths = [f"{self.root}/base/{base}"] if base >= 0 else []
        paths += [
            f"{self.root}/rows/batch={n}" for n in self._numbers("rows", "batch=") if n > base and (upto is None or n <= upto)
        ]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        others = [c for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), "trigger").alias("s")).select(self.key, "s.*")


def latest_rows(
    stream: DataFrame, key: str, of_batch: Callable[[DataFrame, int], DataFrame] | None = None,
    schema: StructType | None = None, mode: str = "update",
) -> LatestRows:
    """Run a stream until its source is used up and keep the last row of each key.

    ``of_batch`` turns a trigger's rows into the rows to keep, of ``schema``; by default they are kept as they are. Each
    update counts once, also when a trigger is tried again. A source without rows gives an empty table.
    """
    spark = stream.sparkSession
    root = new_path(spark, "stream")
    log = RowLog(spark, root, key, schema or stream.schema)

    def write(batch: DataFrame, number: int) -> None:
        log.write(of_batch(batch, number) if of_batch else batch, number)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{root}/state")
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    progress = [s for p in query.recentProgress for s in p.stateOperators]
    late = sum(s.numRowsDroppedByWatermark for s in progress)
    held = progress[-1].numRowsTotal if progress else 0
    return LatestRows(log.read().drop("trigger"), late, held)
