"""Substring search through an index of character n-grams instead of a scan.

The index has every distinct lower-cased text once under each of its grams of one to three characters, and the table's
rows under their text. A search reads the lists of the query's grams, intersects them, checks the few texts that are left
and fetches their rows. A fragment of one or two characters is a gram itself, so its list is the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import stored

GRAM = 3
#: Folders of the lists and of the rows; a search reads as many of the former as its text has grams.
BUCKETS = 64
#: Lists of a gram are dealt to so many rows-groups at most by their text, so that a very common gram is no single task.
SALTS = 16


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def grams_of(text: Column) -> Column:
    """Distinct grams of one to ``GRAM`` characters of a text."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
        return F.when(F.length(text) >= size, F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


@dataclass
class TextIndex:
    """Index below ``path`` of the column ``column``."""

    spark: SparkSession
    path: str
    column: str
    buckets: int = BUCKETS

    def build(self, rows: DataFrame) -> None:
        """Index ``rows``; a null text is in no list. Columns of any name but ``_text`` and ``_bucket`` can be there."""
        text = F.lower(self.column)
        keyed = rows.withColumn("_text", text).withColumn("_bucket", _bucket(text, self.buckets))
        held = keyed.filter(F.col("_text").isNotNull())
        held.repartition("_bucket", F.pmod(F.xxhash64("_text"), F.lit(SALTS))).write.mode("overwrite").partitionBy(
            "_bucket"
        ).parquet(f"{self.path}/rows")
        texts = stored(self.spark.read.parquet(f"{self.path}/rows").select("_text").distinct())
        lists = texts.select("_text", F.explode(grams_of(F.col("_text"))).alias("gram")).withColumn(
            "_bucket", _bucket(F.col("gram"), self.buckets)
        )
        lists.repartition("_bucket", F.pmod(F.xxhash64("_text"), F.lit(SALTS))).sortWithinPartitions("_bucket", "gram").write.mode(
            "overwrite"
        ).partitionBy("_bucket").parquet(f"{self.path}/lists")

    def texts(self, text: str) -> DataFrame:
        """(_text): the indexed texts that contain ``text``, read from the lists of its grams only."""
        wanted = text.lower()
        size = min(GRAM, len(wanted))
        grams = sorted({wanted[k : k + size] for k in range(len(wanted) - size + 1)})
        found = self.spark.read.schema("_text string, gram string, _bucket int").parquet(f"{self.path}/lists").filter(
            F.col("gram").isin(grams) & F.col("_bucket").isin(self._buckets_of(grams))
        )
        if len(grams) == 1:
            return found.filter(F.contains("_text", F.lit(wanted))).select("_text")
        held = found.groupBy("_text").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        return held.filter(F.contains("_text", F.lit(wanted))).select("_text")

    def _buckets_of(self, grams: list[str]) -> list[int]:
        """Folders of some grams, by the same hash as the lists'; worked out by Spark on as many rows as there are."""
        rows = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets).alias("b"))
        return sorted({r.b for r in rows.collect()})

    def search(self, text: str) -> DataFrame:
        """Rows whose column contains ``text``, literally and in any case: those of :func:`queries.search`, but for a
        blank text, which is no search and gives all indexed rows."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if not text:
            return rows.drop("_text", "_bucket")
        found = self.texts(text).withColumn("_bucket", _bucket(F.col("_text"), self.buckets))
        return rows.join(found, ["_bucket", "_text"], "left_semi").drop("_text", "_bucket")
