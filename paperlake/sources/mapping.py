"""The mapping table of written notes, kept in hash buckets of which a run rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.lifecycle import plan_notes
from paperlake.sources.buckets import BUCKETS, merge_buckets, read_buckets

_SCHEMA = (
    "mapping_id string, user_id long, paper_id string, item_type string, item_id string, normalized_key string, "
    "source_name string, vault_path string, relative_path string, content_hash string, updated_at timestamp_ntz"
)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The mapping table below ``path``; empty where there is none."""
    return read_buckets(spark, path, _SCHEMA).drop("bucket")


def upsert_notes(notes: DataFrame, path: str, inventory: DataFrame, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """Plan notes against the mapping table below ``path`` (:func:`lifecycle.plan_notes`) and write the table's new state.

    ``notes`` and ``inventory`` are those of ``plan_notes``. Returns the planned rows of this run's notes (with
    ``state``). A mapping's bucket follows from its id, so only the buckets of these notes are read, joined and
    overwritten (:func:`buckets.merge_buckets`).
    """
    planned = merge_buckets(
        notes, path, _SCHEMA, ["mapping_id"], lambda old, new: plan_notes(new.drop("bucket"), old.drop("bucket"), inventory, now), buckets
    )
    return planned.filter(F.col("state").isNotNull())
