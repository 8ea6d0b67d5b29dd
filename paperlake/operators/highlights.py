"""Key sentences: apply the model's selections and summarise them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import strip
from paperlake.operators.rows import exploded
from paperlake.schemas import HIGHLIGHT_CATEGORIES


def selections(responses: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc, chunk_no, pos, sentence_id, category)`` with a non-empty id and a known category."""
    rows = exploded(responses, "parsed.highlights", "h", doc_id, "chunk_no").select(
        doc_id, "chunk_no", "pos", strip(F.col("h.sentence_id")).alias("sentence_id"), "h.category"
    )
    return rows.filter((F.col("sentence_id") != "") & F.col("category").isin(*HIGHLIGHT_CATEGORIES))


def apply_selections(sentences: DataFrame, selected: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The first selection of each sentence id, matched to its sentence; ``matched`` is false for unknown ids."""
    firsts = selected.groupBy(doc_id, "sentence_id").agg(
        F.min_by("category", F.struct("chunk_no", "pos")).alias("category")
    )
    known = sentences.select(doc_id, "sentence_id", "page_index", "text", F.lit(True).alias("_known"))
    return firsts.join(known, [doc_id, "sentence_id"], "left").select(
        doc_id, "sentence_id", "page_index", "text", "category", F.coalesce("_known", F.lit(False)).alias("matched")
    )


def highlight_stats(applied: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    hit = F.col("matched")

    def of(category: str) -> Column:
        return F.count_if(hit & (F.col("category") == category))

    return applied.groupBy(doc_id).agg(
        of("core_conclusion").alias("core_conclusions"),
        of("method_innovation").alias("method_innovations"),
        of("key_data").alias("key_data"),
        F.count_if(hit).alias("total"),
        F.count_if(~hit).alias("failed_matches"),
    )


def highlight_status(stats: DataFrame) -> DataFrame:
    status = (
        F.when((F.col("total") > 0) & (F.col("failed_matches") == 0), "success")
        .when(F.col("total") > 0, "partial")
        .otherwise("failed")
    )
    return stats.withColumn("status", status)


def filter_highlights(applied: DataFrame, category: str = "all") -> DataFrame:
    shown = applied.filter("matched")
    return shown if category == "all" else shown.filter(F.col("category") == category)
