"""Queries over the knowledge tables.

Each takes an optional owner; without one it answers for all owners in one job, and "limit n" means the top n of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.operators.rows import exploded

TASK_LIMIT = 50
NEIGHBOURS = 5


def _owned(df: DataFrame, user: int | None) -> DataFrame:
    return df if user is None else df.filter(F.col("user_id") == user)


def list_papers(papers: DataFrame, user: int | None = None) -> DataFrame:
    """Papers of one owner, newest first; of all owners in no order, which a reader of one owner's rows puts in."""
    rows = _owned(papers, user).select(
        "user_id", "paper_id", "task_id", "title", "doi", "year", "venue", "extraction_status", "created_at"
    )
    return rows if user is None else rows.orderBy(F.desc("created_at"), "paper_id")


def extraction_status(papers: DataFrame, user: int | None = None) -> DataFrame:
    return _owned(papers, user).select("paper_id", "extraction_status", "extraction_error", "title")


def paper_view(papers: DataFrame, cards: DataFrame, annotations: DataFrame, user: int | None = None) -> DataFrame:
    """A paper with its live cards and annotations, one row per item.

    ``part`` is ``paper``, ``card`` or ``annotation``; the ``state`` of an annotation is its creation time, to show the
    newest first. Papers without a document give their ``paper`` row only. Long on purpose: a paper may carry any number
    of cards and annotations.
    """
    head = _owned(papers, user)
    documented = head.filter(F.col("has_document")).select("paper_id", "user_id")
    text, none = (lambda c: F.col(c).cast("string")), F.lit(None).cast("string")
    paper_rows = head.select(
        "paper_id", "user_id", F.lit("paper").alias("part"), text("paper_id").alias("item_id"),
        F.col("title").alias("body"), none.alias("extra"), text("extraction_status").alias("state"),
    )
    card_rows = cards.join(documented, ["paper_id", "user_id"], "left_semi").select(
        "paper_id", "user_id", F.lit("card").alias("part"), text("card_id").alias("item_id"),
        F.col("front").alias("body"), F.col("back").alias("extra"), text("repetitions").alias("state"),
    )
    annotation_rows = annotations.join(documented, ["paper_id", "user_id"], "left_semi").select(
        "paper_id", "user_id", F.lit("annotation").alias("part"), text("annotation_id").alias("item_id"),
        F.col("content").alias("body"), F.col("type").alias("extra"), text("created_at").alias("state"),
    )
    return paper_rows.unionByName(card_rows).unionByName(annotation_rows)


def graph_nodes(entities: DataFrame, user: int | None = None) -> DataFrame:
    return _owned(entities, user).select(
        "user_id", "id", "name", "type", "definition", "importance", "paper_id"
    )


def graph_edges(relations: DataFrame, user: int | None = None) -> DataFrame:
    return _owned(relations, user).select(
        "user_id",
        "id",
        F.col("source_entity_id").alias("source"),
        F.col("target_entity_id").alias("target"),
        "type",
        "description",
        "confidence",
    )


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Literal, case-insensitive substring search; blank text keeps everything."""
    return df.filter(F.contains(F.lower(column), F.lit(text.lower()))) if text else df


def search_entities(entities: DataFrame, text: str, user: int | None = None) -> DataFrame:
    return search(_owned(entities, user), "name", text).select("id", "name", "type", "definition", "paper_id")


def list_cards(cards: DataFrame, user: int | None = None) -> DataFrame:
    """Cards with their tags decoded; missing or malformed JSON gives an empty list."""
    tags = F.coalesce(F.from_json("tags_json", "array<string>"), F.array().cast("array<string>"))
    return _owned(cards, user).withColumn("tags", tags).drop("tags_json")


def list_annotations(annotations: DataFrame, paper_id: str | None = None, user: int | None = None) -> DataFrame:
    """Annotations of one paper, newest first; of all papers in no order."""
    rows = _owned(annotations, user)
    if paper_id is None:
        return rows
    return rows.filter(F.col("paper_id") == paper_id).orderBy(F.desc("created_at"), "annotation_id")


def list_tasks(tasks: DataFrame, limit: int = TASK_LIMIT, user: int | None = None, per_owner: bool = True) -> DataFrame:
    """Newest tasks of one owner, of each owner, or (``per_owner=False``) of all owners together."""
    order = [F.desc("created_at"), F.col("task_id")]
    if user is not None or not per_owner:
        return _owned(tasks, user).orderBy(*order).limit(limit)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    return tasks.withColumn("rank", rank).filter(F.col("rank") <= limit)


def neighbours(entities: DataFrame, relations: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The first ``k`` edges at each node, with direction and the other node's name (``?`` if unknown).

    A self-loop is listed once, as outgoing. Relations that were resolved in this run carry the names of their ends; for
    others the names are joined to the rows that survive the limit.
    """
    named = {"source_name", "target_name"} <= set(relations.columns)

    def end(direction: str, node: str, other: str):
        name = [F.col(f"{other}_name").alias("other_name")] if named else []
        return F.struct(
            F.lit(direction).alias("direction"), F.col(f"{node}_entity_id").alias("node"), F.col(f"{other}_entity_id").alias("other"), *name
        )

    out = end("out", "source", "target")
    ends = F.when(F.col("source_entity_id") == F.col("target_entity_id"), F.array(out)).otherwise(
        F.array(out, end("in", "target", "source"))
    )
    sides = relations.select(F.col("id").alias("edge_id"), "type", F.inline(ends))
    # Edges without a place may share an id: the outgoing one comes first.
    rank = F.row_number().over(W.partitionBy("node").orderBy("edge_id", F.desc("direction")))
    first = sides.withColumn("rank", rank).filter(F.col("rank") <= k)
    if not named:
        names = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
        first = first.join(names, "other", "left")
    return first.select(
        F.col("node").alias("node_id"), "rank", "direction", "type", "edge_id",
        F.coalesce("other_name", F.lit("?")).alias("other_name"),
    )


def summary_keywords(summaries: DataFrame) -> DataFrame:
    """Keywords of each summary with their rank by importance, the most important first; ties keep their order."""
    listed = F.transform(
        "summary.keywords",
        lambda k, i: F.struct(
            F.isnull(k["importance"]).alias("last"), (-k["importance"]).alias("less"), i.alias("pos"), k.alias("k")
        ),
    )
    rows = exploded(summaries.select("paper_id", F.array_sort(listed).alias("_ranked")), "_ranked", "r", "paper_id")
    return rows.select(
        "paper_id", (F.col("pos") + 1).alias("rank"), F.col("r.pos").alias("pos"), "r.k.text", "r.k.type", "r.k.importance"
    )


def paper_counts(
    papers: DataFrame, entities: DataFrame, findings: DataFrame, cards: DataFrame, relations: DataFrame
) -> DataFrame:
    """Items per paper; one shuffle of small partial counts for all four kinds."""
    kinds = {"entities": entities, "findings": findings, "cards": cards, "relationships": relations}
    tagged = None
    for kind, items in kinds.items():
        rows = items.select("paper_id", F.lit(kind).alias("kind"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    counts = tagged.groupBy("paper_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])
    zero = F.lit(0).cast("bigint")
    return papers.select("paper_id").join(counts, "paper_id", "left").select(
        "paper_id", *[F.coalesce(kind, zero).alias(kind) for kind in kinds]
    )


def completed_papers(papers: DataFrame, user: int | None = None) -> DataFrame:
    """Input of every export: papers whose extraction completed and that have a document."""
    return _owned(papers, user).filter((F.col("extraction_status") == "completed") & F.col("has_document"))
