"""The knowledge document: one JSON text per paper at the edges, flat tables inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import key_simple
from paperlake.operators.export import SCHEMA_VERSION
from paperlake.operators.rows import exploded
from paperlake.schemas import DOCUMENT, KnowledgeBase
from paperlake.session import stored


def parse_knowledge(df: DataFrame, column: str = "knowledge_json") -> DataFrame:
    """Replace the JSON text by a ``knowledge`` struct; null where the text is null or not a JSON object."""
    text = F.col(column)
    valid = F.try_parse_json(text).isNotNull() & text.rlike(r"\A\s*\{")
    return df.withColumn("knowledge", F.when(valid, F.from_json(text, DOCUMENT))).drop(column)


def to_tables(docs: DataFrame) -> KnowledgeBase:
    """Flatten parsed documents ``(paper_id, user_id, …, part_no, knowledge)`` into the knowledge tables.

    A large paper may be stored as several documents; ``part_no`` orders them and only the first is its head.
    """
    part = F.col("part_no") if "part_no" in docs.columns else F.lit(0)
    # Parsed once: the tables below each read only their own nested columns of the stored result.
    docs = stored(docs.withColumn("_part", part).filter(F.col("knowledge").isNotNull()))

    def items(path: str, name: str) -> DataFrame:
        rows = exploded(docs, f"knowledge.{path}", name, "paper_id", F.col("_part").alias("chunk_no"))
        return rows.select("paper_id", "chunk_no", "pos", f"{name}.*")

    heads = [c for c in docs.columns if c not in ("knowledge", "part_no", "_part")]
    papers = docs.filter(F.col("_part") == 0).select(
        *heads,
        "knowledge.metadata",
        "knowledge.summary",
        "knowledge.extracted_at",
        *([] if "extraction_model" in heads else ["knowledge.extraction_model"]),
        *([] if "title" in heads else [F.col("knowledge.metadata.title").alias("title")]),
        F.lit(True).alias("has_document"),
    )
    entities = items("entities", "e").withColumns(
        {"entity_key": key_simple(F.col("name")), "first_chunk": F.col("chunk_no"), "first_pos": F.col("pos")}
    )
    sections = items("structure.sections", "s").withColumn("section_no", F.col("pos") + 1)
    cards = items("flashcards", "c").select("*", "srs.*").drop("srs")
    return KnowledgeBase(
        papers=papers,
        sections=sections,
        entities=entities,
        relations=items("relationships", "r"),
        findings=items("findings", "f"),
        methods=items("methods", "m"),
        datasets=items("datasets", "d"),
        cards=cards,
        annotations=items("annotations", "a"),
    )


_PARTS = ("sections", "entities", "relationships", "findings", "methods", "datasets", "flashcards")


def _tagged(kb: KnowledgeBase) -> DataFrame:
    """All items of all papers as one long table: kind, order, and one struct column per kind."""
    def rows(df: DataFrame, kind: str, a: Column, b: Column, payload: Column) -> DataFrame:
        return df.select(
            "paper_id", F.lit(_PARTS.index(kind)).alias("kind"), F.coalesce(a, F.lit(0)).cast("bigint").alias("a"),
            F.coalesce(b, F.lit(0)).cast("bigint").alias("b"), payload.alias(kind),
        )

    zero = F.lit(0)
    srs = F.struct(
        "interval_days", "ease_factor", "repetitions", F.col("next_review").cast("string").alias("next_review")
    )
    tables = [
        rows(kb.sections, "sections", zero, F.col("section_no"), F.struct("id", "title", "level", "summary")),
        rows(
            kb.entities, "entities", F.col("first_chunk"), F.col("first_pos"),
            F.struct("id", "name", "type", "aliases", "definition", "importance"),
        ),
        rows(
            kb.relations, "relationships", F.col("chunk_no"), F.col("pos"),
            F.struct(
                "id", "source", "target", "type", "description", "confidence", "source_entity_id", "target_entity_id"
            ),
        ),
        rows(kb.findings, "findings", zero, F.col("pos"), F.struct("id", "type", "statement", "evidence")),
        rows(kb.methods, "methods", zero, F.col("pos"), F.struct("name", "description", "inputs", "outputs")),
        rows(kb.datasets, "datasets", zero, F.col("pos"), F.struct("name", "description", "usage")),
        rows(
            kb.cards, "flashcards", zero, F.col("pos"),
            F.struct("id", "front", "back", "tags", "difficulty", srs.alias("srs")),
        ),
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


# Entities and relations of so many chunks go into one document.
CHUNKS_IN_PART = 64


def assemble_documents(kb: KnowledgeBase, extracted_at: Column, model: str) -> DataFrame:
    """Stored documents ``(paper_id, part_no, knowledge_json)``.

    All item kinds meet in one shuffle by paper and part. Which part an item is in follows from its chunk alone
    (``CHUNKS_IN_PART``), so a paper of few chunks is one document and a very long one is several, of a bounded number of
    model answers each; readers explode them. Part 0 is the head with the metadata.
    """
    items = _tagged(kb).withColumn("part_no", F.floor(F.col("a") / CHUNKS_IN_PART).cast("int"))

    def listed(kind: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct("a", "b", kind))))
        return F.transform(ordered, lambda x: x[kind]).alias(kind)

    # Dealt before they are gathered: lists of every kind for each paper a task has seen are larger than the items. They
    # are dealt by paper alone, as the join with the heads needs them, so that whole bodies are not shuffled again.
    bodies = items.repartition("paper_id").groupBy("paper_id", "part_no").agg(*[listed(k) for k in _PARTS])
    heads = kb.papers.select("paper_id", F.lit(0).alias("part_no"), "metadata")
    joined = heads.join(bodies, ["paper_id", "part_no"], "full_outer")

    def items_of(kind: str) -> Column:
        kind_type = dict(bodies.dtypes)[kind]
        return F.coalesce(kind, F.array().cast(kind_type))

    document = F.struct(
        F.col("paper_id").alias("id"),
        "metadata",
        F.struct(items_of("sections").alias("sections")).alias("structure"),
        *[items_of(kind).alias(kind) for kind in _PARTS[1:]],
        F.array().cast("array<string>").alias("annotations"),
        extracted_at.cast("string").alias("extracted_at"),
        F.lit(model).alias("extraction_model"),
    )
    return joined.select("paper_id", "part_no", F.to_json(document).alias("knowledge_json"))


def write_knowledge(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def export_all(
    kb_docs: DataFrame, global_entities: DataFrame, exported_at: str, path: str, compression: str | None = None
) -> None:
    """Full export as partitioned JSON: ``papers``, ``global_entities`` and a one-row ``manifest``.

    ``compression`` is a codec of Spark's text files (``gzip``: about a tenth of the disk); readers see the same lines.
    There are no global relationships in the format; the manifest says so instead of an empty folder.
    """
    codec = compression or "none"
    kb_docs.select("knowledge_json").write.mode("overwrite").text(f"{path}/papers", compression=codec)
    global_entities.write.mode("overwrite").json(f"{path}/global_entities", compression=codec)
    spark = kb_docs.sparkSession
    spark.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(exported_at).alias("exported_at"),
        F.array().cast("array<string>").alias("global_relationships"),
    ).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
