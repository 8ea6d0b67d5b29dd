"""Schemas of the knowledge tables, the model responses and the stored documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

METADATA = (
    "title STRING, authors ARRAY<STRUCT<name: STRING, affiliation: STRING>>, year INT, doi STRING, arxiv_id STRING, "
    "venue STRING, abstract STRING, keywords ARRAY<STRING>, url STRING, bibtex STRING, csl_json STRING"
)
SECTION = "id STRING, title STRING, level INT, summary STRING"
ENTITY = (
    "id STRING, name STRING, type STRING, entity_type STRING, aliases ARRAY<STRING>, definition STRING, "
    "description STRING, importance DOUBLE"
)
RELATION = (
    "id STRING, source STRING, target STRING, type STRING, description STRING, confidence DOUBLE, "
    "source_entity_id STRING, target_entity_id STRING"
)
FINDING = "id STRING, type STRING, title STRING, statement STRING, description STRING, evidence STRING"
METHOD = "name STRING, description STRING, inputs ARRAY<STRING>, outputs ARRAY<STRING>"
DATASET = "name STRING, description STRING, usage STRING"
SRS = (
    "interval_days DOUBLE, ease_factor DOUBLE, repetitions INT, next_review STRING, last_review STRING"
)
CARD = f"id STRING, front STRING, back STRING, tags ARRAY<STRING>, difficulty INT, srs STRUCT<{SRS}>"
ANNOTATION = (
    "id STRING, type STRING, content STRING, target_type STRING, target_id STRING, tags ARRAY<STRING>, "
    "created_at STRING"
)
SUMMARY = (
    "one_liner STRING, novelty_score INT, estimated_minutes INT, "
    "story STRUCT<problem: STRING, method: STRING, results: STRING, impact: STRING>, "
    "key_numbers ARRAY<STRUCT<value: STRING, label: STRING, context: STRING>>, "
    "pipeline STRUCT<input: STRING, steps: ARRAY<STRING>, output: STRING>, "
    "contributions ARRAY<STRING>, limitations ARRAY<STRING>, "
    "keywords ARRAY<STRUCT<text: STRING, type: STRING, importance: DOUBLE>>"
)

# What each model task answers with.
RESPONSES = {
    "metadata": METADATA,
    "sections": f"sections ARRAY<STRUCT<{SECTION}>>",
    "entities": f"entities ARRAY<STRUCT<{ENTITY}>>, relationships ARRAY<STRUCT<{RELATION}>>",
    "findings": (
        f"findings ARRAY<STRUCT<{FINDING}>>, methods ARRAY<STRUCT<{METHOD}>>, datasets ARRAY<STRUCT<{DATASET}>>"
    ),
    "flashcards": f"flashcards ARRAY<STRUCT<{CARD}>>",
    "summary": SUMMARY,
    "highlight": "highlights ARRAY<STRUCT<sentence_id: STRING, category: STRING>>",
}

# The stored knowledge document, one JSON text per paper.
DOCUMENT = (
    f"id STRING, metadata STRUCT<{METADATA}>, structure STRUCT<sections: ARRAY<STRUCT<{SECTION}>>>, "
    f"entities ARRAY<STRUCT<{ENTITY}>>, relationships ARRAY<STRUCT<{RELATION}>>, "
    f"findings ARRAY<STRUCT<{FINDING}>>, methods ARRAY<STRUCT<{METHOD}>>, datasets ARRAY<STRUCT<{DATASET}>>, "
    f"flashcards ARRAY<STRUCT<{CARD}>>, annotations ARRAY<STRUCT<{ANNOTATION}>>, summary STRING, "
    "extracted_at STRING, extraction_model STRING"
)

# Closed vocabularies (fixed values). Only the highlight categories are enforced.
HIGHLIGHT_CATEGORIES = ("core_conclusion", "method_innovation", "key_data")
TASK_STATES_OPEN = ("pending", "parsing", "rewriting", "rendering", "highlighting")
TASK_STATES_CLOSED = ("completed", "error")


@dataclass(frozen=True)
class KnowledgeBase:
    """The knowledge of a corpus as flat tables, keyed by ``paper_id``; items carry ``(chunk_no, pos)`` order.

    Nested documents exist only at the edges (``sources.documents``). Between them every operator works on these
    tables, so that a paper or an entity with very many rows is never one row.
    """

    papers: DataFrame
    sections: DataFrame
    entities: DataFrame
    relations: DataFrame
    findings: DataFrame
    methods: DataFrame
    datasets: DataFrame
    cards: DataFrame
    annotations: DataFrame
