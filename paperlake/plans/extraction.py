"""From assembled texts to the knowledge tables: three waves of batch inference.

Sections decide the chunks, and entities and findings decide the cards, so inference runs in three waves. The answers of
each wave are stored before they are used: model calls are slow and paid for, and must not run again when a later stage
is recomputed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators import highlights as H
from paperlake.operators import inference as L
from paperlake.operators import knowledge as K
from paperlake.operators import text as T
from paperlake.schemas import KnowledgeBase
from paperlake.session import stored
from paperlake.sources.answers import AnswerTable, answer_requests


def answer(
    requests: DataFrame, client: Callable[[], L.Client], concurrency: int | None, kept: AnswerTable | None = None
) -> DataFrame:
    """Answers of the model, stored; with ``kept``, only requests without an answer there are asked."""
    if kept is None:
        return stored(L.infer(requests, client, concurrency))
    return stored(answer_requests(requests, client, kept, concurrency).drop("reused"))


def extract(
    texts: DataFrame, papers: DataFrame, client: Callable[[], L.Client], now: Column, concurrency: int | None = None,
    slice_chars: int = L.SLICE_CHARS, kept: AnswerTable | None = None,
) -> tuple[KnowledgeBase, DataFrame]:
    """Knowledge tables of every paper in ``texts`` (``assemble_text``) and one row per failed model call.

    ``papers``: (paper_id, user_id, created_at, …); those without a text are left out of the result. Whole texts are
    read, in requests of ``slice_chars``. A paper whose calls fail keeps empty parts and is completed; its index row
    counts the failed calls (``knowledge.paper_index``). With ``kept``, answers of earlier runs are used again: a second
    run over the same texts calls the model for nothing, one after a change only for the requests that changed.
    """
    texts = stored(texts.withColumn("paper_id", F.col("paper_id").cast("string")))
    first = answer(L.text_requests(texts, ("metadata", "sections", "findings"), slice_chars), client, concurrency, kept)
    sections = K.sections(L.parse_response(first, "sections"))
    found = stored(L.parse_response(first, "findings"))
    findings = K.findings(found)

    chunks = T.select_chunks(texts, sections)
    second = answer(L.entity_requests(chunks), client, concurrency, kept)
    parsed = stored(L.parse_response(second, "entities"))
    entities = stored(K.entity_index(K.dedup_entities(K.entity_mentions(parsed))))
    relations = stored(K.resolve_relations(K.relation_mentions(parsed), entities))

    third = answer(L.card_requests(entities, findings), client, concurrency, kept)
    cards = K.new_cards(L.parse_response(third, "flashcards"), now)

    answers = first.unionByName(second).unionByName(third)
    failed = answers.filter(F.col("raw").isNull()).select("paper_id", "task", "chunk_no", "error")
    metadata = L.parse_response(first, "metadata").select("paper_id", F.col("parsed").alias("metadata"))
    run = papers.join(texts.select("paper_id"), "paper_id", "left_semi").join(metadata, "paper_id", "left")
    errors = failed.limit(0).select("paper_id", F.col("error").alias("message"))
    index = K.paper_index(run, failed, errors)
    replaced = [c for c in index.columns if c != "paper_id"]
    described = run.drop(*replaced).join(index, "paper_id").withColumn("has_document", F.lit(True))
    knowledge = KnowledgeBase(
        papers=described,
        sections=sections,
        entities=entities,
        relations=relations,
        findings=findings,
        methods=K.methods(found),
        datasets=K.datasets(found),
        cards=cards,
        annotations=papers.select("paper_id").limit(0),
    )
    return knowledge, failed


def highlight(
    documents: DataFrame, client: Callable[[], L.Client], concurrency: int | None = None, page: str | None = None,
    kept: AnswerTable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Key sentences of every document ``(doc_id, [page,] text)`` and their statistics with status."""
    documents = T.unwrap_lines(documents.withColumn("doc_id", F.col("doc_id").cast("string")))
    chunks = stored(T.pack_sentence_chunks(documents, page=page))
    answers = answer(L.highlight_requests(chunks), client, concurrency, kept)
    chosen = H.selections(L.parse_response(answers, "highlight"), "paper_id").withColumnRenamed("paper_id", "doc_id")
    applied = H.apply_selections(chunks.select("doc_id", F.inline("items")), chosen)
    stats = H.highlight_stats(applied)
    # Documents without any selection are failures too.
    every = documents.select("doc_id").distinct().join(stats, "doc_id", "left").fillna(0)
    return applied, H.highlight_status(every)


def summarise(
    texts: DataFrame, client: Callable[[], L.Client], concurrency: int | None = None, kept: AnswerTable | None = None
) -> DataFrame:
    """``(paper_id, summary, summary_error)``: a paper whose summary fails after all attempts has a reason instead."""
    requests = L.text_requests(texts.withColumn("paper_id", F.col("paper_id").cast("string")), ("summary",))
    parsed = L.parse_response(answer(requests, client, concurrency, kept), "summary")
    reason = F.when(F.col("parse_failed"), F.coalesce("error", F.lit("no JSON object")))
    return parsed.select("paper_id", F.col("parsed").alias("summary"), reason.alias("summary_error"))


def simplify(
    chunks: DataFrame, client: Callable[[], L.Client], concurrency: int | None = None, kept: AnswerTable | None = None
) -> DataFrame:
    """``(paper_id, chunk_no, text, simplify_error)``: every chunk of text in plain words, or why it is not there."""
    answers = answer(L.simplify_requests(chunks), client, concurrency, kept)
    return answers.select("paper_id", "chunk_no", F.trim("raw").alias("text"), F.col("error").alias("simplify_error"))
