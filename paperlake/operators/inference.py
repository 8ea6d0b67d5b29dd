"""Batch model inference: build request tables, call a client from the executors, parse responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from queue import SimpleQueue
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.text import WS, strip
from paperlake.operators.text import budget
from paperlake.schemas import RESPONSES

# Characters of a text in one request.
SLICE_CHARS = 8000
ATTEMPTS, BASE_DELAY, TEMPERATURE = 3, 2.0, 0.1
IN_FLIGHT = 4
# Bytes of contents that a task turns into Python strings at a time.
SLICE_BYTES = 1_000_000
MAX_TOKENS = {"highlight": 2048}
DEFAULT_MAX_TOKENS = 4096
BLANKS = r"[ \t]"
SUMMARY_PREFIX = "Paper text:\n\n"
HIGHLIGHT_PREFIX = "Sentence candidates:\n\n"

PROMPTS = {
    "metadata": "Read the opening pages of a paper and answer with one JSON object holding its bibliographic data: "
    "title, authors (name, affiliation), year, doi, arxiv_id, venue, abstract, keywords.",
    "sections": "List the sections of this paper as JSON {\"sections\": [{title, level, summary}]} in reading order.",
    "entities": "List the concepts, methods, models, datasets, metrics, tasks, people and organisations in this text, "
    "and how they relate, as JSON {\"entities\": [{name, type, aliases, definition, importance}], "
    "\"relationships\": [{source, target, type, description, confidence}]}.",
    "findings": "Report the findings, methods and datasets of this paper as JSON {\"findings\": [{type, statement, "
    "evidence}], \"methods\": [{name, description, inputs, outputs}], \"datasets\": [{name, description, usage}]}.",
    "flashcards": "Write question and answer cards for these entities and findings as JSON {\"flashcards\": "
    "[{front, back, tags, difficulty}]}, difficulty from 1 to 5.",
    "summary": "Summarise this paper as one JSON object: one_liner, novelty_score, estimated_minutes, story, "
    "key_numbers, pipeline, contributions, limitations, keywords.",
    "highlight": "Pick the key sentences among these candidates and sort each into core_conclusion, "
    "method_innovation or key_data. Answer with JSON {\"highlights\": [{sentence_id, category}]}.",
    "simplify": "Rewrite text in plain everyday English.",
}
SIMPLIFY_TEMPLATE = (
    "Say the same in short sentences and common words. Leave every {{v*}} formula mark as it is. "
    "Answer with the rewritten text only.\n\nText: %s\n\nRewritten:"
)


def _request(df: DataFrame, task: str, content: Column, chunk: Column | None = None, key: str = "paper_id") -> DataFrame:
    return df.select(
        F.col(key).alias("paper_id"),
        F.lit(task).alias("task"),
        (F.lit(0) if chunk is None else chunk).alias("chunk_no"),
        F.lit(PROMPTS[task]).alias("system"),
        content.alias("content"),
    )


TEXT_TASKS = ("metadata", "sections", "findings", "summary")


def text_requests(
    texts: DataFrame, tasks: Sequence[str] = TEXT_TASKS, slice_chars: int = SLICE_CHARS, first_slice_only: bool = False
) -> DataFrame:
    """Requests that need only the assembled text, in one pass over the texts.

    ``metadata`` sees the opening pages and ``summary`` a budgeted context, which is what they are. ``sections`` and
    ``findings`` see the whole text, in slices of ``slice_chars``, a request each (``chunk_no``); with
    ``first_slice_only`` they see what comes first and no more.
    """
    last = F.lit(0) if first_slice_only else F.greatest(F.length("text") - 1, F.lit(0))
    slices = F.transform(
        F.sequence(F.lit(0), last, F.lit(slice_chars)), lambda at: F.substring("text", at + 1, F.lit(slice_chars))
    )
    contents = {
        "metadata": F.array(F.array_join(F.slice("page_texts", 1, 2), "\n\n")),
        "sections": slices,
        "findings": slices,
        "summary": F.array(F.concat(F.lit(SUMMARY_PREFIX), budget(F.col("text")))),
    }

    def of(task: str) -> Column:
        return F.transform(
            contents[task], lambda c, i: F.struct(F.lit(task).alias("task"), i.alias("chunk_no"), c.alias("content"))
        )

    prompt = F.create_map(*[F.lit(x) for task in tasks for x in (task, PROMPTS[task])])
    return texts.select("paper_id", F.inline(F.concat(*[of(task) for task in tasks]))).select(
        "paper_id", "task", "chunk_no", prompt[F.col("task")].alias("system"), "content"
    )


def entity_requests(chunks: DataFrame) -> DataFrame:
    return _request(chunks, "entities", F.col("text"), F.col("chunk_no"))


def highlight_requests(chunks: DataFrame, doc_id: str = "doc_id", sentence_chars: int | None = None) -> DataFrame:
    """One request per packed chunk (``pack_sentence_chunks``): a JSON list of its sentences, whole or each cut to
    ``sentence_chars``."""
    items = F.transform(
        "items",
        lambda s: F.struct(
            s["sentence_id"].alias("sentence_id"),
            (s["page_index"] + 1).alias("page"),
            (s["text"] if sentence_chars is None else F.substring(s["text"], 1, sentence_chars)).alias("text"),
        ),
    )
    return _request(chunks, "highlight", F.concat(F.lit(HIGHLIGHT_PREFIX), F.to_json(items)), F.col("chunk_no"), doc_id)


def card_requests(entities: DataFrame, findings: DataFrame, first: tuple[int, int] | None = None) -> DataFrame:
    """JSON of the entities and findings that cards are to be made of.

    Every entity and finding goes into a request: one for each chunk they came from (``chunk_no``), so what a request
    holds is bounded by the answers for that chunk. With ``first`` a paper has one request, for its first so many
    entities and findings; the two limits are ranks, which Spark applies before it shuffles.
    """
    from pyspark.sql import Window as W

    def taken(df: DataFrame, n: int, order: list[str]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("paper_id").orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).withColumn("_chunk", F.lit(0))

    chunk = F.coalesce("chunk_no", F.lit(0)) if "chunk_no" in findings.columns else F.lit(0)
    if first is None:
        entities = entities.withColumns({"_rank": F.col("first_pos"), "_chunk": F.col("first_chunk")})
        findings = findings.withColumns({"_rank": F.col("pos"), "_chunk": chunk})
    else:
        entities = taken(entities, first[0], ["first_chunk", "first_pos"])
        findings = taken(findings, first[1], ["pos"])
    ents = entities.select(
        "paper_id", F.col("_chunk").cast("int"), F.col("_rank").cast("bigint"),
        F.struct("name", "type", "aliases", "definition", "importance", "id").alias("entity"),
    )
    finds = findings.select(
        "paper_id", F.col("_chunk").cast("int"), F.col("_rank").cast("bigint"),
        F.struct("type", "statement", "evidence", "id").alias("finding"),
    )
    both = ents.unionByName(finds, allowMissingColumns=True)

    def listed(name: str) -> Column:
        ranked = F.collect_list(F.when(F.col(name).isNotNull(), F.struct("_rank", name)))
        return F.transform(F.sort_array(ranked), lambda x: x[name])

    # Dealt before they are gathered, so that tasks do not sort what they have into lists first.
    grouped = both.repartition("paper_id", "_chunk").groupBy("paper_id", "_chunk").agg(listed("entity").alias("entities"), listed("finding").alias("findings"))
    return _request(grouped, "flashcards", F.to_json(F.struct("entities", "findings")), F.col("_chunk"))


def simplify_requests(chunks: DataFrame) -> DataFrame:
    head, tail = (SIMPLIFY_TEMPLATE % "\0").replace("{{", "{").replace("}}", "}").split("\0")
    return _request(chunks, "simplify", F.concat(F.lit(head), F.col("text"), F.lit(tail)), F.col("chunk_no"))


# ---- calling the model ----------------------------------------------------------------------------------------


class BadRequest(Exception):
    """The service refused the request itself (HTTP 400)."""


class Client(Protocol):
    def complete(self, system: str, content: str, temperature: float, max_tokens: int, json_mode: bool) -> str: ...


RESPONSE_COLUMNS = "paper_id string, task string, chunk_no int, raw string, error string, attempts int"


def content_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices whose contents have about ``SLICE_BYTES``, so that what a task builds at a time is bounded by that and by
    the longest content."""
    sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > SLICE_BYTES:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def infer(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    concurrency: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Answer every request: ``(paper_id, task, chunk_no, raw, error, attempts)``.

    Every partition keeps ``in_flight`` calls going, each on a client of its own, since a call mostly waits;
    ``concurrency`` is the number of partitions, or None for those of the input. A call is
    tried three times with growing pauses; a refused JSON mode is retried without it. After the last failure ``raw`` is
    null and ``error`` says why, so no failed call ends the job. Write the result to storage before using it: model
    calls must not be repeated when a later stage is recomputed.
    """
    rows = requests.select(
        F.col("paper_id").cast("string"), "task", F.col("chunk_no").cast("int"), "system", "content"
    )
    if concurrency is not None:
        rows = rows.repartition(concurrency)

    def call(client: Client, task: str, system: str, content: str) -> str:
        tokens = MAX_TOKENS.get(task, DEFAULT_MAX_TOKENS)
        json_mode = task == "highlight"
        try:
            return client.complete(system, content, TEMPERATURE, tokens, json_mode)
        except BadRequest:
            if not json_mode:
                raise
            return client.complete(system, content, TEMPERATURE, tokens, False)

    def answer(client: Client, task: str, system: str, content: str) -> tuple[str | None, str | None, int]:
        for attempt in range(ATTEMPTS):
            try:
                return call(client, task, system, content), None, attempt + 1
            except Exception as exc:
                error = str(exc)
                if attempt + 1 < ATTEMPTS:
                    sleep(BASE_DELAY * 2**attempt)
        return None, error, ATTEMPTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: SimpleQueue = SimpleQueue()
        for _ in range(in_flight):
            free.put(client_factory())

        def one(row: tuple[str, str, str]) -> tuple[str | None, str | None, int]:
            client = free.get()
            try:
                return answer(client, *row)
            finally:
                free.put(client)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for part in content_slices(batch):
                    answers = list(pool.map(one, zip(*(part.column(c).to_pylist() for c in ("task", "system", "content")))))
                    raw, error, attempts = zip(*answers)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("paper_id", "task", "chunk_no")), pa.array(raw, pa.string()),
                         pa.array(error, pa.string()), pa.array(attempts, pa.int32())],
                        ["paper_id", "task", "chunk_no", "raw", "error", "attempts"],
                    )

    return rows.mapInArrow(run, RESPONSE_COLUMNS)


# ---- reading the answer ---------------------------------------------------------------------------------------


def parse_response(responses: DataFrame, task: str) -> DataFrame:
    """Add ``parsed`` (null where the answer holds no JSON object) and ``parse_failed`` for one task's answers.

    Fences are dropped (the first line, and the last if it is just a fence). If the rest is not JSON, what lies between
    the first ``{`` and the last ``}`` is tried. An answer is parsed once, to a VARIANT; the typed columns are read from
    that, and a value of another type than the task's is null. The steps are columns of their own so that each runs once
    per row.
    """
    answers = with_variant(responses.filter(F.col("task") == task))
    typed = T.StructType.fromDDL(RESPONSES[task]).simpleString()
    return answers.withColumns(
        {"parsed": F.try_variant_get("answer", "$", typed), "parse_failed": F.col("answer").isNull()}
    ).drop("answer")


def with_variant(responses: DataFrame) -> DataFrame:
    """Add ``answer``: the JSON object of ``raw`` as a VARIANT, null where there is none."""
    fenced = F.regexp_replace(F.regexp_replace("_text", r"\A[^\n]*(\n|\z)", ""), rf"(\A|\n){BLANKS}*```{BLANKS}*\z", "")
    body = F.when(F.startswith("_text", F.lit("```")), fenced).otherwise(F.col("_text"))
    whole = F.when(F.rlike("_body", F.lit(rf"\A{WS}*\{{")), F.try_parse_json("_body"))
    braces = F.try_parse_json(F.regexp_extract("_body", r"(?s)(\{.*\})", 1))
    return (
        responses.withColumn("_text", strip(F.col("raw"))).withColumn("_body", body)
        .withColumn("answer", F.coalesce(whole, braces)).drop("_text", "_body")
    )


def answer_fields(responses: DataFrame) -> DataFrame:
    """(task, schema): the type of each task's answers as they come, merged over all of them. What a prompt does not ask
    for, or asks for under another name, is seen there before a typed read makes it null."""
    return with_variant(responses).groupBy("task").agg(F.schema_of_variant_agg("answer").alias("schema"))
