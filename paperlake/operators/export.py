"""Exports: entity and relation rows, citations, and Markdown notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import (
    UNTITLED,
    bibtex_escape,
    cite_key,
    or_default,
    safe_filename,
    split_name,
    title_case,
    yaml_quote,
)
from paperlake.operators.knowledge import IMPORTANCE, CONFIDENCE, entity_papers, global_entities
from paperlake.schemas import KnowledgeBase

SCHEMA_VERSION = "1.0.0"
KEY_PREFIX = "paperlake"
# Lines of so many chunks are one part of a note; lines in order of a text (a time, an id) go by its first characters.
CHUNKS_IN_PART, KEY_IN_PART = 64, 10


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def optional(name: str, df: DataFrame, kind: str = "string") -> Column:
    """A column, or a null where the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# ---- rows -----------------------------------------------------------------------------------------------------


def export_entities(kb: KnowledgeBase) -> DataFrame:
    titles = kb.papers.select("paper_id", F.col("title").alias("paper_title"))
    return kb.entities.join(titles, "paper_id").select(
        "id",
        text_or_empty("name").alias("name"),
        text_or_empty("type").alias("type"),
        text_or_empty("definition").alias("definition"),
        F.coalesce("importance", F.lit(IMPORTANCE)).alias("importance"),
        text_or_empty("paper_title").alias("paper_title"),
    )


def export_relations(kb: KnowledgeBase) -> DataFrame:
    """Relation rows; an end is shown by its entity's name, else the relation's own text, else the id.

    Relations that were resolved in this run carry the names of their ends; those read from documents are looked up.
    """
    titles = kb.papers.select("paper_id", F.col("title").alias("paper_title"))
    rows = kb.relations.join(titles, "paper_id")
    if "source_name" not in rows.columns:
        names = kb.entities.select("paper_id", F.col("id").alias("_id"), text_or_empty("name").alias("_name"))
        for side in ("source", "target"):
            end = names.select("paper_id", F.col("_id").alias(f"{side}_entity_id"), F.col("_name").alias(f"{side}_name"))
            rows = rows.join(end, ["paper_id", f"{side}_entity_id"], "left")
    return rows.select(
        "id",
        F.coalesce("source_name", "source", "source_entity_id").alias("source"),
        F.coalesce("target_name", "target", "target_entity_id").alias("target"),
        text_or_empty("type").alias("type"),
        text_or_empty("description").alias("description"),
        F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"),
        text_or_empty("paper_title").alias("paper_title"),
    )


def author_names(metadata: str = "metadata") -> Column:
    authors = F.coalesce(F.col(f"{metadata}.authors"), F.array().cast("array<struct<name:string,affiliation:string>>"))
    return F.transform(authors, lambda a: text_or_empty(a["name"]))


def to_bibtex(papers: DataFrame) -> DataFrame:
    """One entry per paper; a stored entry wins. Joined by newlines the entries form a bibliography file."""
    m = {name: F.col(f"metadata.{name}") for name in ("title", "year", "doi", "venue", "bibtex")}

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))

    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("@article{"), cite_key(F.replace(F.col("paper_id"), F.lit("pk_"), F.lit(""))), F.lit(",")),
        field("title", bibtex_escape(text_or_empty(m["title"]))),
        field("author", bibtex_escape(F.array_join(author_names(), " and "))),
        field("year", F.when(m["year"] != 0, m["year"].cast("string")).otherwise("")),
        F.when(F.length(m["doi"]) > 0, field("doi", bibtex_escape(m["doi"]))),
        F.when(F.length(m["venue"]) > 0, field("journal", bibtex_escape(m["venue"]))),
        F.lit("}\n"),
    )
    return papers.select("paper_id", or_default(m["bibtex"], entry).alias("entry"))


def to_csl(papers: DataFrame) -> DataFrame:
    """One CSL-JSON item per paper; a stored item wins, empty optional fields are left out."""
    m = {
        name: F.col(f"metadata.{name}") for name in ("title", "year", "doi", "venue", "url", "abstract", "csl_json")
    }

    def author(name: Column) -> Column:
        parts = split_name(name)
        return F.struct(parts["family"].alias("family"), parts["given"].alias("given"))

    def given(value: Column) -> Column:
        return F.when(F.length(value) > 0, value)

    item = F.struct(
        F.lit("article-journal").alias("type"),
        F.col("paper_id").alias("id"),
        text_or_empty(m["title"]).alias("title"),
        F.transform(author_names(), author).alias("author"),
        text_or_empty(m["abstract"]).alias("abstract"),
        F.when(m["year"] != 0, F.struct(F.array(F.array(m["year"])).alias("date-parts"))).alias("issued"),
        given(m["doi"]).alias("DOI"),
        given(m["venue"]).alias("container-title"),
        given(m["url"]).alias("URL"),
    )
    return papers.select("paper_id", item.alias("item"), or_default(m["csl_json"], F.to_json(item)).alias("csl"))


# ---- notes, plain style ---------------------------------------------------------------------------------------


def section_lines(
    items: DataFrame, keys: list[str], sec: int, line: Column, k: Column, a: Column, b: Column
) -> DataFrame:
    """Lines of one note section with their order; null lines are dropped."""
    rows = items.select(
        *keys,
        F.lit(sec).alias("sec"),
        F.coalesce(k.cast("string"), F.lit("")).alias("k"),
        F.coalesce(a, F.lit(0)).cast("bigint").alias("a"),
        F.coalesce(b, F.lit(0)).cast("bigint").alias("b"),
        line.alias("line"),
    )
    return rows.filter(F.col("line").isNotNull())


def note_parts(
    lines: DataFrame, keys: list[str], headings: dict[int, str], closing: dict[int, str], whole: bool = False
) -> DataFrame:
    """Lines of notes gathered into parts: ``(*keys, part, heading, content, closing)``.

    A part is a run of a section's lines. Which part a line is in depends on the line alone, so notes of any length are
    gathered alike, in one shuffle, and a long one is spread over tasks. ``part`` sorts the parts of a note. The heading
    of a section stands before its first part and its closing after the last one (:func:`whole_notes`). With ``whole``
    the lines are dealt by note: where whole notes follow, they meet there in any case, and are shuffled once.
    """
    lines = lines.repartition(*keys) if whole else lines

    def of_section(texts: dict[int, str]) -> Column:
        pairs = [F.lit(x) for pair in texts.items() for x in pair]
        return F.create_map(*pairs)[F.col("part.sec")] if pairs else F.lit(None).cast("string")

    by_chunk = F.when(F.col("k") == "", F.floor(F.col("a") / CHUNKS_IN_PART)).otherwise(0)
    part = F.struct("sec", F.substring("k", 1, KEY_IN_PART).alias("k"), by_chunk.alias("a"))
    ordered = F.sort_array(F.collect_list(F.struct("k", "a", "b", "line")))
    parts = lines.groupBy(*keys, part.alias("part")).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content")
    )
    return parts.select(*keys, "part", of_section(headings).alias("heading"), "content", of_section(closing).alias("closing"))


def whole_notes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, content)``: the parts of every note put together. A note's text is one value here; what has to scale
    beyond that works on the parts."""
    rows = F.sort_array(F.collect_list(F.struct("part", "heading", "content", "closing")))

    def other(at: Column, i: Column) -> Column:
        return ~F.get("_parts", at)["part"]["sec"].eqNullSafe(F.get("_parts", i)["part"]["sec"])

    def lines(x: Column, i: Column) -> Column:
        return F.array(
            F.when((i == 0) | other(i - 1, i), x["heading"]), x["content"], F.when(other(i + 1, i), x["closing"])
        )

    texts = F.filter(F.flatten(F.transform("_parts", lines)), lambda x: x.isNotNull())
    return parts.groupBy(*keys).agg(rows.alias("_parts")).select(*keys, F.array_join(texts, "\n").alias("content"))


def _by_pos(items: DataFrame, sec: int, line: Column) -> DataFrame:
    chunk = F.col("chunk_no") if "chunk_no" in items.columns else (
        F.col("first_chunk") if "first_chunk" in items.columns else F.lit(0)
    )
    pos = F.col("first_pos") if "first_pos" in items.columns else F.col("pos")
    return section_lines(items, ["paper_id"], sec, line, F.lit(""), chunk, pos)


def paper_note_parts(kb: KnowledgeBase, key_prefix: str = KEY_PREFIX, whole: bool = False) -> DataFrame:
    """Parts of the plain paper notes: front matter, metadata, abstract, then one section per kind of item."""
    m = {n: F.col(f"metadata.{n}") for n in ("title", "year", "doi", "venue", "abstract", "keywords")}
    title = F.coalesce(m["title"], F.lit(UNTITLED))

    def quoted(names: Column) -> Column:
        return F.array_join(F.transform(names, yaml_quote), ", ")

    def some(value: Column, line: Column) -> Column:
        return F.when(F.length(value.cast("string")) > 0, line)

    has_year = F.when(m["year"] != 0, m["year"].cast("string"))
    header = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), yaml_quote(title)),
        F.concat(F.lit("authors: ["), quoted(author_names()), F.lit("]")),
        F.concat(F.lit("year: "), text_or_empty(m["year"].cast("string"))),
        some(m["doi"], F.concat(F.lit("doi: "), yaml_quote(m["doi"]))),
        F.when(F.size(m["keywords"]) > 0, F.concat(F.lit("tags: ["), quoted(m["keywords"]), F.lit("]"))),
        F.concat(F.lit(f"{key_prefix}_id: "), yaml_quote(F.col("paper_id"))),
        F.lit("---\n"),
        F.concat(F.lit("# "), title),
        F.lit("\n## Metadata"),
        F.concat(F.lit("- **Authors**: "), F.array_join(author_names(), ", ")),
        some(has_year, F.concat(F.lit("- **Year**: "), has_year)),
        some(m["venue"], F.concat(F.lit("- **Venue**: "), m["venue"])),
        some(m["doi"], F.concat(F.lit("- **DOI**: ["), m["doi"], F.lit("](https://doi.org/"), m["doi"], F.lit(")"))),
        F.lit(""),
        some(m["abstract"], F.concat(F.lit("## Abstract\n"), m["abstract"], F.lit("\n"))),
    )
    entity = F.concat(
        F.lit("- [["), text_or_empty("name"), F.lit("]] ("), text_or_empty("type"), F.lit(") - "), text_or_empty("definition")
    )
    relation = F.concat(
        F.lit("- [["), text_or_empty("source"), F.lit("]] **"), text_or_empty("type"), F.lit("** [["), text_or_empty("target"), F.lit("]]")
    )
    finding = F.concat(
        F.lit("- **"), title_case(text_or_empty("type")), F.lit("**: "), text_or_empty("statement"),
        text_or_empty(F.when(F.length("evidence") > 0, F.concat(F.lit("\n  - Evidence: "), F.col("evidence")))),
    )
    method = F.concat(F.lit("### "), F.coalesce("name", F.lit("Method")), F.lit("\n"), text_or_empty("description"), F.lit("\n"))
    card = F.concat(F.lit("**Q:** "), text_or_empty("front"), F.lit("\n**A:** "), text_or_empty("back"), F.lit("\n"))
    lines = (
        section_lines(kb.papers, ["paper_id"], 0, header, F.lit(""), F.lit(0), F.lit(0))
        .unionByName(_by_pos(kb.entities, 1, entity))
        .unionByName(_by_pos(kb.relations, 2, relation))
        .unionByName(_by_pos(kb.findings, 3, finding))
        .unionByName(_by_pos(kb.methods, 4, method))
        .unionByName(_by_pos(kb.cards, 5, card))
    )
    headings = {
        1: "## Key Concepts", 2: "## Relationships", 3: "## Key Findings", 4: "## Methods", 5: "## Flashcards"
    }
    return note_parts(lines, ["paper_id"], headings, {1: "", 2: "", 3: ""}, whole)


def paper_notes(kb: KnowledgeBase, key_prefix: str = KEY_PREFIX) -> DataFrame:
    """``(paper_id, content)``."""
    return whole_notes(paper_note_parts(kb, key_prefix, whole=True), ["paper_id"])


def _quoted_literal(c: Column) -> Column:
    """A string literal in single quotes, or in double ones if that saves escapes."""
    body = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def _time_key(created_at: str, *rest: str) -> Column:
    stamp = F.coalesce(F.date_format(created_at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    return F.concat_ws("/", stamp, *[F.col(c) for c in rest])


def entity_note_parts(kb: KnowledgeBase, whole: bool = False) -> DataFrame:
    """Parts of the plain entity notes, per user and key: attributes of the first appearance, then every paper title."""
    keys = ["user_id", "entity_key"]
    first = global_entities(kb.entities, kb.papers)
    header = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("type: "), F.coalesce("type", F.lit("concept"))),
        F.when(
            F.size("aliases") > 0,
            F.concat(F.lit("aliases: ["), F.array_join(F.transform("aliases", _quoted_literal), ", "), F.lit("]")),
        ),
        F.lit("---\n"),
        F.concat(F.lit("# "), F.col("name")),
        F.lit(""),
        F.when(F.length("definition") > 0, F.concat(F.col("definition"), F.lit("\n"))),
    )
    occurrences = entity_papers(kb.entities, kb.papers)
    lines = section_lines(first, keys, 0, header, F.lit(""), F.lit(0), F.lit(0)).unionByName(
        section_lines(
            occurrences, keys, 1,
            F.concat(F.lit("- [["), F.coalesce("title", F.lit(UNTITLED)), F.lit("]]")),
            _time_key("created_at", "paper_id"), F.col("first_chunk"), F.col("first_pos"),
        )
    )
    return note_parts(lines, keys, {1: "## Appears In"}, {1: ""}, whole)


def entity_notes(kb: KnowledgeBase) -> DataFrame:
    """``(user_id, entity_key, content)``."""
    return whole_notes(entity_note_parts(kb, whole=True), ["user_id", "entity_key"])


def note_paths(notes: DataFrame, folder: str, item: Column) -> DataFrame:
    """Add ``relative_path`` below the user's own folder. Of notes with one name, ignoring case, the first by ``item``
    has it plain and the others carry a hash of theirs, so no two notes meet."""
    own = notes.withColumns({"_item": item.cast("string"), "_name": F.lower("name")})
    first = own.groupBy("user_id", "_name").agg(F.min("_item").alias("_first"))
    suffix = F.when(F.col("_item") != F.col("_first"), F.concat(F.lit("-"), F.substring(F.sha2("_item", 256), 1, 16)))
    path = F.concat(F.col("user_id").cast("string"), F.lit(f"/{folder}/"), F.col("name"), text_or_empty(suffix), F.lit(".md"))
    return own.join(first, ["user_id", "_name"]).withColumn("relative_path", path).drop("_item", "_name", "_first")


def notes_table(kb: KnowledgeBase, key_prefix: str = KEY_PREFIX, whole: bool = False) -> DataFrame:
    """All plain notes in parts: ``(relative_path, user_id, part, heading, content, closing)``; paths are unique.

    With ``whole`` they are whole notes ``(relative_path, user_id, content)``, put together where their lines were dealt
    (:func:`note_parts`): by path their texts would be shuffled once more."""
    titles = kb.papers.select("paper_id", "user_id", safe_filename(F.coalesce("title", F.lit(UNTITLED))).alias("name"))
    names = global_entities(kb.entities, kb.papers).select("user_id", "entity_key", safe_filename(F.col("name")).alias("name"))
    papers = paper_note_parts(kb, key_prefix, whole).join(note_paths(titles, "papers", F.col("paper_id")), "paper_id")
    entities = entity_note_parts(kb, whole).join(note_paths(names, "entities", F.col("entity_key")), ["user_id", "entity_key"])
    columns = ["relative_path", "user_id", "part", "heading", "content", "closing"]
    if whole:
        papers = whole_notes(papers, ["paper_id", "user_id", "relative_path"])
        entities = whole_notes(entities, ["user_id", "entity_key", "relative_path"])
        columns = ["relative_path", "user_id", "content"]
    return papers.select(*columns).unionByName(entities.select(*columns))
