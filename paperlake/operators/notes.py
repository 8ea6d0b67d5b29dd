"""Linked notes: paper and entity notes that point at each other, for incremental writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.functions.text import UNTITLED, WS, key_nfkc, or_default, sanitize_name, strip, yaml_quote
from paperlake.operators.export import (
    KEY_PREFIX,
    note_parts,
    optional,
    section_lines,
    text_or_empty,
    whole_notes,
    _by_pos,
    _time_key,
)
from paperlake.operators.knowledge import ENTITY_TYPE, incident_relations
from paperlake.operators.lifecycle import mapping_id, note_target
from paperlake.schemas import KnowledgeBase

# Wording of the note format.
HEADINGS = {
    1: "## AI 速览",
    2: "## 论文信息",
    3: "## 摘要",
    4: "## AI 总结",
    5: "## 章节结构",
    6: "## 实体",
    7: "## 关系",
    8: "## 发现",
    9: "## 方法",
    10: "## 数据集",
    11: "## 闪卡",
    12: "## 用户笔记",
    13: "## 同步信息",
}
STORY = (("problem", "问题"), ("method", "方法"), ("results", "结果"), ("impact", "影响"))
APPEARS_IN, RELATED = "## 出现在哪些论文", "## 相关关系"
DEFAULT_RELATION = "relates_to"


def note_title(papers: DataFrame) -> Column:
    """Title of a paper's note: the document's, else the index row's, else ``Untitled``."""
    return or_default(strip(or_default(F.col("metadata.title"), or_default(F.col("title"), UNTITLED))), UNTITLED)


def _line(label: str, value: Column, suffix: str = "") -> Column:
    """``- label：value`` where the value is there."""
    text = value.cast("string")
    return F.when(F.length(text) > 0, F.concat(F.lit(f"- {label}："), text, F.lit(suffix)))


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def _block(heading: str, lines: Column) -> Column:
    """Heading plus lines, or null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n### {heading}\n"), F.array_join(lines, "\n")))


def _present(c: Column) -> Column:
    return F.filter(c, lambda x: F.length(x) > 0)


def _number_line(item: Column) -> Column:
    head = F.regexp_replace(
        F.concat(F.lit("- **"), text_or_empty(item["value"]), F.lit("** "), text_or_empty(item["label"])), r"\s+\z", ""
    )
    context = F.when(F.length(item["context"]) > 0, F.concat(F.lit("："), item["context"]))
    return F.concat(head, text_or_empty(context))


def _keyword_line(item: Column) -> Column:
    kind = F.when(F.length(item["type"]) > 0, F.concat(F.lit(" ("), item["type"], F.lit(")")))
    return F.concat(F.lit("- "), item["text"], text_or_empty(kind))


def overview(summary: str = "summary_page") -> Column:
    """The summary section below its heading; '' for an empty summary, null without one."""
    s = lambda name: F.col(f"{summary}.{name}")
    bullet = lambda x: F.concat(F.lit("- "), x)
    steps = F.coalesce(s("pipeline.steps"), F.array().cast("array<string>"))
    flow = F.array_join(
        _present(F.concat(F.array(s("pipeline.input")), steps, F.array(s("pipeline.output")))), " -> "
    )
    story = [
        F.when(F.length(s(f"story.{key}")) > 0, F.concat(F.lit(f"\n### {label}\n"), s(f"story.{key}")))
        for key, label in STORY
    ]
    body = F.concat_ws(
        "\n",
        _line("一句话", s("one_liner")),
        _line("预计阅读", _nonzero(s("estimated_minutes")), " 分钟"),
        _line("新颖度", _nonzero(s("novelty_score")), "/5"),
        *story,
        _block("关键数据", F.transform(s("key_numbers"), _number_line)),
        F.when(F.length(flow) > 0, F.concat(F.lit("\n### 技术流程\n"), flow)),
        _block("主要贡献", F.transform(_present(s("contributions")), bullet)),
        _block("局限性", F.transform(_present(s("limitations")), bullet)),
        _block("关键概念", F.transform(F.filter(s("keywords"), lambda k: F.length(k["text"]) > 0), _keyword_line)),
    )
    return F.when(F.col(summary).isNotNull(), body)


def _paper_info() -> Column:
    m = lambda name: F.col(f"metadata.{name}")
    named = F.filter(m("authors"), lambda a: F.length(a["name"]) > 0)
    authors = F.array_join(
        F.transform(
            named,
            lambda a: F.concat(
                a["name"],
                text_or_empty(F.when(F.length(a["affiliation"]) > 0, F.concat(F.lit(" ("), a["affiliation"], F.lit(")")))),
            ),
        ),
        ", ",
    )
    year = _nonzero(m("year"))
    shown = F.concat_ws("", authors, year.cast("string"), m("venue"), m("doi"), m("url")) != ""
    lines = F.concat_ws(
        "\n",
        _line("作者", authors),
        _line("年份", year),
        _line("会议/期刊", m("venue")),
        _line("DOI", m("doi")),
        _line("arXiv", m("arxiv_id")),
        _line("链接", m("url")),
        _line("关键词", F.array_join(m("keywords"), ", ")),
    )
    return F.when(shown, lines)


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: strip(v) != ""), ", ")


def with_links(df: DataFrame, name: str, out: str, entity_links: DataFrame) -> DataFrame:
    """Add the link target of an entity name: its note in this user's vault, else the sanitised name.

    ``entity_links``: (user_id, entity_key, target), one row per key.
    """
    links = entity_links.select("user_id", F.col("entity_key").alias("_key"), F.col("target").alias("_target"))
    return (
        df.withColumn("_key", key_nfkc(F.col(name)))
        .join(links, ["user_id", "_key"], "left")
        .withColumn(out, F.coalesce("_target", sanitize_name(F.col(name))))
        .drop("_key", "_target")
    )


def _relation_line(with_confidence: bool) -> Column:
    described = F.when(F.length("description") > 0, F.concat(F.lit("："), F.col("description")))
    trusted = F.concat(F.lit("（置信度："), F.col("confidence").cast("string"), F.lit("）"))
    return F.concat(
        F.lit("- [["), F.col("_from"), F.lit("]] **"), or_default(F.col("type"), DEFAULT_RELATION), F.lit("** [["),
        F.col("_to"), F.lit("]]"), text_or_empty(described),
        text_or_empty(trusted) if with_confidence else F.lit(""),
    )


def _linked_relations(relations: DataFrame, entity_links: DataFrame) -> DataFrame:
    named = relations.filter((F.length("source") > 0) & (F.length("target") > 0))
    return with_links(with_links(named, "source", "_from", entity_links), "target", "_to", entity_links)


def linked_paper_note_parts(
    kb: KnowledgeBase,
    paper_links: DataFrame,
    entity_links: DataFrame,
    summaries: DataFrame | None = None,
    live_cards: DataFrame | None = None,
    live_annotations: DataFrame | None = None,
    key_prefix: str = KEY_PREFIX,
    whole: bool = False,
) -> DataFrame:
    """Parts of the linked paper notes.

    ``paper_links``: (paper_id, target), the name of each paper's note. ``summaries``: (task_id, summary_page).
    Live cards replace a document's own where the paper has any; annotations come from the live table only.
    """
    papers = kb.papers.join(paper_links.select("paper_id", F.col("target").alias("_note")), "paper_id")
    if summaries is not None:
        papers = papers.join(summaries.select("task_id", "summary_page"), "task_id", "left")
    else:
        from paperlake.schemas import SUMMARY

        papers = papers.withColumn("summary_page", F.lit(None).cast(f"struct<{_struct_body(SUMMARY)}>"))
    owners = kb.papers.select("paper_id", "user_id")
    title = note_title(papers)
    header = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit(f"{key_prefix}_id: "), yaml_quote(F.col("paper_id"))),
        F.lit(f'{key_prefix}_type: "paper"'),
        F.concat(F.lit("title: "), yaml_quote(title)),
        F.lit("---\n"),
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.concat(F.lit("个人笔记：[["), sanitize_name(F.concat("_note", F.lit(" - Notes"))), F.lit("]]\n")),
    )
    summary = optional("summary", papers)
    synced = F.concat_ws(
        "\n",
        _line("提取模型", optional("extraction_model", papers)),
        _line("提取时间", optional("extracted_at", papers)),
    )
    whole = {
        0: header,
        1: overview(),
        2: _paper_info(),
        3: F.when(F.length("metadata.abstract") > 0, F.col("metadata.abstract")),
        4: F.when(F.length(summary) > 0, summary),
        13: F.when(synced != "", synced),
    }
    blocks = F.filter(
        F.array(*[F.struct(F.lit(sec).alias("sec"), line.alias("line")) for sec, line in whole.items()]),
        lambda b: b["line"].isNotNull(),
    )
    lines = papers.select("paper_id", F.inline(blocks)).select(
        "paper_id", "sec", F.lit("").alias("k"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "line"
    )

    indent = F.when(F.coalesce("level", F.lit(1)) > 1, "  ").otherwise("")
    described = F.when(F.length("summary") > 0, F.concat(F.lit("："), F.col("summary")))
    section = F.when(F.length("title") > 0, F.concat(indent, F.lit("- "), F.col("title"), text_or_empty(described)))
    lines = lines.unionByName(
        section_lines(kb.sections, ["paper_id"], 5, section, F.lit(""), F.lit(0), F.col("section_no"))
    )

    named = kb.entities.filter(F.length("name") > 0).join(owners, "paper_id")
    entities = with_links(named, "name", "_to", entity_links)
    kind = or_default(F.col("type"), or_default(optional("entity_type", entities), ENTITY_TYPE))
    meaning = or_default(F.col("definition"), optional("description", entities))
    entity = F.concat(
        F.lit("- [["), F.col("_to"), F.lit("]] ("), kind, F.lit(")"),
        text_or_empty(F.when(F.length(meaning) > 0, F.concat(F.lit("："), meaning))),
    )
    lines = lines.unionByName(_by_pos(entities, 6, entity))

    relations = _linked_relations(kb.relations.join(owners, "paper_id"), entity_links)
    lines = lines.unionByName(_by_pos(relations, 7, _relation_line(with_confidence=True)))

    headline = or_default(optional("title", kb.findings), or_default(F.col("statement"), optional("description", kb.findings)))
    evidence = F.when(F.length("evidence") > 0, F.concat(F.lit("\n  - 证据："), F.col("evidence")))
    finding = F.when(F.length(headline) > 0, F.concat(F.lit("- "), headline, text_or_empty(evidence)))
    lines = lines.unionByName(_by_pos(kb.findings, 8, finding))

    method = F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("### "), F.coalesce("name", F.lit("Method"))),
            F.when(F.length("description") > 0, F.col("description")),
            F.when(F.size(optional("inputs", kb.methods, "array<string>")) > 0, F.concat(F.lit("- 输入："), _joined(optional("inputs", kb.methods, "array<string>")))),
            F.when(F.size(optional("outputs", kb.methods, "array<string>")) > 0, F.concat(F.lit("- 输出："), _joined(optional("outputs", kb.methods, "array<string>")))),
        ),
        F.lit("\n"),
    )
    lines = lines.unionByName(_by_pos(kb.methods, 9, method))

    dataset = F.concat(
        F.lit("- "), or_default(F.col("name"), "Dataset"),
        text_or_empty(F.when(F.length("description") > 0, F.concat(F.lit("："), F.col("description")))),
        text_or_empty(F.when(F.length("usage") > 0, F.concat(F.lit("\n  - 用途："), F.col("usage")))),
    )
    lines = lines.unionByName(_by_pos(kb.datasets, 10, dataset))

    card = F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("### 卡片 "), F.col("n").cast("string")),
            _line("问", F.col("front")),
            _line("答", F.col("back")),
            _line("标签", _joined(F.col("tags"))),
            _line("难度", F.col("difficulty"), "/5"),
            _line("下次复习", F.col("next_review")),
        ),
        F.lit("\n"),
    )
    columns = ["paper_id", "front", "back", "tags", "difficulty", "next_review"]
    rows = kb.cards.select(
        *columns, F.coalesce(optional("chunk_no", kb.cards, "int"), F.lit(0)).alias("_a"), F.col("pos").cast("bigint").alias("_b"), F.lit("").alias("_c")
    )
    if live_cards is not None:
        own = live_cards.join(owners, ["paper_id", "user_id"], "left_semi")
        live = own.select(*columns, F.lit(0).alias("_a"), F.lit(0).cast("bigint").alias("_b"), F.col("card_id").alias("_c"))
        rows = rows.join(own.select("paper_id"), "paper_id", "left_anti").unionByName(live)
    shown = _numbered(rows)
    shown = shown.withColumn("next_review", _iso(shown, "next_review"))
    lines = lines.unionByName(section_lines(shown, ["paper_id"], 11, card, F.lit(""), F.lit(0), F.col("n")))

    if live_annotations is not None:
        own = live_annotations.join(owners, ["paper_id", "user_id"], "left_semi")
        stamp = _iso(own, "created_at")
        note = F.when(
            F.length("content") > 0,
            F.concat(
                F.lit("- "), or_default(F.col("type"), "note"),
                text_or_empty(F.when(stamp != "", F.concat(F.lit("（"), stamp, F.lit("）")))),
                F.lit("："), F.col("content"),
            ),
        )
        lines = lines.unionByName(
            section_lines(own, ["paper_id"], 12, note, F.concat_ws("/", stamp, F.col("annotation_id").cast("string")), F.lit(0), F.lit(0))
        )
    # Methods and cards end with a blank line of their own.
    closing = {sec: "" for sec in HEADINGS if sec not in (9, 11)}
    return note_parts(lines, ["paper_id"], HEADINGS, closing, whole)


def _struct_body(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def _iso(df: DataFrame, name: str) -> Column:
    """Timestamps in ISO form without an empty fraction; text stays as it is."""
    if dict(df.dtypes)[name] == "string":
        return F.col(name)
    return F.regexp_replace(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000\z", "")


def _numbered(cards: DataFrame) -> DataFrame:
    """Number the cards of each paper from 1 as ``n``, in the order (_a, _b, _c).

    Runs of cards are counted, the runs' places follow from their sizes, and only the cards of a run are ordered
    together: a paper with very many cards is not sorted by one task.
    """
    run = ["paper_id", "_a", "_run"]
    placed = cards.withColumn("_run", F.when(F.col("_c") == "", F.floor(F.col("_b") / 1024).cast("string")).otherwise(F.substring("_c", 1, 6)))
    order = [F.col("_a"), F.when(F.col("_own"), F.col("_least")), F.col("_run")]
    sizes = placed.groupBy(*run, (F.col("_c") == "").alias("_own")).agg(F.count("*").alias("_size"), F.min("_b").alias("_least"))
    before = W.partitionBy("paper_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*run, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*run).orderBy("_b", "_c"))
    return placed.withColumn("_n", inside).join(offsets, run).withColumn("n", F.col("_before") + F.col("_n")).drop("_run", "_n", "_before")


def _finished(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Whole notes that end with exactly one newline."""
    return whole_notes(parts, keys).withColumn("content", F.concat(F.regexp_replace("content", rf"{WS}+\z", ""), F.lit("\n")))


def linked_paper_notes(kb: KnowledgeBase, paper_links: DataFrame, entity_links: DataFrame, **options) -> DataFrame:
    """``(paper_id, content)``."""
    return _finished(linked_paper_note_parts(kb, paper_links, entity_links, **options, whole=True), ["paper_id"])


def linked_entity_note_parts(
    entities: DataFrame, links: DataFrame, relations: DataFrame, entity_links: DataFrame, key_prefix: str = KEY_PREFIX,
    whole: bool = False,
) -> DataFrame:
    """Parts of the linked entity notes, per user and link key.

    ``entities``: ``note_entities``; attributes come from the first paper. ``links``: ``entity_paper_links``.
    ``relations``: (user_id, source, target, …) of all papers of the user.
    """
    keys = ["user_id", "entity_key"]
    order = [c for c in ("created_at", "paper_id") if c in entities.columns]
    first = entities.groupBy(*keys).agg(
        F.min_by(F.struct("name", "type", "definition"), F.struct(*order)).alias("e")
    ).select(*keys, "e.*")
    header = F.concat_ws(
        "\n",
        F.lit("---"),
        F.lit(f'{key_prefix}_type: "entity"'),
        F.concat(F.lit(f"{key_prefix}_entity_key: "), yaml_quote(F.col("entity_key"))),
        F.concat(F.lit("name: "), yaml_quote(F.col("name"))),
        F.concat(F.lit("type: "), yaml_quote(or_default(F.col("type"), ENTITY_TYPE))),
        F.lit("---\n"),
        F.concat(F.lit("# "), F.col("name"), F.lit("\n")),
        F.when(F.length("definition") > 0, F.concat(F.col("definition"), F.lit("\n"))),
    )
    # One link per distinct note name, at its first paper.
    targets = links.groupBy(*keys, "target").agg(F.min("paper_id").alias("paper_id"))
    # Both ends get their links before a relation is listed at each of them.
    linked = incident_relations(_linked_relations(relations, entity_links)).join(first.select(*keys), keys, "left_semi")
    lines = (
        section_lines(first, keys, 0, header, F.lit(""), F.lit(0), F.lit(0))
        .unionByName(
            section_lines(
                targets.join(first.select(*keys), keys, "left_semi"), keys, 1,
                F.concat(F.lit("- [["), F.col("target"), F.lit("]]")), F.col("paper_id"), F.lit(0), F.lit(0),
            )
        )
        .unionByName(
            section_lines(
                linked, keys, 2, _relation_line(with_confidence=False),
                F.col("paper_id"), F.col("chunk_no"), F.col("pos"),
            )
        )
    )
    return note_parts(lines, keys, {1: APPEARS_IN, 2: RELATED}, {1: "", 2: ""}, whole)


def linked_entity_notes(
    entities: DataFrame, links: DataFrame, relations: DataFrame, entity_links: DataFrame, key_prefix: str = KEY_PREFIX
) -> DataFrame:
    """``(user_id, entity_key, content)``."""
    parts = linked_entity_note_parts(entities, links, relations, entity_links, key_prefix, whole=True)
    return _finished(parts, ["user_id", "entity_key"])
