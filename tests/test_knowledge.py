from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperlake.operators import export as E
from paperlake.operators import highlights as H
from paperlake.operators import knowledge as K
from paperlake.operators import lifecycle as M
from paperlake.operators import notes as N
from paperlake.plans.bindings import now
from paperlake.schemas import DOCUMENT
from paperlake.sources import documents as D
from paperlake.sources import files as S
from paperlake.sources.note_files import write_note_files

MENTION = (
    "paper_id string, chunk_no int, pos int, name string, type string, aliases array<string>, definition string, "
    "importance double"
)
RELATION = (
    "paper_id string, chunk_no int, pos int, source string, target string, type string, description string, "
    "confidence double"
)


def test_dedup_keeps_first_of_the_most_important(spark):
    rows = [
        ("p", 0, 0, "BERT", "a", None, None, None), ("p", 0, 1, "bert ", "b", None, None, 0.5),
        ("p", 1, 0, "Bert", "c", None, None, 0.5), ("p", 1, 1, "  ", "d", None, None, 0.9),
        ("p", 1, 2, "GPT", None, None, None, None), ("q", 0, 0, "bert", "e", None, None, 0.1),
    ]
    got = {(r.paper_id, r.entity_key): r for r in K.entity_index(K.dedup_entities(spark.createDataFrame(rows, MENTION))).collect()}
    assert set(got) == {("p", "bert"), ("p", "gpt"), ("q", "bert")}
    bert = got["p", "bert"]
    assert (bert.name, bert.type, bert.first_chunk, bert.first_pos) == ("bert ", "b", 0, 0)
    gpt = got["p", "gpt"]
    assert (gpt.type, gpt.importance, gpt.aliases) == ("concept", 0.5, []) and gpt.id.startswith("ent_")


def test_relations_need_both_ends_by_exact_lower_name(spark):
    mentions = [("p", 0, i, n, "t", None, None, 0.5) for i, n in enumerate(["BERT", "GPT", " padded"])]
    entities = K.entity_index(K.dedup_entities(spark.createDataFrame(mentions, MENTION)))
    rows = [
        ("p", 0, 0, "bert", "gpt", None, None, None), ("p", 0, 1, "bert", "unknown", "x", None, 0.1),
        ("p", 0, 2, "bert", "padded", "x", None, 0.1), ("p", 0, 3, "Bert", "BERT", "x", "self", 0.1),
        ("p", 0, 4, "bert", " Padded", "x", None, 0.1), ("q", 0, 0, "bert", "gpt", "x", None, 0.1),
    ]
    got = sorted((r.pos, r.type, r.confidence) for r in K.resolve_relations(spark.createDataFrame(rows, RELATION), entities).collect())
    assert got == [(0, "uses", 0.5), (3, "x", 0.1), (4, "x", 0.1)]


def test_selections_stats_and_status(spark):
    sentences = spark.createDataFrame([("d", "p1_s1", 0, "text")], "doc_id string, sentence_id string, page_index int, text string")
    selected = spark.createDataFrame(
        [("d", 0, 0, "p1_s1", "core_conclusion"), ("d", 0, 1, "p1_s1", "key_data"), ("d", 0, 2, "missing", "key_data"), ("d", 1, 0, "missing", "key_data")],
        "doc_id string, chunk_no int, pos int, sentence_id string, category string",
    )
    applied = H.apply_selections(sentences, selected)
    stats = H.highlight_status(H.highlight_stats(applied)).first()
    assert (stats.core_conclusions, stats.key_data, stats.total, stats.failed_matches, stats.status) == (1, 0, 1, 1, "partial")
    assert [r.sentence_id for r in H.filter_highlights(applied).collect()] == ["p1_s1"]


def document(paper, title, entities, **more):
    return {"id": paper, "metadata": {"title": title}, "entities": entities, **more}


@pytest.fixture(scope="module")
def docs(spark):
    import json

    first = document(
        "p1", "Transformer/BERT",
        [
            {"id": "e1", "name": "BERT", "type": "model", "definition": "encoder"},
            {"id": "e2", "name": " ", "type": "model"},
            {"id": "e3", "name": "ＢＥＲＴ", "entity_type": "other", "description": "later"},
            {"id": "e4", "name": "GLUE", "entity_type": "dataset", "description": "benchmark"},
        ],
        relationships=[{"id": "r1", "source": "bert", "target": "GLUE", "type": "evaluated_on", "description": "d", "confidence": 0.9}],
        findings=[{"title": "Better", "evidence": "Table 1"}],
        methods=[{"name": "M", "description": "does", "inputs": ["a", " "], "outputs": []}],
        datasets=[{"name": "GLUE", "description": "tasks", "usage": "test"}],
        flashcards=[{"id": "f1", "front": "Q?", "back": "A", "tags": ["x"], "difficulty": 2}],
        structure={"sections": [{"id": "sec_1", "title": "Intro", "level": 1, "summary": "s"}, {"id": "sec_2", "title": "Sub", "level": 2}]},
        extraction_model="m", extracted_at="2024-01-01",
    )
    first["metadata"] |= {"authors": [{"name": "Ada B", "affiliation": "U"}, {"name": "Cher"}], "year": 2024, "doi": "10.1/x_y", "keywords": ["k"], "abstract": "Abs"}
    second = document("p2", "Transformer_BERT", [{"id": "e5", "name": "bert", "type": "model"}])
    rows = [("p1", 1, "t1", datetime(2024, 1, 1), json.dumps(first)), ("p2", 1, "t2", datetime(2024, 1, 2), json.dumps(second)), ("p3", 1, "t3", datetime(2024, 1, 3), "[broken")]
    return spark.createDataFrame(rows, "paper_id string, user_id long, task_id string, created_at timestamp_ntz, knowledge_json string")


def test_documents_to_tables(docs):
    parsed = D.parse_knowledge(docs)
    assert {r.paper_id for r in parsed.filter("knowledge is null").collect()} == {"p3"}
    kb = D.to_tables(parsed)
    assert kb.papers.count() == 2 and kb.entities.count() == 5 and kb.sections.count() == 2
    entity = {r.paper_id + r.entity_key: r for r in K.note_entities(kb.papers, kb.entities, kb.entities.limit(0)).collect()}
    assert set(entity) == {"p1bert", "p1glue", "p2bert"}
    assert (entity["p1glue"].type, entity["p1glue"].definition, entity["p1bert"].definition) == ("dataset", "benchmark", "encoder")


def test_any_part_length_holds_the_same_items(docs, spark, monkeypatch):
    kb = D.to_tables(D.parse_knowledge(docs))
    kb = replace(kb, entities=kb.entities.withColumn("first_chunk", F.col("first_pos") * 3))
    whole = D.assemble_documents(kb, now(), "m").collect()
    assert sorted((r.paper_id, r.part_no) for r in whole) == [("p1", 0), ("p2", 0)]
    monkeypatch.setattr(D, "CHUNKS_IN_PART", 3)
    parts = D.parse_knowledge(D.assemble_documents(kb, now(), "m"))
    assert parts.filter("paper_id = 'p1'").count() > 1
    back = D.to_tables(parts)
    for name in ("papers", "entities", "relations", "findings", "methods", "datasets", "cards", "sections"):
        assert getattr(back, name).count() == getattr(kb, name).count(), name


def linked(kb, spark, **options):
    papers = kb.papers.select("paper_id", N.sanitize_name(N.note_title(kb.papers)).alias("target"))
    entities = K.note_entities(kb.papers, kb.entities, kb.entities.limit(0))
    links = entities.groupBy("user_id", "entity_key").agg(N.sanitize_name(F.min("name")).alias("target"))
    return papers, entities, links, N.linked_paper_notes(kb, papers, links, **options)


def test_linked_notes(docs, spark):
    kb = D.to_tables(D.parse_knowledge(docs))
    live = spark.createDataFrame(
        [("c1", "p2", 1, "front", "back", ["x"], 3, datetime(2024, 1, 5))],
        "card_id string, paper_id string, user_id long, front string, back string, tags array<string>, difficulty int, next_review timestamp_ntz",
    )
    annotations = spark.createDataFrame(
        [("a2", "p1", 1, "note", "later", datetime(2024, 1, 3)), ("a1", "p1", 1, "todo", "first", datetime(2024, 1, 2)), ("a3", "p1", 2, "note", "foreign", datetime(2024, 1, 2))],
        "annotation_id string, paper_id string, user_id long, type string, content string, created_at timestamp_ntz",
    )
    papers, entities, links, notes = linked(kb, spark, live_cards=live, live_annotations=annotations)
    text = {r.paper_id: r.content for r in notes.collect()}
    assert text["p1"] == "\n".join(
        [
            "---", 'paperlake_id: "p1"', 'paperlake_type: "paper"', 'title: "Transformer/BERT"', "---", "", "# Transformer/BERT", "",
            "个人笔记：[[Transformer_BERT - Notes]]", "", "## 论文信息", "- 作者：Ada B (U), Cher", "- 年份：2024", "- DOI：10.1/x_y",
            "- 关键词：k", "", "## 摘要", "Abs", "", "## 章节结构", "- Intro：s", "  - Sub", "", "## 实体",
            "- [[BERT]] (model)：encoder", "- [[Untitled]] (model)", "- [[BERT]] (other)：later", "- [[GLUE]] (dataset)：benchmark", "", "## 关系",
            "- [[BERT]] **evaluated_on** [[GLUE]]：d（置信度：0.9）", "", "## 发现", "- Better", "  - 证据：Table 1", "", "## 方法", "### M", "does",
            "- 输入：a", "", "## 数据集", "- GLUE：tasks", "  - 用途：test", "", "## 闪卡", "### 卡片 1", "- 问：Q?", "- 答：A", "- 标签：x",
            "- 难度：2/5", "", "## 用户笔记", "- todo（2024-01-02T00:00:00）：first", "- note（2024-01-03T00:00:00）：later", "", "## 同步信息",
            "- 提取模型：m", "- 提取时间：2024-01-01", "",
        ]
    ).replace("- [[BERT]] (model)", "- [[" + links.filter("entity_key = 'bert'").first().target + "]] (model)").replace(
        "- [[BERT]] (other)", "- [[" + links.filter("entity_key = 'bert'").first().target + "]] (other)"
    )
    assert "- 下次复习：2024-01-05T00:00:00" in text["p2"] and "### 卡片 1" in text["p2"]
    mapping = spark.createDataFrame(
        [(1, "p2", "paper", "p2", "Papers/Moved name.md"), (1, "p9", "entity", "bert", "Entities/BERT.md")],
        "user_id long, paper_id string, item_type string, normalized_key string, relative_path string",
    )
    paper_links = K.entity_paper_links(mapping, kb.entities, kb.papers)
    got = {(r.entity_key, r.paper_id): r.target for r in paper_links.collect()}
    assert got["bert", "p2"] == "Moved name" and got["bert", "p1"] == "Transformer_BERT" and ("bert", "p9") not in got
    relations = K.with_paper(kb.relations, kb.papers, "user_id")
    entity_notes = N.linked_entity_notes(K.with_paper(entities, kb.papers, "created_at"), paper_links, relations, links)
    bert = entity_notes.filter("entity_key = 'bert'").first().content
    assert bert.startswith('---\npaperlake_type: "entity"\npaperlake_entity_key: "bert"\nname: "BERT"\ntype: "model"\n---\n\n# BERT\n\nencoder\n\n## 出现在哪些论文\n- [[Transformer_BERT]]\n- [[Moved name]]\n\n## 相关关系\n- [[')
    assert bert.endswith("]]：d\n")


def test_summary_overview(docs, spark):
    import json

    from paperlake.schemas import SUMMARY

    summary = {
        "one_liner": "Short", "estimated_minutes": 12, "novelty_score": 4, "story": {"problem": "P", "impact": "I"},
        "key_numbers": [{"value": "28.4", "label": "BLEU", "context": "WMT"}, {"value": "3", "label": ""}],
        "pipeline": {"input": "text", "steps": ["encode", "decode"], "output": "labels"}, "contributions": ["one", ""],
        "limitations": ["slow"], "keywords": [{"text": "attention", "type": "method", "importance": 0.9}, {"text": "plain", "type": ""}],
    }
    rows = spark.createDataFrame([("t2", json.dumps(summary))], "task_id string, j string")
    kb = D.to_tables(D.parse_knowledge(docs))
    summaries = rows.select("task_id", F.from_json("j", SUMMARY).alias("summary_page"))
    text = {r.paper_id: r.content for r in linked(kb, spark, summaries=summaries)[3].collect()}
    want = [
        "## AI 速览", "- 一句话：Short", "- 预计阅读：12 分钟", "- 新颖度：4/5", "", "### 问题", "P", "", "### 影响", "I", "", "### 关键数据",
        "- **28.4** BLEU：WMT", "- **3**", "", "### 技术流程", "text -> encode -> decode -> labels", "", "### 主要贡献", "- one", "",
        "### 局限性", "- slow", "", "### 关键概念", "- attention (method)", "- plain", "", "## 实体",
    ]
    assert "\n".join(want) in text["p2"] and "AI 速览" not in text["p1"]


def test_links_of_the_current_run_win(docs, spark):
    kb = D.to_tables(D.parse_knowledge(docs))
    mapping = spark.createDataFrame(
        [(1, "p2", "paper", "p2", "Papers/Old.md")], "user_id long, paper_id string, item_type string, normalized_key string, relative_path string"
    )
    current = spark.createDataFrame([("p2", "New title", "New")], "paper_id string, title string, target string")
    links = K.entity_paper_links(mapping, kb.entities, kb.papers, current).filter("entity_key = 'bert' and paper_id = 'p2'")
    assert [(r.title, r.target) for r in links.collect()] == [("New title", "New")]


def test_any_part_length_gives_the_same_notes(docs, spark, monkeypatch):
    kb = D.to_tables(D.parse_knowledge(docs))
    whole = {r.paper_id: r.content for r in E.paper_notes(kb).collect()}
    parts = E.paper_note_parts(kb).count()
    monkeypatch.setattr(E, "CHUNKS_IN_PART", 1)
    spread = kb.entities.withColumns({"first_chunk": F.col("first_pos"), "chunk_no": F.col("first_pos")})
    assert {r.paper_id: r.content for r in E.paper_notes(replace(kb, entities=spread)).collect()} == whole
    assert E.paper_note_parts(replace(kb, entities=spread)).count() > parts
    assert 'title: "Transformer/BERT"' in whole["p1"] and "- **DOI**: [10.1/x_y](https://doi.org/10.1/x_y)" in whole["p1"]


def test_note_paths_never_meet(spark):
    names = spark.createDataFrame([(1, "a", "X"), (1, "b", "x"), (2, "c", "X"), (1, "d", "Y")], "user_id long, paper_id string, name string")
    paths = {r.paper_id: r.relative_path for r in E.note_paths(names, "papers", F.col("paper_id")).collect()}
    assert paths["a"] == "1/papers/X.md" and paths["c"] == "2/papers/X.md" and paths["d"] == "1/papers/Y.md"
    assert paths["b"].startswith("1/papers/x-") and len({p.lower() for p in paths.values()}) == 4


def test_cards_are_numbered_in_order(spark):
    rows = [("p", 0, b, "") for b in range(0, 5000, 7)] + [("q", 0, 0, f"card_{i}") for i in range(300)] + [("p", 1, 3, "")]
    df = spark.createDataFrame(rows, "paper_id string, _a int, _b long, _c string")
    got = sorted((r.paper_id, r.n, r._a, r._b, r._c) for r in N._numbered(df).collect())
    for paper in "pq":
        want = sorted((a, b, c) for p, a, b, c in rows if p == paper)
        assert [x[1:] for x in got if x[0] == paper] == [(i + 1, *w) for i, w in enumerate(want)]


def test_colliding_names(spark):
    rows = [(f"p{i}", "Transformer_BERT") for i in range(6)] + [("q", "Other"), ("moved", "Gone"), ("mapped", "Name")]
    items = spark.createDataFrame(rows, "item_id string, desired_name string").select(
        F.lit("/v").alias("vault_path"), F.lit("paper").alias("item_type"), "item_id", F.col("item_id").alias("normalized_key"),
        F.lit("same").alias("source_name"), F.lit("Papers").alias("folder"), "desired_name", F.concat(F.lit("m"), "item_id").alias("mapping_id"),
    )
    mapping = spark.createDataFrame([("mmapped", "Root/Papers/Kept.md"), ("mmoved", "Root/Papers/Gone.md"), ("mq", "../out.md")], "mapping_id string, relative_path string")
    inventory = spark.createDataFrame(
        [("/v", "Root/Papers/Kept.md", "paper", "x"), ("/v", "Elsewhere/New.md", "paper", "moved"), ("/v", "Root/Papers/Transformer_BERT.md", None, None), ("/v", "../out.md", None, None)],
        "vault_path string, relative_path string, note_type string, note_id string",
    )
    got = {r.item_id: r.relative_path for r in M.resolve_paths(items, mapping, inventory, root="Root").collect()}
    assert got["mapped"] == "Root/Papers/Kept.md" and got["moved"] == "Elsewhere/New.md" and got["q"] == "Root/Papers/Other.md"
    named = [got[f"p{i}"] for i in range(6)]
    assert len(set(named)) == 6 and all(n.startswith("Root/Papers/Transformer_BERT-") for n in named)
    assert len(set(got.values())) == len(rows)


def test_claims_orphans_expiry_and_deletion(spark):
    tasks = spark.createDataFrame([(t, 1, "completed") for t in ("new", "run", "done", "bad")] + [("open", 1, "parsing")], "task_id string, user_id long, status string")
    papers = spark.createDataFrame(
        [("p1", "run", "extracting", None), ("p2", "done", "completed", None), ("p3", "bad", "error", "boom")],
        "paper_id string, task_id string, extraction_status string, extraction_error string",
    ).withColumns({"user_id": F.lit(1).cast("long"), "extraction_model": F.lit("old"), "updated_at": now()})
    plan = M.plan_extraction(tasks, papers)
    assert {r.task_id: r.action for r in plan.collect()} == {"new": "start_new", "run": "skip_running", "done": "skip_completed", "bad": "restart"}
    after = {r.task_id: r for r in M.claim_papers(papers, plan, "m", now()).collect()}
    assert after["bad"].extraction_status == "extracting" and after["bad"].extraction_error is None and after["bad"].paper_id == "p3"
    assert after["new"].extraction_status == "extracting" and after["done"].extraction_model == "old" and len(after) == 4
    states = tasks.withColumns({"error": F.lit(None).cast("string"), "message": F.lit(""), "created_at": now("2024-01-01 00:00:00")})
    fixed = {r.task_id: r for r in M.reconcile_orphans(states).collect()}
    assert fixed["open"].status == "error" and fixed["open"].error and fixed["done"].status == "completed"
    assert {r.task_id for r in M.expired(states, now("2024-01-01 00:31:00"), 30).collect()} == {"new", "run", "done", "bad"}
    assert M.expired(states, now("2024-01-01 00:30:00"), 30).isEmpty()
    assert M.expired(states, now("2024-01-02 00:00:00"), 30, states=None).count() == 5
    left = M.delete_papers({"papers": papers}, papers.filter("paper_id = 'p1'"))["papers"]
    assert {r.paper_id for r in left.collect()} == {"p2", "p3"}


def test_notes_are_written_only_when_changed(spark, tmp_path):
    key = ["mapping_id", "user_id", "paper_id", "item_type", "item_id", "normalized_key", "source_name", "vault_path", "relative_path", "content_hash"]
    ddl = ", ".join(f"{k} {'long' if k == 'user_id' else 'string'}" for k in key)
    row = lambda i, h: (i, 1, i, "paper", i, i, i, "/v", f"P/{i}.md", h)
    notes = spark.createDataFrame([row("same", "h"), row("gone", "h"), row("changed", "h2"), row("new", "h")], ddl)
    old = spark.createDataFrame([row("same", "h"), row("gone", "h"), row("changed", "h"), row("other", "h")], ddl).withColumn("updated_at", now("2020-01-01 00:00:00"))
    files = spark.createDataFrame([("/v", "P/same.md"), ("/v", "P/changed.md"), ("/v", "P/other.md")], "vault_path string, relative_path string")
    planned = M.plan_notes(notes, old, files, now())
    assert {r.mapping_id: r.state for r in planned.collect()} == {"same": "skipped", "gone": "written", "changed": "written", "new": "written", "other": None}
    assert tuple(M.note_counts(planned).first()) == (3, 1)

    out = spark.createDataFrame(
        [("Papers/a b.md", '---\nlake_type: "paper"\nlake_id: "a \\"q\\""\n---\n\n# A\n'), (".hidden/x.md", "---\na: b\n---\n"), ("Papers/none.md", "text")],
        "relative_path string, content string",
    )
    write_note_files(out, str(tmp_path / "vault"))
    found = {r.relative_path: r.front_matter for r in S.read_notes(spark, str(tmp_path / "vault")).collect()}
    assert found == {"Papers/a b.md": {"lake_type": "paper", "lake_id": 'a "q"'}, "Papers/none.md": {}}
    kept = S.note_inventory(S.read_notes(spark, str(tmp_path / "vault")), "/v", "lake").filter("note_id is not null").first()
    assert (kept.note_type, kept.note_id) == ("paper", 'a "q"')


def test_citations_and_sinks(docs, spark, tmp_path):
    kb = D.to_tables(D.parse_knowledge(docs))
    entry = {r.paper_id: r.entry for r in E.to_bibtex(kb.papers).collect()}["p1"]
    assert entry.startswith("@article{p1,\n  title = {Transformer/BERT},\n  author = {Ada B and Cher},\n  year = {2024},\n  doi = {10.1/x\\_y},\n}\n")
    csl = {r.paper_id: r.csl for r in E.to_csl(kb.papers).collect()}
    assert '"author":[{"family":"B","given":"Ada"},{"family":"","given":"Cher"}]' in csl["p1"] and '"DOI"' not in csl["p2"]
    S.write_export(E.export_entities(kb), "csv", str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "csv"))
    assert back.count() == 5 and back.columns == ["id", "name", "type", "definition", "importance", "paper_title"]
    D.export_all(D.assemble_documents(kb, now(), "m"), K.global_entities(kb.entities, kb.papers), "2024-01-01", str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all/manifest")).first().schema_version == "1.0.0"
    assert spark.read.schema(DOCUMENT).json(str(tmp_path / "all/papers")).count() == 2
