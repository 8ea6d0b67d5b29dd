import pytest
from pyspark.sql import functions as F

from paperlake.operators import text as T
from paperlake.plans import extraction as X
from paperlake.plans.bindings import Tables, now


def model(broken=()):
    """A deterministic stand-in: entities are the capitalised words of its chunk."""

    class Model:
        def complete(self, system, content, temperature, max_tokens, json_mode):
            import json
            import re

            if any(word in system for word in broken):
                raise RuntimeError("down")
            if '"sections"' in system:
                return json.dumps({"sections": [{"title": "Alpha", "level": 1}, {"title": "Beta", "level": 1}]})
            if '"entities"' in system:
                names = re.findall(r"[A-Z][a-z]+", content)
                pairs = [{"source": a, "target": b, "type": "next"} for a, b in zip(names, names[1:])]
                return "```json\n" + json.dumps({"entities": [{"name": n, "importance": 0.5} for n in names], "relationships": pairs}) + "\n```"
            if '"findings"' in system:
                return json.dumps({"findings": [{"type": "main", "statement": content[:10]}], "methods": [{"name": "m"}], "datasets": []})
            if '"flashcards"' in system:
                return json.dumps({"flashcards": [{"front": "q", "back": str(len(json.loads(content)["entities"]))}]})
            if '"highlights"' in system:
                first = json.loads(content.split("\n\n", 1)[1])[0]["sentence_id"]
                return json.dumps({"highlights": [{"sentence_id": first, "category": "key_data"}]})
            return json.dumps({"title": content[:5], "one_liner": "short", "year": 2020})

    return Model


def inputs(spark):
    body = "Preamble Word " * 10 + "\nAlpha " + "text Gamma " * 20 + "\nBeta " + "more Delta " * 20
    pages = spark.createDataFrame([("p1", 0, body), ("p2", 0, "tiny Text"), ("p2", 1, " \n")], "paper_id string, page_no int, text string")
    papers = spark.createDataFrame([("p1", 1), ("p2", 1), ("p9", 1)], "paper_id string, user_id long").withColumn("created_at", now())
    return T.assemble_text(pages), papers


def test_three_waves(spark):
    texts, papers = inputs(spark)
    kb, failed = X.extract(texts, papers, model(), now(), concurrency=2)
    names = {(r.paper_id, r.entity_key) for r in kb.entities.collect()}
    assert {("p1", n) for n in ("preamble", "word", "alpha", "gamma", "beta", "delta")} | {("p2", "text")} == names
    assert kb.relations.filter("paper_id = 'p1'").count() > 3 and failed.isEmpty()
    backs = {}
    for r in kb.cards.collect():  # a request for each chunk that gave entities
        backs[r.paper_id] = backs.get(r.paper_id, 0) + int(r.back)
    assert backs == {"p1": 6, "p2": 1}
    index = {r.paper_id: r for r in kb.papers.collect()}
    assert index["p1"].extraction_status == "completed" and index["p1"].failed_calls == 0 and "p9" not in index
    assert kb.sections.count() == 4 and kb.findings.count() == 2 and kb.methods.count() == 2
    assert {r.paper_id: r.title for r in kb.papers.collect()} == {"p1": "Pream", "p2": "tiny "}


def test_failed_calls_leave_empty_parts(spark, monkeypatch):
    texts, papers = inputs(spark)
    monkeypatch.setattr("paperlake.operators.inference.BASE_DELAY", 0.0)
    kb, failed = X.extract(texts, papers, model(broken=('"findings"',)), now())
    assert kb.findings.isEmpty() and kb.papers.count() == 2
    assert {(r.paper_id, r.task) for r in failed.collect()} == {("p1", "findings"), ("p2", "findings")}


def test_highlights_and_summaries(spark, sf):
    documents = Tables(spark, sf).documents()
    applied, stats = X.highlight(documents, model())
    assert applied.filter("not matched").isEmpty() and stats.count() == documents.count()
    with_sentences = T.sentences(documents).select("doc_id").distinct().count()
    assert stats.filter("status = 'success'").count() == with_sentences
    texts, _ = inputs(spark)
    assert {r.summary.one_liner for r in X.summarise(texts, model()).collect()} == {"short"}


def test_a_failed_summary_is_that_papers_alone(spark, monkeypatch):
    texts, _ = inputs(spark)
    monkeypatch.setattr("paperlake.operators.inference.BASE_DELAY", 0.0)
    rows = X.summarise(texts, model(broken=("Summarise",))).collect()
    assert {r.paper_id for r in rows} == {"p1", "p2"} and all(r.summary is None and r.summary_error == "down" for r in rows)


def test_lines_are_unwrapped_before_sentences(spark):
    page = "我们提出了一种新的方法，\n在多个数据集上取得了更高的准确率。\n这个结果说明模型可以稳定泛化。"
    applied, stats = X.highlight(spark.createDataFrame([("d", page)], "doc_id string, text string"), model())
    assert [r.text for r in applied.collect()] == ["我们提出了一种新的方法，在多个数据集上取得了更高的准确率。"]
    assert stats.first().status == "success"


def test_long_texts_are_read_whole(spark):
    texts, papers = inputs(spark)
    kb, _ = X.extract(texts, papers, model(), now(), slice_chars=100)
    length = texts.filter("paper_id = 'p1'").first().text
    assert kb.findings.filter("paper_id = 'p1'").count() == -(-len(length) // 100)
    ids = [r.id for r in kb.findings.collect()]
    assert len(ids) == len(set(ids)) and len({(r.paper_id, r.id) for r in kb.sections.collect()}) == kb.sections.count()


def test_simplify_has_no_slice_of_an_empty_text(spark, tmp_path):
    from paperlake.plans.catalog import QUERIES

    rows = [(1, "Abc Def"), (2, ""), (3, None), (4, "Xy " * 1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["x4_simplify"](Tables(spark, str(tmp_path))).collect()
    text = "xy " * 1000
    assert sorted((r.paper_id, r.chunk_no, r.body) for r in found) == [("1", 0, "abc def"), ("4", 0, text[:2000]), ("4", 1, text[2000:])]
