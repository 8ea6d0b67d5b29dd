"""Answers kept by request, and jobs that are run again."""

import pytest
from pyspark.sql import functions as F

from paperlake.operators import inference as L
from paperlake.plans import extraction as X
from paperlake.plans.bindings import now
from paperlake.sources import answers as A
from test_extraction import inputs, model

REQUEST = "paper_id string, task string, chunk_no int, system string, content string"


def counting(calls, broken=()):
    """A model that leaves a file for every call and fails on some contents."""

    class Counting:
        def complete(self, system, content, temperature, max_tokens, json_mode):
            import uuid
            from pathlib import Path

            Path(calls, uuid.uuid4().hex).write_text(content)
            if content in broken:
                raise RuntimeError("down")
            return '{"title": "' + content[:3] + '"}'

    return Counting


def requests_of(spark, rows):
    return spark.createDataFrame([(p, t, 0, "s", c) for p, t, c in rows], REQUEST)


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def seen():
        found = sorted(x.read_text() for x in folder.iterdir())
        for x in folder.iterdir():
            x.unlink()
        return found

    return str(folder), seen


def run(requests, table, client):
    rows = A.answer_requests(requests, client, table, concurrency=2, sleep=lambda s: None).collect()
    return {(r.paper_id, r.task): (r.raw, r.error, r.reused) for r in rows}


def test_only_missing_requests_are_asked(spark, tmp_path, calls):
    folder, seen = calls
    path = str(tmp_path / "answers")
    table = lambda name, model="m": A.AnswerTable(spark, path, model, name)
    first = [("p1", "metadata", "aaa"), ("p2", "metadata", "bbb"), ("p3", "metadata", "aaa"), ("p1", "summary", "aaa")]
    got = run(requests_of(spark, first), table("one"), counting(folder, {"bbb"}))
    # Equal requests are asked once, other tasks for themselves; a call that fails is tried three times.
    assert seen() == ["aaa", "aaa", "bbb", "bbb", "bbb"]
    assert got["p1", "metadata"] == got["p3", "metadata"] == ('{"title": "aaa"}', None, False)
    assert got["p2", "metadata"] == (None, "down", False)
    assert {(r.task, r.requests, r.failed) for r in A.calls_made(table("one")).collect()} == {("metadata", 2, 1), ("summary", 1, 0)}

    again = run(requests_of(spark, [*first, ("p4", "metadata", "ccc")]), table("two"), counting(folder))
    assert seen() == ["bbb", "ccc"]  # what failed, and what is new
    assert again["p1", "metadata"] == ('{"title": "aaa"}', None, True) and again["p2", "metadata"] == ('{"title": "bbb"}', None, False)
    run(requests_of(spark, first), table("three"), counting(folder))
    assert seen() == []
    run(requests_of(spark, first[:1]), table("four", "another model"), counting(folder))
    assert seen() == ["aaa"]


def test_a_failed_job_keeps_the_answers_it_has(spark, tmp_path, calls):
    folder, seen = calls
    rows = [(f"p{k}", "metadata", f"text {k}") for k in range(8)]

    class Dies(counting(folder)):
        def complete(self, system, content, *more):
            if content == "text 7":
                import time

                time.sleep(3)  # the other task is done by then
                raise SystemExit  # not an answer that failed: the worker ends
            return super().complete(system, content, *more)

    table = A.AnswerTable(spark, str(tmp_path / "answers"), "m", "one")
    requests = requests_of(spark, rows)
    with pytest.raises(Exception):
        A.answer_requests(requests, Dies, table, concurrency=8, in_flight=1).collect()
    done = {r.request_key for r in table.rows().collect()}
    assert len(done) >= 1
    seen()
    second = A.AnswerTable(spark, table.path, "m", "two")
    got = run(requests, second, counting(folder))
    assert len(seen()) == 8 - len(done) and all(raw for raw, _, _ in got.values())


def test_keys_tell_requests_apart(spark):
    rows = requests_of(spark, [("p", "a", "bc"), ("p", "ab", "c"), ("q", "a", "bc"), ("p", "a", None)])
    keys = [r.k for r in rows.select(A.request_key("m").alias("k")).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 3
    assert rows.select(A.request_key("n").alias("k")).first().k not in keys


def test_extraction_over_kept_answers(spark, tmp_path):
    texts, papers = inputs(spark)
    kept = lambda name: A.AnswerTable(spark, str(tmp_path / "kept"), "m", name)
    first, _ = X.extract(texts, papers, model(), now(), concurrency=2, kept=kept("one"))
    made = {r.task: r.requests for r in A.calls_made(kept("one")).collect()}
    assert made["metadata"] == made["sections"] == made["findings"] == 2 and made["entities"] >= 2
    second, _ = X.extract(texts, papers, model(), now(), concurrency=2, kept=kept("two"))
    assert A.calls_made(kept("two")).isEmpty()
    key = lambda kb: sorted(map(tuple, kb.entities.select("paper_id", "entity_key", "id").collect()))
    assert key(first) == key(second) and first.cards.count() == second.cards.count()
    changed = texts.withColumns({
        c: F.when(F.col("paper_id") == "p2", v).otherwise(F.col(c))
        for c, v in (("text", F.lit("tiny Word")), ("page_texts", F.array(F.lit("tiny Word"))))
    })
    X.extract(changed, papers, model(), now(), concurrency=2, kept=kept("three"))
    assert {r.task: r.requests for r in A.calls_made(kept("three")).collect()} == {
        "metadata": 1, "sections": 1, "findings": 1, "entities": 1, "flashcards": 1
    }
    summaries = X.summarise(texts, model(), kept=kept("four"))
    assert {r.summary.one_liner for r in summaries.collect()} == {"short"}
    assert L.MAX_TOKENS["highlight"] == 2048
