"""The hidden Markov language model, nearest vectors, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlake.llm import hidden_markov as H
from paperlake.llm.common import fold, maybe_among
from paperlake.llm.hidden_markov import score_papers
from paperlake.llm.near_duplicates import near_duplicates
from paperlake.llm.nearest import Forest, nearest_vectors, planes
from paperlake.llm.queries import QUERIES, ORACLES


def base_scores(rows):
    """What the contract of word counts says, from text."""
    tokens = [[*(text or "").encode().lower().split(), b"\n"] for _, text, _ in rows]
    counts = Counter(w for words, (_, _, learns) in zip(tokens, rows, strict=True) if learns for w in words)
    total, kinds = sum(counts.values()), len(counts)
    for (key, _, learns), words in zip(rows, tokens, strict=True):
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        yield key, not learns, len(words), sum(w in counts for w in words), total, pytest.approx(score)


def columns(r):
    return r.paper_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score


def test_counts_and_odd_papers(spark, odd_papers, no_papers, monkeypatch):
    rows = [(r.paper_id, r.text, bool(r.paper_id and r.paper_id % 2)) for r in odd_papers.collect()]
    frame = spark.createDataFrame(rows, "paper_id long, text string, learns boolean").withColumn("score", F.lit("s"))
    for block in (H.BLOCK, 50):
        monkeypatch.setattr(H, "BLOCK", block)
        got = score_papers(frame, rounds=1).collect()
        key = lambda x: (x[0] is None, x[0], x[2])
        assert sorted(map(columns, got), key=key) == sorted(base_scores(rows), key=key)
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert score_papers(no_papers.withColumn("learns", F.lit(True))).count() == 0
    none = score_papers(frame.withColumn("learns", F.lit(None).cast("boolean")), rounds=1).collect()
    assert all(r.held_out and r.train_tokens == r.n_known == 0 for r in none)


def test_states_explain_held_out_texts(spark):
    draw, rows = random.Random(3), []
    for i in range(300):
        kind = i % 3
        rows.append((i, " ".join(f"{'abc'[kind]}{draw.randint(0, 30)}" for _ in range(60)), i % 5 != 0))
    frame = spark.createDataFrame(rows, "paper_id long, text string, learns boolean")
    held = [r for r in score_papers(frame, states=3, top_words=128, rounds=8).collect() if r.held_out]
    # Three kinds of equal size: knowing the kind is worth log10(3) a word.
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in held])
    assert 0.6 * math.log10(3) < gain < 1.2 * math.log10(3)


def test_the_registered_model_explains_six_kinds_of_held_out_texts(spark):
    draw, rows = random.Random(3), []
    for i in range(600):
        rows.append((i, " ".join(f"{'abcdef'[i % 6]}{draw.randint(0, 30)}" for _ in range(60)), i % 5 != 0))
    frame = spark.createDataFrame(rows, "paper_id long, text string, learns boolean")
    held = [r for r in score_papers(frame).collect() if r.held_out]
    # Knowing the kind is worth log10(6) a word; four states after three rounds reach 0.71 of it.
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in held])
    assert 0.9 * math.log10(6) < gain < 1.2 * math.log10(6)


def test_likelihood_is_the_sum_over_all_paths():
    draw = np.random.default_rng(1)
    states, classes = 3, 5
    model = H.HiddenMarkov(
        np.arange(2), np.ones(2), np.ones(3), np.zeros(3), draw.dirichlet(np.ones(states)), draw.dirichlet(np.ones(states), states),
        draw.dirichlet(np.ones(classes), states), 10, 5,
    )
    rows = [draw.integers(0, classes, n) for n in (1, 4, 2, 5)]
    logs = H.sequence_logs(np.concatenate(rows), np.array([len(r) for r in rows]), model)
    for row, log in zip(rows, logs, strict=True):
        paths = np.array(np.meshgrid(*[range(states)] * len(row), indexing="ij")).reshape(len(row), -1).T
        total = 0.0
        for path in paths:
            chance = model.start[path[0]] * model.emit[path[0], row[0]]
            for t in range(1, len(row)):
                chance *= model.move[path[t - 1], path[t]] * model.emit[path[t], row[t]]
            total += chance
        assert log == pytest.approx(math.log(total))


def test_rounds_of_training_raise_the_likelihood():
    draw = np.random.default_rng(2)
    flat = np.concatenate([draw.integers(0, 3, 40) + 3 * (k % 2) for k in range(50)])
    sizes = np.full(50, 40)
    begins, lengths = H._cuts(sizes)
    assert lengths.sum() == 2000 and Counter(lengths.tolist()) == {40: 50}
    start, move, emit = np.full(2, 0.5), np.array([[0.6, 0.4], [0.4, 0.6]]), draw.dirichlet(np.ones(6), 2)
    last = -np.inf
    for _ in range(6):
        model = H.HiddenMarkov(np.zeros(0, int), np.zeros(0), np.zeros(1), np.zeros(1), start, move, emit, 1, 1)
        now = H.sequence_logs(flat, sizes, model).sum()
        assert now >= last - 1e-6
        last = now
        emissions, moves, starts = H.forward_backward(flat, begins, lengths, start, move, emit)
        assert emissions.sum() == pytest.approx(2000) and starts.sum() == pytest.approx(50) and moves.sum() == pytest.approx(1950)
        start, move, emit = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=1, keepdims=True)


def exact_neighbours(vectors, queries, k=5):
    ids = np.array(sorted(vectors))
    rows = np.array([vectors[i] for i in ids])
    norms = np.sqrt((rows * rows).sum(axis=1))
    for q in queries:
        score = (rows @ np.array(vectors[q])) / (norms * np.linalg.norm(vectors[q]))
        order = [n for n in np.lexsort((ids, -np.round(score, 12))) if ids[n] != q][:k]
        yield q, [(int(ids[n]), score[n]) for n in order]


@pytest.mark.parametrize("shard", [8192, 300])
def test_neighbours_are_near_and_ties_are_in_order(spark, monkeypatch, shard):
    monkeypatch.setattr("paperlake.llm.nearest.SHARD", shard)
    monkeypatch.setattr("paperlake.llm.nearest.QUERIES", 7)
    draw = np.random.default_rng(5)
    vectors = {i: draw.normal(size=16).astype(np.float32).astype(float).tolist() for i in range(1200)}
    for i in range(1000, 1020):
        vectors[i] = vectors[50]  # more copies than neighbours
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [1.0]), (None, [1.0] * 16)]
    schema = "vector_id long, embedding array<float>, score string"
    frame = spark.createDataFrame([(i, v, "s") for i, v in [*vectors.items(), *odd]], schema)
    asked = frame.where("vector_id % 50 = 0").select("vector_id")
    got = {}
    for r in nearest_vectors(frame, asked, least=400).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vector_id, r.score)
    hits = total = 0
    for q, want in exact_neighbours(vectors, [i for i in vectors if i % 50 == 0]):
        ranked = [got[q][n] for n in range(1, 6)]
        assert [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)
        hits += len({i for i, _ in ranked} & {i for i, _ in want})
        total += 5
    assert hits / total >= 0.9 and set(got) == {i for i in vectors if i % 50 == 0}
    assert [got[50][n][0] for n in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    assert nearest_vectors(frame.limit(0), asked).count() == 0
    few = frame.where("vector_id < 3")
    assert nearest_vectors(few, few.select("vector_id")).count() == 6


def test_queries_are_not_copied_for_every_shard(spark, monkeypatch):
    monkeypatch.setattr("paperlake.llm.nearest.SHARD", 100)
    draw = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, draw.normal(size=8).tolist()) for i in range(1000)], "vector_id long, embedding array<float>")
    found = nearest_vectors(frame, frame.where("vector_id % 50 = 0").select("vector_id"))
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    assert "array<double>" not in plan and "as double" not in plan  # floats travel as floats
    found.collect()
    run = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in run and "BroadcastNestedLoopJoin" not in run


def test_neighbours_of_floats_are_those_of_equal_doubles(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(300)] + [(300, [1e-40] * 8), (301, [3e38] * 8), (302, [0.0, -0.0] + [1.0] * 6)]
    floats = spark.createDataFrame(rows, "vector_id long, embedding array<float>")
    doubles = floats.selectExpr("vector_id", "cast(embedding as array<double>) AS embedding")
    asked = floats.where("vector_id % 10 = 0").select("vector_id")
    assert sorted(nearest_vectors(floats, asked).collect()) == sorted(nearest_vectors(doubles, asked).collect())


def test_a_forest_takes_the_longest_prefixes_first():
    draw = np.random.default_rng(8)
    rows = draw.normal(size=(500, 8))
    sides = planes(4, 8)
    forest = Forest(np.arange(500), rows, sides)
    own = np.array([forest.sorted[t][np.argsort(forest.orders[t])] for t in range(4)])
    for few, many in zip(forest.candidates(own[:, :20], 5), forest.candidates(own[:, :20], 100), strict=True):
        assert set(few) <= set(many)
    for query, places in enumerate(forest.candidates(own[:, :20], 1)):
        assert query in places
    assert all(len(x) == 500 for x in forest.candidates(own[:, :3], 500))


def test_folds_and_bitmaps(spark):
    rows = spark.createDataFrame([(1,), (12,), (None,)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 10).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(b"1") % 10, zlib.crc32(b"12") % 10, -1]
    ids = spark.range(0, 1000, 3)
    marked = maybe_among(spark.range(1000), "id", ids.select("id"), "maybe").collect()
    assert len(marked) == 1000 and all(r.maybe for r in marked if r.id % 3 == 0) and sum(r.maybe for r in marked) < 360


def test_every_numbered_query_is_there():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "n-gram", "benchmark", "SentencePiece"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("lang = 'en' AND doc_id = 7").first().text
    odd = [(None, " ".join(reversed(text.split())), "en", "s", 1), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_clean_documents(spark, sf, stages):
    docs, spoken, clean, single, fresh, encoded = stages
    for frame in stages[1:5]:
        assert frame.columns == docs.columns
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in stages]
    assert ids[0] - ids[1] == Counter([10**6, 10**6 + 1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids[1] - ids[2]
    toxic = [i for i in ids[1] if labels.get(i) == 1]
    assert sum(i in gone for i in toxic) >= 0.6 * len(toxic) and sum(labels.get(i) == 0 for i in gone) <= 2
    groups = near_duplicates(clean.withColumnRenamed("doc_id", "paper_id")).collect()
    assert ids[3] == Counter(r.paper_id for r in groups if r.paper_id == r.component_id)
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(b[i : i + 10]) for b in bench for i in range(len(b) - 9)}
    texts = {r.doc_id: r.text.lower().split() for r in single.collect()}
    held = {i for i, w in texts.items() if any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))}
    assert ids[3] - ids[4] == Counter(held)
    assert ids[5] == ids[4] and encoded.where("n_pieces = 0").count() == 0


def test_empty_documents_pass_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_stages_take_columns_of_any_name_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80")
    more = {c: F.lit(c) for c in ("paper_id", "row", "score", "hits", "_key", "language", "class", "rejected")}
    docs = docs.unionByName(docs).withColumns(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        rows = Counter(r.doc_id for r in kept.collect())
        assert rows and set(rows.values()) == ({1} if name.startswith("n-gram") else {2}), name
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert coded.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids", "exact"]
    assert coded.count() == docs.count() and coded.where("NOT exact").isEmpty()
