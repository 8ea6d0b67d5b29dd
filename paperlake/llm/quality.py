"""Quality of papers: ordinal cumulative-link regression of graded ratings on hashed text features.

All grades share one weight per feature; ordered thresholds cut the resulting scale: P(grade <= k) is the logistic
function of threshold k minus the weighted features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import text_batches

#: Hashed features; the last ones are the text's length class.
FEATURES = 1 << 15
LENGTHS = 32
MEMO_WORDS = 200_000
RUN = re.compile(r"(.)\1+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class QualityModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


class TokenFeatures(dict):
    """Token -> its word's and its shape's hash in one number, computed once per distinct token."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        shape = RUN.sub(r"\1", "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token]))
        word, form = (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in (token.lower(), shape))
        value = self[token] = (word & 0xFFFFFFFF) << 32 | form >> 32
        return value


def features(text: str | None, memo: TokenFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text, of length one: words, shapes, pairs of shapes, repeated words."""
    tokens = text.split() if text else []
    packed = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    again = (word[1:] == word[:-1]).astype(np.uint64)
    kinds = (word, shape, shape[1:] * np.uint64(31) + shape[:-1], again)
    values = np.zeros(FEATURES + LENGTHS)
    for number, kind in enumerate(kinds):
        spots = ((kind * np.uint64(8) + np.uint64(number)) * GOLDEN) >> np.uint64(49)
        counts = np.bincount(spots.astype(np.int64), minlength=FEATURES)
        # Each kind has the same weight in a text, however long it is.
        values[:FEATURES] += np.sqrt(counts / max(1, len(spots)))
    values[FEATURES + min(LENGTHS - 1, len(tokens).bit_length())] = 1.0
    spots = np.flatnonzero(values)
    return spots, values[spots]


def _grade_chances(scale: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = k) for rows of ``scale``."""
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - scale[:, None], -40, 40)))
    edges = np.concatenate((np.zeros((len(scale), 1)), below, np.ones((len(scale), 1))), axis=1)
    return np.diff(edges, axis=1)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, importance: np.ndarray, grades: list[int],
    rounds: int = 15, batch: int = 64, seed: int = 5,
) -> QualityModel:
    """Maximum likelihood with a small ridge, by Adagrad on mini-batches. ``marks`` are positions in ``grades``."""
    cuts = len(grades) - 1
    weights = np.zeros(FEATURES + LENGTHS)
    if cuts < 1:
        return QualityModel(grades, weights, np.zeros(0))
    share = np.cumsum(np.bincount(marks, importance, minlength=len(grades)))[:-1] / importance.sum()
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # Gaps between thresholds are squares, so that they stay in order.
    free = np.append(first[0], np.sqrt(np.maximum(np.diff(first), 1e-2)))
    seen, seen_free = np.full(len(weights), 1e-6), np.full(cuts, 1e-6)
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            spots = np.concatenate([rows[k][0] for k in part])
            values = np.concatenate([rows[k][1] for k in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            thresholds = free[0] + np.append(0, np.cumsum(free[1:] ** 2))
            scale = np.bincount(owner, weights[spots] * values, minlength=len(part))
            below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - scale[:, None], -40, 40)))
            edges = np.concatenate((np.zeros((len(part), 1)), below, np.ones((len(part), 1))), axis=1)
            slope = edges * (1 - edges)
            here, lane = marks[part], np.arange(len(part))
            chance = np.maximum(edges[lane, here + 1] - edges[lane, here], 1e-9)
            weight = importance[part] / importance[part].sum()
            upper, lower = slope[lane, here + 1] / chance, slope[lane, here] / chance
            d_scale = weight * (upper - lower)
            d_cuts = np.zeros(cuts)
            np.add.at(d_cuts, np.minimum(here, cuts - 1), np.where(here < cuts, -weight * upper, 0))
            np.add.at(d_cuts, np.maximum(here - 1, 0), np.where(here > 0, weight * lower, 0))
            d_free = np.append(d_cuts.sum(), [2 * free[k] * d_cuts[k:].sum() for k in range(1, cuts)])
            touched, place = np.unique(spots, return_inverse=True)
            grads = np.bincount(place, d_scale[owner] * values) + 1e-5 * weights[touched]
            seen[touched] += grads**2
            weights[touched] -= 0.3 * grads / np.sqrt(seen[touched])
            seen_free += d_free**2
            free -= 0.05 * d_free / np.sqrt(seen_free)
    return QualityModel(grades, weights, free[0] + np.append(0, np.cumsum(free[1:] ** 2)))


def fit_quality(papers: DataFrame, ratings: DataFrame, per_grade: int = 2000) -> QualityModel:
    """Fit to the ratings of papers.

    ``papers`` has paper_id and text, ``ratings`` paper_id and novelty_score, any graded mark (integers, the higher the
    better). Rows with a null id or mark teach nothing; of several marks of a paper the smallest counts. Of each grade
    the ``per_grade`` ids that come first by a hash are learnt from, weighted by how many papers have that grade, so
    that chances stay those of all rated papers.
    """
    marks = ratings.where("paper_id IS NOT NULL AND novelty_score IS NOT NULL").groupBy("paper_id").agg(
        F.min("novelty_score").cast("int").alias("grade")
    )
    sizes = {r["grade"]: r["count"] for r in marks.groupBy("grade").count().collect()}
    grades = sorted(sizes)
    by = [F.xxhash64(F.col("paper_id").cast("string")), "paper_id"]
    chosen = marks.limit(0)
    for grade in grades:
        chosen = chosen.unionByName(marks.where(F.col("grade") == grade).orderBy(*by).limit(per_grade))
    few = F.broadcast(chosen)  # at most per_grade ids of each grade
    texts = papers.select("paper_id", "text").join(few, "paper_id").groupBy("paper_id", "grade").agg(F.min("text").alias("text"))
    kind = papers.schema["paper_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenFeatures()
        for batch in text_batches(batches):
            rows = [features(x, memo) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), batch.column("grade"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                ["paper_id", "grade", "spots", "values"],
            )

    schema = T.StructType([
        T.StructField("paper_id", kind), T.StructField("grade", T.IntegerType()),
        T.StructField("spots", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
    ])
    found = texts.mapInArrow(task, schema).toPandas().sort_values("paper_id", kind="stable")
    place = np.array([grades.index(g) for g in found["grade"]], int)
    rows = [(np.asarray(s, np.int64), np.asarray(v)) for s, v in zip(found["spots"], found["values"], strict=True)]
    taken = np.bincount(place, minlength=len(grades)) if len(place) else np.zeros(len(grades))
    importance = np.array([sizes[grades[k]] / taken[k] for k in place])
    if not len(rows):
        return QualityModel(grades[:1], np.zeros(FEATURES + LENGTHS), np.zeros(0))
    return train(rows, place, importance, grades)


def rate_papers(
    papers: DataFrame, model: QualityModel, from_grade: int | None = None, least: float = 0.5, carry: Sequence[str] = ()
) -> DataFrame:
    """Expected grade of every paper, and how likely it is to be good enough.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``. Returns one row per
    row: paper_id, expected_grade (double), tail_probability (that the grade is ``from_grade`` or more; the highest
    grade where none is given), selected (that it is at least ``least``) and the carried columns. Whole texts are read;
    null and empty texts have their length class as their only feature. Without any rating expected_grade is null and
    tail_probability 0.
    """
    out = T.StructType([
        papers.schema["paper_id"], T.StructField("expected_grade", T.DoubleType()),
        T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType()),
        *[papers.schema[c] for c in carry],
    ])
    grades = np.array(model.grades, float)
    good = grades >= (from_grade if from_grade is not None else max(model.grades, default=0))
    weights, thresholds = model.weights, model.thresholds

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenFeatures()
        for batch in text_batches(batches):
            scale = []
            for text in batch.column("text").to_pylist():
                spots, values = features(text, memo)
                scale.append(float(weights[spots] @ values))
            chances = _grade_chances(np.array(scale), thresholds) if len(grades) else np.zeros((len(scale), 0))
            tail = chances[:, good].sum(axis=1)
            mean = pa.array(chances @ grades) if len(grades) else pa.nulls(len(scale), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), mean, pa.array(tail), pa.array(tail >= least), *[batch.column(c) for c in carry]],
                ["paper_id", "expected_grade", "tail_probability", "selected", *carry],
            )

    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)
