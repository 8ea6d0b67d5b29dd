"""Language of papers: nearest centroid over TF-IDF vectors of character n-grams, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import text_batches

#: Hashed n-grams of one to three characters.
BUCKETS = 4096
#: Characters that are looked at together; it bounds memory, counts are added up.
SLICE = 1_000_000
#: Length bands of the rejection threshold: powers of two of a text's n-gram count.
BANDS = 48
#: Papers of a language, of one length or the next shorter ones, that its limit of rejection is taken from at least.
ENOUGH = 20
NO_LANGUAGE = "und"


@dataclass
class LanguageModel:
    """Fitted centroids. ``floor[k, b]`` is the least similarity of an accepted text of language k and length band b."""

    languages: list[str]
    owner: np.ndarray  # centroid -> index into languages
    centroids: np.ndarray  # rows of length one
    idf: np.ndarray
    floor: np.ndarray


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(x).isalpha() for x in range(0x110000)])


def ngram_counts(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased letters; every run of other characters is one blank."""
    counts = np.zeros(BUCKETS, np.int64)
    lower = (text or "").lower()
    tail = np.array([32], np.uint64)
    seen = False
    for at in range(0, len(lower), SLICE):
        points = np.frombuffer(lower[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[points]
        seen = seen or bool(letter.any())
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= tail[-1] != 32
        own = np.where(letter, points, 32)[kept].astype(np.uint64)
        if at + SLICE >= len(lower) and len(own) and own[-1] != 32:
            own = np.append(own, np.uint64(32))
        chain = np.concatenate((tail, own))
        fresh = len(own)
        one = chain[-fresh:] if fresh else chain[:0]
        grams = [one[one != 32]]
        two = chain[:-1] * np.uint64(0x9E3779B1) + chain[1:]
        grams.append(two[-fresh:] if fresh else two[:0])
        if len(chain) > 2:
            three = two[:-1] * np.uint64(0x85EBCA77) + chain[2:]
            grams.append(three[-fresh:] if fresh else three[:0])
        for order, gram in enumerate(grams):
            spots = ((gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            counts += np.bincount(spots.astype(np.int64), minlength=BUCKETS)
        tail = chain[-2:]
    return counts if seen else np.zeros(BUCKETS, np.int64)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without n-grams stays zero."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def band_of_length(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int).clip(0, BANDS - 1)


def _centroids(rows: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means that starts from rows far from each other."""
    chosen = [rows.mean(axis=0)]
    for _ in range(min(clusters, len(rows)) - 1):
        chosen.append(rows[np.argmin(np.max(rows @ np.array(chosen).T, axis=1))])
    centers = np.array(chosen)
    for _ in range(rounds):
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        near = np.argmax(rows @ centers.T, axis=1)
        centers = np.array([rows[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(len(centers))])
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)


def _limits(near: np.ndarray, bands: np.ndarray, quantile: float) -> np.ndarray:
    """The ``quantile`` of similarities for every length band: of the ``ENOUGH`` longest texts up to its length, and of
    all of its own length; 0 where there are fewer."""
    order = np.argsort(-bands, kind="stable")
    limits = np.zeros(BANDS)
    for band in range(BANDS):
        upto = order[bands[order] <= band]
        if len(upto) >= ENOUGH:
            own = int((bands == band).sum())
            limits[band] = np.quantile(near[upto[: max(ENOUGH, own)]], quantile)
    return limits


def fit_languages(
    papers: DataFrame, per_language: int = 400, clusters: int = 4, slack: float = 0.6, quantile: float = 0.02
) -> LanguageModel:
    """Fit centroids to ``papers`` (paper_id, text, language).

    Rows without an id, a language or a letter teach nothing. Document frequencies are counted over all the others.
    The centroids come from a sample of about ``per_language`` papers of each language, chosen by a hash of the id, so
    the driver holds at most (languages x per_language) vectors; of several rows of an id the first by text and language
    counts. A text is rejected if its similarity is below ``slack`` times the ``quantile`` of those of the language's
    papers of its length: of its band and, until there are ``ENOUGH``, of the next shorter ones. Where a language has not
    as many papers up to a length, nothing is known of such texts and none is rejected.
    """
    known = papers.where("paper_id IS NOT NULL AND language IS NOT NULL AND text IS NOT NULL").select(
        "paper_id", "text", "language"
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, rows = letter_table(), np.zeros(BUCKETS, np.int64), 0
        for batch in text_batches(batches):
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text, letters)
                total += counts > 0
                rows += bool(counts.any())
        spots = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(spots), pa.array(np.append(total[spots[:-1]], rows))], ["bucket", "papers"]
        )

    counted = dict(
        known.select("text").mapInArrow(frequencies, "bucket long, papers long")
        .groupBy("bucket").agg(F.sum("papers")).toPandas().itertuples(index=False, name=None)
    )
    total = counted.pop(-1, 0)
    seen = np.zeros(BUCKETS)
    seen[list(counted)] = list(counted.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    sizes = {r["language"]: r["count"] for r in known.groupBy("language").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, BUCKETS), np.float32), idf, np.zeros((0, BANDS)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / sizes[k])])
    chance = F.pmod(F.xxhash64(F.col("paper_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    sampled = known.where(chance < share[F.col("language")])
    sample = sampled.groupBy("paper_id").agg(F.min(F.struct("text", "language")).alias("s")).select("paper_id", "s.*")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in text_batches(batches):
            rows = [ngram_counts(x, letters) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id").cast(pa.string()), batch.column("language"),
                 pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())],
                ["paper_id", "language", "counts"],
            )

    found = sample.mapInArrow(vectors, "paper_id string, language string, counts binary").toPandas()
    found = found.sort_values("paper_id", kind="stable")
    counts = np.array([np.frombuffer(x, np.int32) for x in found["counts"]]).reshape(-1, BUCKETS)
    label = np.array(found["language"], dtype=object)
    filled = counts.any(axis=1)
    counts, label = counts[filled], label[filled]
    rows = weighted(counts, idf)
    centers, owner = [], []
    for number, language in enumerate(languages):
        if (own := rows[label == language]).size:
            centers.append(_centroids(own, clusters))
            owner += [number] * len(centers[-1])
    centroids = np.concatenate(centers) if centers else np.zeros((0, BUCKETS), np.float32)
    owner = np.array(owner, int)
    floor = np.zeros((len(languages), BANDS))
    bands = band_of_length(counts) if len(counts) else np.zeros(0, int)
    for number, language in enumerate(languages):
        own = label == language
        if own.any():
            near = (rows[own] @ centroids[owner == number].T).max(axis=1)
            floor[number] = slack * _limits(near, bands[own], quantile)
    return LanguageModel(languages, owner, centroids.astype(np.float32), idf, floor)


def identify_languages(papers: DataFrame, model: LanguageModel, carry: Sequence[str] = ()) -> DataFrame:
    """Nearest language of every paper.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``, which come back as they
    are. Returns one row per row: paper_id, language (the
    language of the nearest centroid by cosine, ties to the first in order; ``und`` where the text is null or has no
    letter, or nothing was learnt), score (that cosine, 0 to 1), rejected (``und``, or farther from that centroid than
    papers of the language and of that length go). Whole texts are read.
    """
    languages, owner, centroids = model.languages, model.owner, model.centroids
    idf, floor = model.idf, model.floor
    kind = papers.schema["paper_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in text_batches(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = np.array([ngram_counts(x, letters) for x in part.column("text").to_pylist()])
                filled = counts.any(axis=1) & bool(len(owner))
                best, score = np.zeros(len(counts), int), np.zeros(len(counts))
                limits = np.zeros(len(counts))
                if len(owner):
                    near = weighted(counts, idf) @ centroids.T
                    best, score = owner[near.argmax(axis=1)], near.max(axis=1).clip(0, 1).astype(float)
                    limits = floor[best, band_of_length(counts)]
                names = [languages[b] if f else NO_LANGUAGE for b, f in zip(best, filled, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("paper_id"), pa.array(names, pa.string()), pa.array(np.where(filled, score, 0.0)),
                     pa.array(~filled | (score < limits)), *[part.column(c) for c in carry]],
                    ["paper_id", "language", "score", "rejected", *carry],
                )

    out = T.StructType([
        T.StructField("paper_id", kind), T.StructField("language", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        *[papers.schema[c] for c in carry],
    ])
    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)
