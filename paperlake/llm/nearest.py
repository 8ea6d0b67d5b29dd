"""Approximate nearest neighbours by cosine: a forest of sorted hash strings (LSH forest; Bawa, Condie and Ganesan, 2005).

The project has no vectors, so this operator is general: any table of (vector_id, embedding).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paperlake.llm.common import pieces_of, stored

#: Vectors in a shard of the index, and queries in a block.
SHARD, QUERIES = 8192, 8192
#: Length of a hash string. Longer prefixes than this are never needed in a shard.
BITS = 48


def planes(trees: int, dimension: int, seed: int = 3) -> np.ndarray:
    """The random hyperplanes whose sides are the characters of the hash strings."""
    return np.random.default_rng(seed).normal(size=(trees, dimension, BITS))


def hash_strings(rows: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """One string of ``BITS`` characters per row, the first character in the highest bit."""
    powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return ((rows @ sides) >= 0).astype(np.uint64) @ powers


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, sides: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.norms = np.sqrt((rows * rows).sum(axis=1))
        strings = [hash_strings(rows, s) for s in sides]
        self.orders = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.orders, strict=True)]

    def candidates(self, strings: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For every query (a column of ``strings``: trees x queries) the rows that share its longest prefixes.

        All trees are descended to full length and then ascended together, a character at a time, until their ranges
        are expected to hold ``wanted`` different rows.
        """
        size, trees = len(self.ids), len(self.sorted)
        wanted = min(wanted, size)
        enough = -np.log1p(-min(wanted / size, 1 - 1e-9)) * size if wanted < size else np.inf
        count = strings.shape[1]
        low, high = np.zeros((trees, count), np.int64), np.full((trees, count), size)
        settled = np.zeros(count, bool)
        for length in range(BITS, 0, -1):
            if settled.all():
                break
            rest = np.uint64((1 << (BITS - length)) - 1)
            left = np.empty((trees, count), np.int64)
            right = np.empty((trees, count), np.int64)
            for tree in range(trees):
                left[tree] = np.searchsorted(self.sorted[tree], strings[tree] & ~rest, "left")
                right[tree] = np.searchsorted(self.sorted[tree], strings[tree] | rest, "right")
            now = ~settled & ((right - left).sum(axis=0) >= enough)
            low[:, now], high[:, now] = left[:, now], right[:, now]
            settled |= now
        for query in range(count):
            if not settled[query]:
                yield np.arange(size)
                continue
            chosen = np.zeros(size, bool)
            for tree in range(trees):
                chosen[self.orders[tree][low[tree, query] : high[tree, query]]] = True
            yield np.flatnonzero(chosen)


def _search(dimension: int, trees: int, share: float, least: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = planes(trees, dimension)
        shard, forest = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                number = batch.column("shard")[n].as_py()
                if number != shard:
                    rows = np.array(batch.column("vectors")[n].values.flatten(), np.float64).reshape(-1, dimension)
                    forest = Forest(batch.column("ids")[n].values.to_numpy(), rows, sides)
                    shard = number
                queries = np.array(batch.column("query_vectors")[n].values.flatten(), np.float64).reshape(-1, dimension)
                names = batch.column("query_ids")[n].values.to_numpy()
                strings = np.array([hash_strings(queries, s) for s in sides])
                wanted = max(least, int(np.ceil(share * len(forest.ids))))
                found: list[tuple[np.ndarray, ...]] = []
                for query, places in enumerate(forest.candidates(strings, wanted)):
                    places = places[forest.ids[places] != names[query]]
                    if not len(places):
                        continue
                    norm = np.sqrt((queries[query] * queries[query]).sum())
                    near = (forest.rows[places] @ queries[query]) / forest.norms[places]
                    if len(places) > k:
                        bound = np.partition(near, len(near) - k)[len(near) - k]
                        places = places[near >= bound - 1e-9 * norm]
                    # Each row's own sum, so that equal vectors have equal scores wherever they are.
                    score = (forest.rows[places] * queries[query]).sum(axis=1) / (forest.norms[places] * norm)
                    best = np.lexsort((forest.ids[places], -score))[:k]
                    found.append((np.full(len(best), names[query]), forest.ids[places][best], score[best]))
                columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    ["query_id", "vector_id", "score"],
                )

    return task


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 32, share: float = 0.55, least: int = 1000
) -> DataFrame:
    """The ``k`` nearest vectors of every query, by cosine in double precision.

    ``vectors`` has vector_id (long) and embedding (array of float or double); ``queries`` has vector_id of the rows to
    search for. Other columns are ignored. Returns query_id, rank (int, from 1), vector_id, score; ties go to the
    smaller vector_id, and a query is no candidate of its own. Vectors that are null, zero, or hold a null or
    non-finite component take no part, nor do rows without an id or of another length than most (of equally frequent
    lengths, the smallest). A repeated id stands for its first vector in order. With fewer than k candidates all are
    returned; an empty table gives no rows.

    The index is cut in shards of rows; each holds ``trees`` sorted arrays of hash strings of all its vectors. A query
    takes from each shard the rows with the longest common prefixes, until about ``share`` of the shard (and at least
    ``least`` rows) are candidates; these are compared exactly. Of equal vectors the first k + 1 are indexed, which is
    all that a query can return. Every block of queries meets every shard, so work is queries times shards; tasks read
    both where they were dealt, so that no copies of the queries are made, be it on disk or for the driver to broadcast.
    """
    # Floats stay floats until they are compared: as doubles they would be stored and shuffled at twice their size.
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    whole = vectors.where("vector_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vector_id").cast("long").alias("vector_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    whole = whole.where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    if not single:  # doubles can be beyond what a float holds
        # Cosines do not depend on a vector's length: with the largest component at one, no sum of squares is 0 or infinite.
        large = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
        scaled = F.transform("embedding", lambda x: x / F.col("_large"))
        usual = F.col("_large").between(1e-100, 1e100)
        whole = whole.withColumn("_large", large).select("vector_id", F.when(usual, F.col("embedding")).otherwise(scaled).alias("embedding"))
    most = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = most["d"] if most else 1
    clean = stored(whole.where(F.size("embedding") == dimension).groupBy("vector_id").agg(F.min("embedding").alias("embedding")))
    total = clean.count()
    asked = clean.join(queries.select(F.col("vector_id").cast("long").alias("vector_id")).distinct(), "vector_id", "left_semi")
    shards = pieces_of(total, SHARD)
    number = F.row_number().over(Window.partitionBy("embedding").orderBy("vector_id"))
    kept = clean.withColumn("_n", number).where(F.col("_n") <= k + 1)
    pack = F.array_sort(F.collect_list(F.struct("vector_id", "embedding")))

    def dealt(rows: DataFrame, number: str, pieces: int, *seed: Column) -> DataFrame:
        """Rows in so many pieces, each one row; dealt first, so that tasks do not gather lists of all pieces."""
        place = F.pmod(F.xxhash64("vector_id", *seed), F.lit(pieces)).alias(number)
        return rows.select(place, "vector_id", "embedding").repartition(pieces, number).groupBy(number).agg(pack.alias("p"))

    index = dealt(kept, "shard", shards).select("shard", F.col("p.vector_id").alias("ids"), F.col("p.embedding").alias("vectors"))
    blocks = pieces_of(asked.count(), QUERIES)
    search = dealt(asked, "block", blocks, F.lit(1)).select(F.col("p.vector_id").alias("query_ids"), F.col("p.embedding").alias("query_vectors"))
    # A task for each pair of their partitions: no more partitions than blocks, however they were dealt.
    found = index.crossJoin(search.coalesce(blocks).hint("shuffle_replicate_nl")).mapInArrow(
        _search(dimension, trees, share, least, k), "query_id long, vector_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vector_id", "score")
