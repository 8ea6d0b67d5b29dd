"""A hidden Markov language model over papers, trained by Baum-Welch on counts that are summed across partitions.

Latent states emit word classes, and a class emits its words. Frequent words are classes of their own; all others belong
to a class by a hash of their ending. Word counts cover the whole corpus and stay in Spark; what is of fixed size
(states, transitions, class emissions) is on the driver between two rounds.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperlake.llm.common import stored, text_batches
from paperlake.llm.shingles import words_of

#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Bytes of text in a block: a dictionary of its words and its texts as numbers in it. A longer text is a block alone.
BLOCK = 8_000_000
#: Words of a training sequence: longer texts are several sequences. Scores are of whole texts.
SEQUENCE = 64
#: Training sequences that go through the recursions together, and tokens that are scored side by side.
LANES, LANE_TOKENS = 8192, 2_000_000
#: Hashed classes of words by their last three bytes; the low bits of a word's key.
BUCKETS = 1024


@dataclass
class HiddenMarkov:
    """Fitted model: classes of frequent words (in the order of their keys), then the hashed classes."""

    top: np.ndarray
    top_counts: np.ndarray
    bucket_tokens: np.ndarray
    bucket_singles: np.ndarray
    start: np.ndarray
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes
    tokens: int
    words: int


def word_key(word: bytes) -> int:
    """What stands for a word: 54 bits of its hash, and its hashed class."""
    key = (xxhash.xxh3_64_intdigest(word) & ~(BUCKETS - 1)) | (zlib.crc32(word[-3:]) % BUCKETS)
    return key - (1 << 64) if key >> 63 else key


def classes_of(keys: np.ndarray, top: np.ndarray) -> np.ndarray:
    place = np.searchsorted(top, keys).clip(0, max(len(top) - 1, 0))
    frequent = top[place] == keys if len(top) else np.zeros(len(keys), bool)
    return np.where(frequent, place, len(top) + (keys & (BUCKETS - 1)))


def _blocks(papers: DataFrame) -> DataFrame:
    """One row per block: the keys of its words, the frequent first, with their counts in learning texts, and its texts
    as numbers of those words (low 16 bits, and the bits above)."""
    kind = papers.schema["paper_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("learnt", T.ArrayType(T.IntegerType())), T.StructField("paper_ids", T.ArrayType(kind)),
        T.StructField("learns", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()),
    ])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, BLOCK):
            numbering: defaultdict[bytes, int] = defaultdict(count().__next__)
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                words.append(END)
                rows.append(np.fromiter(map(numbering.__getitem__, words), np.int32, len(words)))
            learns = batch.column("learns").to_numpy(zero_copy_only=False)
            sizes = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            order = np.argsort(-np.bincount(flat), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            flat = rank[flat]
            keys = np.fromiter(map(word_key, numbering), np.int64, len(numbering))[order]
            learnt = np.bincount(flat[np.repeat(learns, sizes)], minlength=len(keys))

            def one(values: pa.Array) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), one(pa.array(keys)), one(pa.array(learnt, pa.int32())), one(batch.column("paper_id")),
                 one(batch.column("learns")), one(pa.array(sizes, pa.int32())),
                 pa.array([flat.astype(np.uint16).tobytes()]), pa.array([_bytes_of(flat >> 16)])],
                schema=arrow,
            )
            block += 1

    return papers.select("paper_id", "text", "learns").mapInArrow(task, schema)


def _bytes_of(high: np.ndarray) -> bytes:
    wide = int(high.max(initial=0) > 255)
    return bytes([wide]) + high.astype(np.uint32 if wide else np.uint8).tobytes()


def _read(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, word numbers of all texts, sizes of the texts, and which learn."""
    low = np.frombuffer(batch.column("low")[k].as_py(), np.uint16)
    packed = batch.column("high")[k].as_py()
    high = np.frombuffer(packed, np.uint32 if packed[0] else np.uint8, offset=1)
    return (
        batch.column("keys")[k].values.to_numpy(), low + (high.astype(np.int32) << 16),
        batch.column("sizes")[k].values.to_numpy().astype(np.int64),
        batch.column("learns")[k].values.to_numpy(zero_copy_only=False).astype(bool),
    )


def _cuts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where training sequences of texts begin in their joined words, and how long they are, the longest first."""
    pieces = -(-sizes // SEQUENCE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = (np.cumsum(sizes) - sizes)[owner] + number * SEQUENCE
    lengths = np.minimum(sizes[owner] - number * SEQUENCE, SEQUENCE)
    order = np.argsort(-lengths, kind="stable")
    return begins[order], lengths[order]


def forward_backward(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, start, move, emit):
    """Expected counts over class sequences of falling length: emissions (states x classes), moves, starts."""
    active = [int(np.count_nonzero(lengths > t)) for t in range(int(lengths[0]))]
    spots, seen, ahead, scale = [], [], [], []
    for t, n in enumerate(active):
        spots.append(flat[begins[:n] + t])
        seen.append(emit[:, spots[-1]])
        now = (move.T @ ahead[-1][:, :n] if t else start[:, None]) * seen[-1]
        scale.append(now.sum(axis=0))
        ahead.append(now / scale[-1])
    moves = np.zeros_like(move, dtype=np.float64)
    after = np.ones((len(start), active[-1]), emit.dtype)
    weights = [None] * len(active)
    for t in range(len(active) - 1, -1, -1):
        if t + 1 < len(active):
            m = active[t + 1]
            inner = seen[t + 1] * after / scale[t + 1]
            moves += ahead[t][:, :m] @ inner.T
            after = np.ones((len(start), active[t]), emit.dtype)
            after[:, :m] = move @ inner
        weights[t] = ahead[t] * after
    spot, weight = np.concatenate(spots), np.concatenate(weights, axis=1)
    emissions = np.stack([np.bincount(spot, w, minlength=emit.shape[1]) for w in weight])
    return emissions, moves * move, weights[0].sum(axis=1).astype(np.float64)


def _expected(top: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """A task of a Baum-Welch round: sums over its blocks as rows (part, place, weight)."""
    start, move, emit = (x.astype(np.float32) for x in (start, move, emit))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(emit.shape), np.zeros(move.shape), np.zeros(start.shape)]
        for batch in batches:
            for k in range(batch.num_rows):
                keys, numbers, sizes, learns = _read(batch, k)
                flat = classes_of(keys, top)[numbers[np.repeat(learns, sizes)]]
                begins, lengths = _cuts(sizes[learns])
                for at in range(0, len(begins), LANES):
                    some = slice(at, at + LANES)
                    for total, part in zip(sums, forward_backward(flat, begins[some], lengths[some], start, move, emit), strict=True):
                        total += part
        parts = [x.ravel() for x in sums]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(3), [len(x) for x in parts])),
                pa.array(np.concatenate([np.arange(len(x)) for x in parts])), pa.array(np.concatenate(parts)),
            ],
            ["part", "place", "weight"],
        )

    return task


def _fit(blocks: DataFrame, counts: DataFrame, states: int, top_words: int, rounds: int) -> HiddenMarkov:
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, words = int(totals[0]), int(totals[1])
    best = counts.orderBy(F.col("c").desc(), "key").limit(top_words).collect()
    best.sort(key=lambda r: r["key"])
    top = np.array([r["key"] for r in best], np.int64)
    top_counts = np.array([r["c"] for r in best], float)
    bucket = F.col("key").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    bucket_tokens, singles = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(bucket).agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("singles")).collect():
        bucket_tokens[r["bucket"]], singles[r["bucket"]] = r["tokens"], r["singles"]
    np.subtract.at(bucket_tokens, top & (BUCKETS - 1), top_counts)
    np.subtract.at(singles, (top & (BUCKETS - 1))[top_counts == 1], 1)
    mass = np.concatenate((top_counts, bucket_tokens)) + 0.1
    share = mass / mass.sum()
    emit = share * np.exp(np.random.default_rng(11).normal(0, 0.5, (states, len(share))))
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    for _ in range(rounds if tokens else 0):
        found = (
            blocks.select("keys", "learns", "sizes", "low", "high")
            .mapInArrow(_expected(top, start, move, emit), "part long, place long, weight double")
            .groupBy("part", "place").agg(F.sum("weight").alias("weight")).toPandas()
        )
        sums = [np.zeros(emit.size), np.zeros(move.size), np.zeros(states)]
        for part, own in enumerate(sums):
            here = found[found["part"] == part]
            own[here["place"].to_numpy()] = here["weight"].to_numpy()
        # A class keeps some of its corpus share in every state, so that no text is impossible.
        emit = sums[0].reshape(emit.shape) + 50 * share
        emit /= emit.sum(axis=1, keepdims=True)
        move = sums[1].reshape(move.shape) + 1
        move /= move.sum(axis=1, keepdims=True)
        start = (sums[2] + 1) / (sums[2] + 1).sum()
    return HiddenMarkov(top, top_counts, bucket_tokens, singles, start, move, emit, tokens, words)


def sequence_logs(flat: np.ndarray, sizes: np.ndarray, model: HiddenMarkov) -> np.ndarray:
    """Natural logarithm of the exact likelihood of whole class sequences, by the scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    falling = -sizes[order]
    logs = np.zeros(len(sizes))
    state = model.start[:, None]
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(falling, -t, "left"))
        state = (model.move.T @ state[:, :n] if t else state) * model.emit[:, flat[begins[:n] + t]]
        total = state.sum(axis=0)
        state = state / total
        logs[:n] += np.log(total)
    out = np.empty(len(sizes))
    out[order] = logs
    return out


def _score(model: HiddenMarkov, arrow: pa.Schema):
    """Score the texts of blocks; ``found`` has the counts of those words that are no class of their own."""
    size = len(model.top)
    floor = np.log10(model.tokens + 0.1 * (model.words + 1))
    fresh = (model.bucket_singles + 0.5) / (model.bucket_tokens + 1)

    def words_of_block(batch: pa.RecordBatch, k: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per word of a block: its class, whether it is known, its base score, and its chance within its class."""
        classes = classes_of(keys, model.top)
        own = classes < size
        counts = np.zeros(len(keys))
        counts[own] = model.top_counts[classes[own]]
        found = batch.column("found")[k].values
        if found is not None and len(found):
            counts[found.field("place").to_numpy()] = found.field("c").to_numpy()
        bucket = np.where(own, 0, classes - size)
        new, total = fresh[bucket].clip(0, 1 - 1e-9), np.maximum(model.bucket_tokens[bucket], 1)
        with np.errstate(divide="ignore"):
            inner = np.where(counts > 0, np.log10((1 - new) * counts / total), np.log10(new))
        return classes, counts > 0, np.log10(counts + 0.1) - floor, np.where(own, 0.0, inner)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([w[0] for w in waiting])
            held, known, base, inner, flat, sizes = (np.concatenate([w[k] for w in waiting]) for k in range(1, 7))
            waiting.clear()
            hidden = sequence_logs(flat, sizes, model) / np.log(10)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(sizes), pa.array(known), pa.array(np.full(len(ids), model.tokens, np.int64)),
                 pa.array(base), pa.array(hidden + inner)],
                schema=arrow,
            )

        tokens = 0
        for batch in batches:
            for k in range(batch.num_rows):
                keys, numbers, sizes, learns = _read(batch, k)
                classes, known, base, inner = words_of_block(batch, k, keys)
                starts = np.cumsum(sizes) - sizes

                def total(values: np.ndarray, at=starts, of=numbers) -> np.ndarray:
                    return np.add.reduceat(values[of], at)

                waiting.append((
                    batch.column("paper_ids")[k].values, ~learns, total(known.astype(np.int64)), total(base), total(inner),
                    classes[numbers], sizes,
                ))
                tokens += len(numbers)
                if tokens >= LANE_TOKENS:
                    yield flush()
                    tokens = 0
        if waiting:
            yield flush()

    return task


def score_papers(
    papers: DataFrame, states: int = 6, top_words: int = 2048, rounds: int = 4
) -> DataFrame:
    """Train the model on the papers that learn, and score all of them.

    ``papers`` has paper_id, text and learns (boolean; null counts as false); other columns are ignored. Returns one row
    per row: paper_id, held_out (it does not learn), n_tokens (words and the end), n_known (those that learning papers
    hold), train_tokens, base_score (log10 probability under smoothed word counts), score (log10 probability of the
    whole text under the hidden Markov model: exact likelihood of its classes, times the chance of each word in its
    class). A null or empty text is its end alone. Where nothing learns, both scores rest on the smoothing only.

    A word that no learning paper holds is the unknown word of its class, whose chance is that of a word seen once. Words
    are told apart by 54 bits of a hash and a class of 1024.
    """
    kind = papers.schema["paper_id"].dataType
    ready = papers.select("paper_id", "text", F.coalesce("learns", F.lit(False)).alias("learns"))
    blocks = stored(_blocks(ready))
    entries = blocks.select(F.explode(F.arrays_zip("keys", "learnt")).alias("e")).select("e.keys", "e.learnt")
    counts = stored(entries.where("learnt > 0").groupBy(F.col("keys").alias("key")).agg(F.sum("learnt").alias("c")))
    model = _fit(blocks, counts, states, top_words, rounds)
    top = counts.sparkSession.createDataFrame([(int(k),) for k in model.top], "key long")  # top_words rows at most
    places = blocks.select("block", F.posexplode("keys").alias("place", "key")).join(F.broadcast(top), "key", "left_anti")
    found = places.join(counts, "key").groupBy("block").agg(F.collect_list(F.struct("place", "c")).alias("found"))
    out = T.StructType([
        T.StructField("paper_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    joined = blocks.drop("learnt").join(found, "block", "left")
    return joined.mapInArrow(_score(model, arrow), out)
