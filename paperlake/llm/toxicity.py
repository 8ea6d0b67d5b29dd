"""Toxicity of papers: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a learnt vector of the word and the mean of learnt vectors of its character n-grams, so that unseen
words of a known shape are recognised. The network reads overlapping windows of a text; a text is as toxic as its most
toxic window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import text_batches

WINDOW, STRIDE = 64, 32
HIDDEN = 8
WORD_SIZE, WORD_ROWS = 8, 1 << 13
CHAR_SIZE, CHAR_ROWS = 12, 1 << 15
CHAR_ORDERS = (3, 4, 5)
#: Windows that go through the network together.
LANES = 1024
WORD = re.compile(r"[^\W\d_]+")
GOLDEN = 0x9E3779B97F4A7C15


@dataclass
class ToxicityModel:
    """Parameters: embeddings, and per direction the input, recurrent and bias weights (update, reset, candidate)."""

    words: np.ndarray
    chars: np.ndarray
    inputs: np.ndarray  # (word + char size) x 6 hidden
    bias: np.ndarray  # 6 hidden
    gates: np.ndarray  # 2 x hidden x 2 hidden
    candidate: np.ndarray  # 2 x hidden x hidden
    attention: np.ndarray  # 2 hidden
    out: np.ndarray  # 2 hidden, and the constant last

    @staticmethod
    def start(seed: int = 7) -> ToxicityModel:
        draw = np.random.default_rng(seed)

        def normal(scale: float, *shape: int) -> np.ndarray:
            return draw.normal(0, scale, shape).astype(np.float32)

        size = WORD_SIZE + CHAR_SIZE
        return ToxicityModel(
            normal(0.02, WORD_ROWS, WORD_SIZE), normal(0.02, CHAR_ROWS, CHAR_SIZE), normal(size**-0.5, size, 6 * HIDDEN),
            np.zeros(6 * HIDDEN, np.float32), normal(HIDDEN**-0.5, 2, HIDDEN, 2 * HIDDEN),
            normal(HIDDEN**-0.5, 2, HIDDEN, HIDDEN), normal(0.5, 2 * HIDDEN), normal(0.5, 2 * HIDDEN + 1),
        )


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def char_spots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``<word>`` for all words: (row in the table, index of the word), ordered by the word."""
    joined = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    chain, spots, owners = points, [], []
    for order in range(2, max(CHAR_ORDERS) + 1):
        if len(points) < order:
            break
        chain = chain[:-1] * np.uint64(0x100000001B3) + points[order - 1 :]
        if order in CHAR_ORDERS:
            inner = owner[: len(chain)] == owner[order - 1 :]
            spots.append(((chain[inner] * np.uint64(GOLDEN)) >> np.uint64(49)).astype(np.int64))
            owners.append(owner[: len(chain)][inner])
    if not spots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot, own = np.concatenate(spots), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return spot[order], own[order]


def word_spots(words: list[str]) -> np.ndarray:
    """Rows of the word table: a polynomial hash of the characters, the same in every process."""
    joined = "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    salt = ((place + 1).astype(np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    mixed = points * salt
    mixed ^= mixed >> np.uint64(29)
    total = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts) if len(words) else points
    return ((total * np.uint64(GOLDEN)) >> np.uint64(51)).astype(np.int64)


def inputs_of(words: list[str], model: ToxicityModel) -> np.ndarray:
    """Input vectors of distinct words."""
    rows = np.zeros((len(words), WORD_SIZE + CHAR_SIZE), np.float32)
    rows[:, :WORD_SIZE] = model.words[word_spots(words)]
    spots, owner = char_spots(words)
    if len(spots):
        starts = np.searchsorted(owner, np.arange(len(words)))
        sums = np.add.reduceat(model.chars[spots], starts, axis=0)
        rows[:, WORD_SIZE:] = sums / np.bincount(owner, minlength=len(words))[:, None]
    return rows


def window_rows(numbers: np.ndarray, pad: int) -> np.ndarray:
    """Overlapping windows over a text's word numbers, the last one ending with the text."""
    if len(numbers) <= WINDOW:
        return np.append(numbers, np.full(WINDOW - len(numbers), pad))[None, :]
    starts = np.append(np.arange(0, len(numbers) - WINDOW, STRIDE), len(numbers) - WINDOW)
    return numbers[starts[:, None] + np.arange(WINDOW)]


def _direction(projected: np.ndarray, mask: np.ndarray, model: ToxicityModel, side: int, keep: bool):
    """One direction over (time, lane, 3 hidden); ``keep`` gives what the backward pass needs."""
    steps, lanes, _ = projected.shape
    gates, candidate = model.gates[side], model.candidate[side]
    state = np.zeros((lanes, HIDDEN), np.float32)
    states = np.empty((steps, lanes, HIDDEN), np.float32)
    trace = []
    whole = mask.all(axis=1)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        both = np.tanh(0.5 * (projected[t, :, : 2 * HIDDEN] + state @ gates))
        both = 0.5 * both + 0.5
        update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
        fresh = np.tanh(projected[t, :, 2 * HIDDEN :] + (reset * state) @ candidate)
        step = update if whole[t] else update * mask[t][:, None]
        if keep:
            trace.append((t, state, update, reset, fresh))
        state = state + step * (fresh - state)
        states[t] = state
    return states, trace


def forward(table: np.ndarray, rows: np.ndarray, model: ToxicityModel, pad: int, keep: bool = False):
    """Logits of windows. ``table`` holds the projected inputs of the words, zeros for the pad in its last row."""
    steps = max(1, int((rows != pad).sum(axis=1).max()))
    numbers = np.ascontiguousarray(rows[:, :steps].T)
    mask = (numbers != pad).astype(np.float32)
    ahead, trace_a = _direction(table[numbers, : 3 * HIDDEN], mask > 0, model, 0, keep)
    back, trace_b = _direction(table[numbers, 3 * HIDDEN :], mask > 0, model, 1, keep)
    states = np.concatenate((ahead, back), axis=2)
    weight = states @ model.attention
    weight = np.exp(weight - weight.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tl,tlh->lh", weight, states)
    logits = pooled @ model.out[:-1] + model.out[-1]
    return (logits, (numbers, mask, states, weight, pooled, trace_a, trace_b)) if keep else logits


def _back_direction(trace, grads: np.ndarray, mask: np.ndarray, model: ToxicityModel, side: int):
    """Gradients of one direction by back-propagation through time."""
    gates, candidate = model.gates[side], model.candidate[side]
    inner = np.zeros((*grads.shape[:2], 3 * HIDDEN), np.float32)
    g_gates, g_candidate = np.zeros_like(gates), np.zeros_like(candidate)
    carry = np.zeros(grads.shape[1:], np.float32)
    for t, state, update, reset, fresh in reversed(trace):
        total = carry + grads[t]
        live = total * mask[t][:, None]
        d_update = live * (fresh - state) * update * (1 - update)
        d_fresh = live * update * (1 - fresh * fresh)
        through = d_fresh @ candidate.T
        d_reset = through * state * reset * (1 - reset)
        both = np.concatenate((d_update, d_reset), axis=1)
        carry = total - live * update + through * reset + both @ gates.T
        g_gates += state.T @ both
        g_candidate += (reset * state).T @ d_fresh
        inner[t] = np.concatenate((both, d_fresh), axis=1)
    return inner, g_gates, g_candidate


class _Adam:
    """Adam for whole arrays, Adagrad for touched rows of tables."""

    def __init__(self, model: ToxicityModel, rate: float, row_rate: float) -> None:
        self.rate, self.row_rate, self.steps = rate, row_rate, 0
        names = ("inputs", "bias", "gates", "candidate", "attention", "out")
        self.first = {k: np.zeros_like(getattr(model, k)) for k in names}
        self.second = {k: np.zeros_like(getattr(model, k)) for k in names}
        self.rows = {k: np.full(len(getattr(model, k)), 1e-6, np.float32) for k in ("words", "chars")}

    def dense(self, model: ToxicityModel, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            size = self.first[k] / (1 - 0.9**self.steps)
            scale = np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8
            getattr(model, k)[...] -= self.rate * size / scale

    def sparse(self, model: ToxicityModel, name: str, spots: np.ndarray, grads: np.ndarray) -> None:
        rows, place = np.unique(spots, return_inverse=True)
        total = np.zeros((len(rows), grads.shape[1]), np.float32)
        np.add.at(total, place, grads)
        self.rows[name][rows] += (total * total).mean(axis=1)
        getattr(model, name)[rows] -= self.row_rate * total / np.sqrt(self.rows[name][rows])[:, None]


def _step(model: ToxicityModel, adam: _Adam, windows: list[list[str]], labels: np.ndarray) -> float:
    """One update on one window per text."""
    vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for win in windows for w in win))}
    words, pad = list(vocabulary), len(vocabulary)
    x = inputs_of(words, model)
    table = np.vstack((x @ model.inputs + model.bias, np.zeros((1, 6 * HIDDEN), np.float32))).astype(np.float32)
    rows = np.full((len(windows), WINDOW), pad)
    for k, win in enumerate(windows):
        rows[k, : len(win)] = [vocabulary[w] for w in win]
    logits, (numbers, mask, states, weight, pooled, trace_a, trace_b) = forward(table, rows, model, pad, keep=True)
    chance = 1 / (1 + np.exp(-logits))
    d_logit = ((chance - labels) / len(labels)).astype(np.float32)
    d_pooled = d_logit[:, None] * model.out[:-1]
    d_weight = np.einsum("lh,tlh->tl", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * model.attention
    inner_a, gates_a, cand_a = _back_direction(trace_a, d_states[:, :, :HIDDEN], mask, model, 0)
    inner_b, gates_b, cand_b = _back_direction(trace_b, d_states[:, :, HIDDEN:], mask, model, 1)
    d_table = np.zeros_like(table)
    np.add.at(d_table, numbers, np.concatenate((inner_a, inner_b), axis=2))
    d_table = d_table[:-1]
    d_x = d_table @ model.inputs.T
    grads = {
        "inputs": x.T @ d_table, "bias": d_table.sum(axis=0), "gates": np.stack((gates_a, gates_b)),
        "candidate": np.stack((cand_a, cand_b)), "attention": np.einsum("tl,tlh->h", d_score, states),
        "out": np.append(d_logit @ pooled, d_logit.sum()).astype(np.float32),
    }
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    if norm > 1:
        grads = {k: g / norm for k, g in grads.items()}
    adam.dense(model, grads)
    if words:
        adam.sparse(model, "words", word_spots(words), d_x[:, :WORD_SIZE])
        spots, owner = char_spots(words)
        each = d_x[:, WORD_SIZE:] / np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        adam.sparse(model, "chars", spots, each[owner])
    return float(-np.mean(np.log(np.maximum(np.where(labels == 1, chance, 1 - chance), 1e-9))))


def text_logits(texts: list[list[str]], model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Per text the logit of its most toxic window and where that window starts; -inf for a text without words."""
    vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    pad = len(vocabulary)
    table = np.zeros((pad + 1, 6 * HIDDEN), np.float32)
    if pad:
        table[:-1] = inputs_of(list(vocabulary), model) @ model.inputs + model.bias
    owner, rows = [], []
    for number, words in enumerate(texts):
        if words:
            numbers = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
            rows.append(window_rows(numbers, pad))
            owner.append(np.full(len(rows[-1]), number))
    best, at = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    if not rows:
        return best, at
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    sizes = (rows != pad).sum(axis=1)
    logits = np.empty(len(rows), np.float32)
    order = np.argsort(sizes, kind="stable")
    for start in range(0, len(order), LANES):
        lanes = order[start : start + LANES]
        logits[lanes] = forward(table, rows[lanes], model, pad)
    first = np.searchsorted(owner, np.arange(len(texts)))
    for number in np.unique(owner):
        end = first[number + 1] if number + 1 < len(texts) else len(owner)
        own = logits[first[number] : end]
        best[number], at[number] = own.max(), int(own.argmax())
    return best, at


def _window_words(words: list[str], index: int) -> list[str]:
    if len(words) <= WINDOW:
        return words
    return words[min(index * STRIDE, len(words) - WINDOW) :][:WINDOW]


def train(texts: list[str | None], labels: list[int], rounds: int = 8, batch: int = 64, seed: int = 7) -> ToxicityModel:
    """Fit the network. A round finds every text's most toxic window as the network sees it then (a random one at
    first) and learns the text's label from it."""
    model = ToxicityModel.start(seed)
    known = [(split_words(t), y) for t, y in zip(texts, labels, strict=True)]
    known = [(w, y) for w, y in known if w]
    if len({y for _, y in known}) < 2:
        model.out[...] = 0
        model.out[-1] = 4.0 if known and known[0][1] == 1 else -4.0
        return model
    adam, draw = _Adam(model, 0.01, 0.05), np.random.default_rng(seed)
    target = np.array([y for _, y in known], np.float32)
    for number in range(rounds):
        if number < 2:
            at = [int(draw.integers(0, max(1, -(-(len(w) - WINDOW) // STRIDE) + 1))) for w, _ in known]
        else:
            at = []
            for start in range(0, len(known), 256):
                at += text_logits([w for w, _ in known[start : start + 256]], model)[1].tolist()
        chosen = [_window_words(w, k) for (w, _), k in zip(known, at, strict=True)]
        order = draw.permutation(len(known))
        adam.rate = 0.01 if number < rounds - 2 else 0.003
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            _step(model, adam, [chosen[k] for k in part], target[part])
    return model


def fit_toxicity(papers: DataFrame, ratings: DataFrame, per_class: int = 2000, rounds: int = 10) -> ToxicityModel:
    """Train on ``papers`` (paper_id, text) that ``ratings`` (paper_id, toxic 0/1) marks.

    The network sees a bounded sample: of each class the ``per_class`` ids that come first by a hash; whole texts.
    Where that changes the classes' shares, the constant of the fitted network is moved by the logarithm of the change,
    so that scores are chances among all rated papers at every size. Rows with a null id or mark teach nothing. Several
    ratings of a paper count by the largest.
    """
    marks = ratings.where("paper_id IS NOT NULL AND toxic IN (0, 1)").groupBy("paper_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    by = [F.xxhash64(F.col("paper_id").cast("string")), "paper_id"]
    chosen = [marks.where(F.col("toxic") == y).orderBy(*by).limit(per_class) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class ids
    # A repeated id teaches one of its texts, so the sample stays within its bound.
    rows = papers.select("paper_id", "text").join(few, "paper_id").groupBy("paper_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.toPandas().sort_values("paper_id", kind="stable")
    model = train(found["text"].tolist(), [int(y) for y in found["toxic"]], rounds)
    if len(sizes) == 2:
        taken = {y: min(n, per_class) for y, n in sizes.items()}
        model.out[-1] += np.log(sizes[1] / taken[1]) - np.log(sizes[0] / taken[0])
    return model


def score_toxicity(papers: DataFrame, model: ToxicityModel, carry: Sequence[str] = ()) -> DataFrame:
    """Toxicity of every paper.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``, which come back as they
    are. Returns one row per row: paper_id, score (0 to 1: the
    largest over all windows of ``WINDOW`` words, which overlap by half; 0.0 for a text that is null or has no word),
    window_no (int, which window that is, from 0; null without words). Whole texts are read.
    """
    kind = papers.schema["paper_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            best, at = text_logits([split_words(x) for x in batch.column("text").to_pylist()], model)
            empty = np.isneginf(best)
            score = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(best, -60, 60))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), pa.array(score), pa.array(at.astype(np.int32), mask=empty),
                 *[batch.column(c) for c in carry]],
                ["paper_id", "score", "window_no", *carry],
            )

    out = T.StructType([
        T.StructField("paper_id", kind), T.StructField("score", T.DoubleType()), T.StructField("window_no", T.IntegerType()),
        *[papers.schema[c] for c in carry],
    ])
    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)
