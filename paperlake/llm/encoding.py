"""SentencePiece encoding of papers by a shared-prefix Viterbi, and decoding.

The distinct marked words of a batch are sorted, which lays them out as a depth-first walk of their trie: two words that
follow each other share the path down to their common prefix, and the forward states along it are kept on a stack.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlake.llm.common import text_batches
from paperlake.llm.pieces import FIRST_STATE, MARK, MEMO_LETTERS, MEMO_WORDS, Vocabulary, WordCutter, path_ids, step_states


#: Bytes of text whose distinct words are walked together: the more, the more prefixes they share.
SLICE = 2_000_000


def walk(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """(word, piece ids as int32) of distinct words, visiting their trie depth first."""
    stack: list = [FIRST_STATE]
    last = ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            shared += 1
        del stack[shared + 1 :]
        stack += [None] * (len(word) - shared)
        step_states(word, shared, stack, vocabulary)
        yield word, path_ids(stack)
        last = word


class Encoder:
    """Encodes texts; keeps the ids of words it has seen, as bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.cutter, self.memo = vocabulary, WordCutter(vocabulary), {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.cutter.words(x) for x in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.memo)
        parts = {w: self.cutter.parts(w) for w in new}
        ids = dict(walk(list({x for p in parts.values() for x in p}), self.vocabulary))
        for word, own in parts.items():
            self.memo[word] = b"".join([ids[x] for x in own])
        found = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in split]
        for word in parts:
            if len(word) > MEMO_LETTERS:
                del self.memo[word]
        return found


class Decoder:
    """Turns piece ids into text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        parts = {n: p.replace(MARK, " ").encode() for p, n in vocabulary.ids.items()}
        parts |= {n: bytes([b]) for b, n in enumerate(vocabulary.byte_ids)} | {vocabulary.unknown: " ⁇ ".encode()}
        self.table = [parts.get(n, b"") for n in range(max(parts, default=0) + 1)]
        self.dummy_prefix = vocabulary.dummy_prefix

    def decode(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self.table))].tolist()
        text = b"".join(map(self.table.__getitem__, known)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


_IDS = T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False), False)


def encode_papers(papers: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ()) -> DataFrame:
    """Piece ids of whole papers, as the SentencePiece model of ``vocabulary`` encodes them.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``. Returns one row per
    row: paper_id, piece_ids (array of int; empty for a null or empty text) and the carried columns. A word without a
    piece for some character gets the pieces of its bytes, or the unknown id.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in text_batches(batches, SLICE):
            ids = _lists(encoder.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), ids, *[batch.column(c) for c in carry]], ["paper_id", "piece_ids", *carry]
            )

    out = T.StructType([papers.schema["paper_id"], _IDS, *[papers.schema[c] for c in carry]])
    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)


def decode_papers(encoded: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ()) -> DataFrame:
    """Texts of piece ids: the inverse of :func:`encode_papers`.

    ``encoded`` has paper_id and piece_ids (null counts as empty). Returns one row per row: paper_id, decoded (empty for
    no ids; bytes that are no UTF-8 become U+FFFD, unknown ids U+2047 between blanks, ids outside the model nothing) and
    the carried columns. A text comes back as it was, except that a mark (U+2581) in it comes back as a blank.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            lists = [x.values for x in batch.column("piece_ids")]
            texts = ["" if x is None else decoder.decode(x.to_numpy(zero_copy_only=False)) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), pa.array(texts, pa.string()), *[batch.column(c) for c in carry]],
                ["paper_id", "decoded", *carry],
            )

    decoded = T.StructField("decoded", T.StringType(), False)
    out = T.StructType([encoded.schema["paper_id"], decoded, *[encoded.schema[c] for c in carry]])
    return encoded.select(*dict.fromkeys(["paper_id", "piece_ids", *carry])).mapInArrow(task, out)


def round_trips(papers: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ()) -> DataFrame:
    """Encode papers and decode them again: paper_id, piece_ids, exact (boolean: the text came back), and the carried
    columns.

    ``papers`` and the rows are as in :func:`encode_papers`. Both ways are taken in one task, which reads a text once.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in text_batches(batches, SLICE):
            texts = batch.column("text").to_pylist()
            rows = encoder.encode(texts)
            exact = [decoder.decode(ids) == (text or "").replace(MARK, " ") for ids, text in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), _lists(rows), pa.array(exact, pa.bool_()), *[batch.column(c) for c in carry]],
                ["paper_id", "piece_ids", "exact", *carry],
            )

    exact = T.StructField("exact", T.BooleanType(), False)
    out = T.StructType([papers.schema["paper_id"], _IDS, exact, *[papers.schema[c] for c in carry]])
    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)
