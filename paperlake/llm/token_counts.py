"""Token counts of papers without their tokens: a count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlake.llm.common import text_batches
from paperlake.llm.pieces import MEMO_WORDS, Vocabulary, WordCutter, fits


class PieceCounts(dict):
    """Word (of a ``WordCutter``) -> number of pieces, computed once per distinct word.

    The automaton gives, at every character, all pieces that end there, the longest first. The best score (or, for a BPE
    model, whether the piece fits the one before it) and the number of pieces are all that is carried along; a tie goes
    to the piece that starts first, as in the tokenizer.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            if not vocabulary.bpe or len(piece) == 1 or piece in vocabulary.split:
                self.automaton.add_word(piece, (len(piece), score, piece))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = sum(map(self.count, WordCutter.parts(word)))
        return value

    def count(self, word: str) -> int:
        vocabulary, size = self.vocabulary, len(word)
        single, bpe = vocabulary.scores, vocabulary.bpe
        ending: list[list] = [[] for _ in range(size)]
        if len(self.automaton):
            for end, match in self.automaton.iter(word):
                ending[end].append(match)
        best = [0.0] * (size + 1)
        pieces = [0] * (size + 1)
        last = [""] * (size + 1)
        runs = [False] * (size + 1)  # the best path ends with unknown characters that are one piece
        for end in range(1, size + 1):
            letter = word[end - 1]
            found = False
            for length, score, piece in ending[end - 1]:
                begin = end - length
                if bpe:
                    if not last[begin] or fits(last[begin], piece, vocabulary):
                        pieces[end], last[end], found = pieces[begin] + 1, piece, True
                        break
                elif not found or best[begin] + score > best[end]:
                    best[end], pieces[end], found = best[begin] + score, pieces[begin] + 1, True
            if letter not in single:
                total = best[end - 1] + vocabulary.unknown_score
                if not found or (not bpe and total > best[end]):
                    added = len(letter.encode()) if vocabulary.byte_ids else 0 if runs[end - 1] else 1
                    best[end], pieces[end], last[end] = total, pieces[end - 1] + added, letter
                    runs[end] = True
        return pieces[size]


def count_tokens(papers: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ()) -> DataFrame:
    """How many pieces the SentencePiece model of ``vocabulary`` makes of each whole paper.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``. Returns one row per
    row: paper_id, n_tokens (long; 0 for a null or empty text) and the carried columns.
    """
    out = T.StructType([
        papers.schema["paper_id"], T.StructField("n_tokens", T.LongType(), False), *[papers.schema[c] for c in carry],
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = WordCutter(vocabulary), PieceCounts(vocabulary)
        for batch in text_batches(batches):
            totals = [sum(map(counts.__getitem__, cutter.words(x))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), pa.array(np.array(totals, np.int64)), *[batch.column(c) for c in carry]],
                ["paper_id", "n_tokens", *carry],
            )

    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)
