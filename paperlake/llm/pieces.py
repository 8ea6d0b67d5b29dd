"""SentencePiece vocabularies as lattices: which piece may follow which, and what the best path costs.

A model file says how its pieces are put together. For a unigram model the best segmentation of a word is the path of
the largest sum of scores. For a BPE model it is the one path on which every two neighbours *fit*: encoding their joined
text gives back the two of them. Both are found left to right, and what is known about a prefix holds for every word
that starts with it; the two operators that segment words build on that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"
#: Entries after which tables of pairs and of words are started anew, and letters of the longest word that is kept; the
#: tables only save work.
MEMO_PAIRS, MEMO_WORDS, MEMO_LETTERS = 300_000, 250_000, 64


@dataclass
class Vocabulary:
    """Pieces of a model that can come out of encoding, and its constants."""

    bpe: bool
    ids: dict[str, int]
    scores: dict[str, float]
    endings: dict[str, bytes]  # every ending of a piece: its id in 4 bytes if encoding can give it, else nothing
    unknown: int
    byte_ids: list[int]  # 256 ids, or empty where the model has no byte pieces
    unknown_score: float
    dummy_prefix: bool
    plain: bool  # text is taken as it is: no normalisation, no white space removed
    split: dict[str, tuple[str, str]] = field(default_factory=dict)  # BPE: how a piece was merged last
    fits_memo: dict[tuple[str, str], bool] = field(default_factory=dict)


def merge_all(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """BPE by its definition: join the neighbours whose joined piece has the best score, the leftmost first."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for k in range(len(symbols) - 1):
            score = scores.get(symbols[k] + symbols[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def _last_merge(piece: str, scores: dict[str, float]) -> tuple[str, str] | None:
    """The two parts whose join ends the encoding of ``piece``, or None if encoding it gives several pieces."""
    symbols = list(piece)
    while len(symbols) > 1:
        options = [(-scores[j], k) for k in range(len(symbols) - 1) if (j := symbols[k] + symbols[k + 1]) in scores]
        if not options:
            return None
        _, at = min(options)
        if len(symbols) == 2:
            return symbols[0], symbols[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return None


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a SentencePiece ``.model`` file (unigram or BPE) on the driver."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(model_file, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    spec = proto.trainer_spec
    if spec.model_type not in (spec.UNIGRAM, spec.BPE):
        raise ValueError("only unigram and BPE models are segmented here")
    processor = SentencePieceProcessor(model_file=model_file)
    size = processor.get_piece_size()
    ids, scores, byte_ids = {}, {}, {}
    for number in range(size):
        piece = processor.id_to_piece(number)
        if processor.is_byte(number):
            byte_ids[int(piece[3:5], 16)] = number
        elif not (processor.is_control(number) or processor.is_unknown(number) or processor.is_unused(number)):
            ids[piece], scores[piece] = number, processor.get_score(number)
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("pieces go across words; words of this model cannot be segmented one by one")
    normal = proto.normalizer_spec
    vocabulary = Vocabulary(
        bpe=spec.model_type == spec.BPE, ids=ids, scores=scores, endings={},
        unknown=processor.unk_id(), byte_ids=[byte_ids[k] for k in range(256)] if len(byte_ids) == 256 else [],
        unknown_score=min(scores.values(), default=0.0) - 10.0, dummy_prefix=normal.add_dummy_prefix,
        plain=not normal.precompiled_charsmap and not normal.remove_extra_whitespaces,
    )
    if not vocabulary.plain:
        raise ValueError("models that normalise their input are not read here; normalise the texts before")
    if vocabulary.bpe:
        vocabulary.split = {p: m for p in ids if len(p) > 1 and (m := _last_merge(p, scores)) is not None}
    for piece in ids:
        for cut in range(len(piece)):
            vocabulary.endings.setdefault(piece[cut:], b"")
        if len(piece) == 1 or not vocabulary.bpe or piece in vocabulary.split:
            vocabulary.endings[piece] = ids[piece].to_bytes(4, "little")
    return vocabulary


def fits(left: str, right: str, vocabulary: Vocabulary) -> bool:
    """BPE: whether encoding ``left + right`` gives these two pieces.

    Both sides are taken apart from the border outwards, latest merge first. If the two symbols that meet there have a
    joined piece that would be merged before the next one of either side, the border does not hold.
    """
    key = (left, right)
    known = vocabulary.fits_memo.get(key)
    if known is None:
        if len(vocabulary.fits_memo) >= MEMO_PAIRS:
            vocabulary.fits_memo.clear()
        known = vocabulary.fits_memo[key] = _fits(left, right, vocabulary)
    return known


def _fits(left: str, right: str, vocabulary: Vocabulary) -> bool:
    scores, split = vocabulary.scores, vocabulary.split
    # The border symbols' own next merges: when a side's symbol disappears into a larger one. None: never.
    ends_left = ends_right = None
    while True:
        joined = scores.get(left + right)
        if joined is not None:
            # A merge further left wins a tie, so the left side's may come at the same score, the right side's may not.
            before_left = ends_left is None or joined > ends_left
            before_right = ends_right is None or joined >= ends_right
            if before_left and before_right:
                return False
        a, b = split.get(left), split.get(right)
        if a is None and b is None:
            return True
        # Go back in time: undo the later of the two sides' last merges (at equal scores, the right side's).
        if b is None or (a is not None and scores[left] < scores[right]):
            ends_left, left = scores[left], a[1]
        else:
            ends_right, right = scores[right], b[0]


def cuts_lines(vocabulary: Vocabulary) -> bool:
    """Whether a text can be cut at line breaks: one that is in no piece stands alone on every path, and where bytes are
    pieces it does not join other unknown characters."""
    return bool(vocabulary.byte_ids) and not any("\n" in p for p in vocabulary.ids)


def word_pattern(vocabulary: Vocabulary) -> re.Pattern[str]:
    """Cuts a spaced text into marked words, and lines where that can be done."""
    line = "\n" if cuts_lines(vocabulary) else ""
    return re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\n" if line else ""))


def spaced(text: str, vocabulary: Vocabulary) -> str:
    """The text as the model sees it: blanks as marks, and one in front. Empty stays empty."""
    return (MARK if vocabulary.dummy_prefix else "") + text.replace(" ", MARK) if text else ""


class WordCutter:
    """Cuts texts into words, and says what the lattice reads for a word.

    A word is kept without its mark. One that starts a further line is kept behind the line break, which stands alone on
    every path, and has no mark. Runs of blanks are pieces of their own kind: texts with such runs are cut by the
    pattern, and their words are kept with their marks, behind a blank.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pattern = vocabulary, word_pattern(vocabulary)
        self.by_blanks = vocabulary.dummy_prefix and cuts_lines(vocabulary)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.by_blanks or "  " in text or text[0] == " ":
            return [" " + w for w in self.pattern.findall(spaced(text, self.vocabulary))]
        first, *rest = text.split("\n")
        words = first.split(" ")
        for line in rest:
            words += ("\n" + line).split(" ")
        return words

    @staticmethod
    def parts(word: str) -> list[str]:
        if word[:1] == " ":
            return [word[1:]]
        return ["\n", word[1:]] if word[:1] == "\n" else [MARK + word]


def unknown_code(letter: str, last: str, vocabulary: Vocabulary) -> bytes:
    """Ids for a character that is no piece: those of its bytes, or the unknown id. Neighbouring unknown characters are
    one unknown piece in models without byte pieces."""
    if vocabulary.byte_ids:
        return b"".join([vocabulary.byte_ids[b].to_bytes(4, "little") for b in letter.encode("utf-8")])
    return b"" if last and last not in vocabulary.ids else vocabulary.unknown.to_bytes(4, "little")


#: State of an empty prefix: score of its best path, its last piece or character, the ids of that as 4 bytes each, and
#: where it begins. The path itself is found by going back from piece to piece.
FIRST_STATE = (0.0, "", b"", 0)


def path_ids(states: list) -> bytes:
    """Ids of the best path to the last state."""
    codes, at = [], len(states) - 1
    while at:
        _, _, code, begin = states[at]
        codes.append(code)
        at = begin
    codes.reverse()
    return b"".join(codes)


def step_states(word: str, start: int, states: list, vocabulary: Vocabulary) -> None:
    """Extend forward states over ``word`` from position ``start`` on.

    ``states[i]`` is that of the best path over the first i characters; those before ``start`` hold for this word too.
    Ties go to the longest last piece; the library, which adds single precision numbers from the start of the text on,
    may choose another of the paths that tie. At every end, longer and longer endings are tried for as long as any piece
    ends like that.
    """
    endings, scores, known = vocabulary.endings, vocabulary.scores, vocabulary.fits_memo
    for end in range(start + 1, len(word) + 1):
        best = None
        begin = end - 1
        piece = word[begin]
        code = endings.get(piece)
        if vocabulary.bpe:
            while True:
                if code or begin == end - 1:
                    last = states[begin]
                    if last is not None:
                        fit = not last[1] or known.get((last[1], piece))
                        if fit is None:
                            fit = fits(last[1], piece, vocabulary)
                        if fit:
                            best = (0.0, piece, code or unknown_code(piece, last[1], vocabulary), begin)
                            break
                if code is None or not begin:
                    break
                begin -= 1
                piece = word[begin:end]
                code = endings.get(piece)
        else:
            last = states[begin]
            own = code or unknown_code(piece, last[1], vocabulary)
            best = (last[0] + scores.get(piece, vocabulary.unknown_score), piece, own, begin)
            while code is not None and begin:
                begin -= 1
                piece = word[begin:end]
                code = endings.get(piece)
                if code:
                    total = states[begin][0] + scores[piece]
                    if total >= best[0]:
                        best = (total, piece, code, begin)
        states[end] = best
