"""Alignment of two tokenizers over papers: where their tokens end together, and which ids go together most.

A token's end is its offset in the text's bytes. The ends that both tokenizers have cut a text into groups of tokens; the
tokens that end there are linked. Counts of linked ids over all papers say which links are usual.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import stored, text_batches

#: Bytes of text that are encoded at a time.
SLICE = 250_000
#: Where neither tokenizer has a token across: before a blank or a line break between two visible characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Parts that may follow each other in one text: it is cut between any two of them.
JOINS = re.compile(r"[ \n]\S(?:.*\S)?\Z", re.DOTALL)
#: Aligned parts of texts after which a task lets go of those it has not met since it last did, and characters of the
#: longest one it keeps.
KEPT, KEPT_LETTERS = 100_000, 64
#: Links in a block of papers; a block's distinct id pairs meet their counts at once.
BLOCK_LINKS = 800_000


class ByteLevel:
    """A byte-level BPE tokenizer (``tokenizers`` JSON); special tokens inside texts are plain text. ``cuts`` says that a
    text's parts (:data:`CUT`) are encoded each for itself, which the usual pattern of words sees to."""

    def __init__(self, model: str) -> None:
        self.model, spec = model, json.loads(model)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not spec.get("normalizer")
            and all(x["special"] for x in spec.get("added_tokens", []))
        )

    def open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.model)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, number in entries.items():
            known = all(c in letters for c in entry)
            self.table[number] = bytes(letters[c] for c in entry) if known else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the
    next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Pieces:
    """A SentencePiece model, which puts a blank before a text itself. ``cuts`` as for :class:`ByteLevel`: no piece has
    a mark behind another character or a line break in it, line breaks are pieces of bytes, and texts are taken as they
    are."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        self.model, proto = model, sentencepiece_model_pb2.ModelProto.FromString(model)
        rule = proto.normalizer_spec
        self.cuts = (
            not any("▁" in x.piece.lstrip("▁") or "\n" in x.piece for x in proto.pieces) and rule.add_dummy_prefix
            and proto.trainer_spec.byte_fallback
            and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces
        )

    def open(self) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=self.model)
        self.table = [
            bytes([int(piece[3:5], 16)]) if self.processor.is_byte(n) else piece.replace("▁", " ").encode()
            for n in range(self.processor.get_piece_size())
            for piece in [self.processor.id_to_piece(n)]
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank, which is the one the model puts there, or with a line break: before that
        the model puts a mark, which is a piece of its own and no part of the text."""
        bare = self.processor.encode([x[1:] if x[:1] == " " else x for x in texts], num_threads=1)
        return [ids if x[:1] == " " else ids[1:] for x, ids in zip(texts, bare, strict=True)]


def load_byte_level(file: str) -> ByteLevel:
    """Read a byte-level BPE file on the driver; it travels with the tasks."""
    with open(file, encoding="utf-8") as source:
        model = source.read()
    if json.loads(model)["model"]["type"] != "BPE":
        raise ValueError("not a BPE tokenizer")
    return ByteLevel(model)


def load_pieces(file: str) -> Pieces:
    """Read a SentencePiece model on the driver; it travels with the tasks."""
    with open(file, "rb") as source:
        return Pieces(source.read())


def ends_of(ids: Sequence[int], lengths: Sequence[int]) -> list[int]:
    """Byte offset at which each token ends."""
    return list(accumulate(map(lengths.__getitem__, ids)))


def align(
    a: Sequence[int], b: Sequence[int], ends_a: list[int], ends_b: list[int]
) -> tuple[list[int], list[int], list[int], list[int]]:
    """Where groups end among the tokens of A and of B, and the linked ids of A and of B, one entry a link.

    An end's index is that of the last token that ends there, so tokens without bytes belong to the group before them,
    and all that end there are linked.
    """
    index_a, index_b = dict(zip(ends_a, range(1, len(a) + 1))), dict(zip(ends_b, range(1, len(b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    cuts_a, cuts_b = [index_a[x] for x in common], [index_b[x] for x in common]
    if len(index_a) == len(a) and len(index_b) == len(b):  # every token has bytes: one of each ends at an end
        return cuts_a, cuts_b, [a[p - 1] for p in cuts_a], [b[q - 1] for q in cuts_b]
    links_a, links_b, i, j = [], [], 0, 0
    for end, p, q in zip(common, cuts_a, cuts_b, strict=True):
        there_a = [x for x, own in zip(a[i:p], ends_a[i:p]) if own == end]
        there_b = [x for x, own in zip(b[j:q], ends_b[j:q]) if own == end]
        for x in there_a:
            links_a += [x] * len(there_b)
            links_b += there_b
        i, j = p, q
    return cuts_a, cuts_b, links_a, links_b


def group_texts(names_a: list[str], names_b: list[str], cuts_a: list[int], cuts_b: list[int]) -> list[str]:
    """``a1,a2|b1``: the ids of A and of B up to each cut."""
    return [
        f"{names_a[i]}|{names_b[j]}" if p - i == 1 == q - j else f"{','.join(names_a[i:p])}|{','.join(names_b[j:q])}"
        for i, p, j, q in zip([0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b)
    ]


class Aligner:
    """Aligns texts part by part, each distinct part once as long as it is kept.

    A part's value is its groups as text, its links as 8 bytes each, and its numbers of tokens of A, of B and of groups;
    None if the bytes of either tokenizer's tokens are not those of the part.
    """

    def __init__(self, first: ByteLevel, second: Pieces) -> None:
        self.first, self.second, self.kept, self.older = first, second, {}, {}
        first.open()
        second.open()
        self.sizes = [len(x) for x in first.table], [len(x) for x in second.table]
        self.names = [list(map(str, range(len(x)))) for x in self.sizes]
        self.cuts = first.cuts and second.cuts
        self.split = CUT.split if self.cuts else lambda text: [text]
        # Ids with what may stand behind them: those of A before another one and at the end of A's side of a group, those
        # of B before another one, at the end of a group and at the end of a part.
        ends = [(self.names[0], ",|"), (self.names[1], [",", ";", ""])]
        self.spelt = pa.array([name + end for names, behind in ends for end in behind for name in names], pa.string())

    # Texts get their blank in front here, so every part begins with a blank or a line break.

    def parts(self, texts: list[str]) -> list[list[tuple | None]]:
        """For each text the values of its parts in order; none for an empty text."""
        cut = [self.split(" " + x) if x else [] for x in texts]
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        new: set[str] = set()
        for parts in cut:
            new.update(parts)
        new = {x for x in new if x not in self.kept}
        self.kept.update([(x, self.older[x]) for x in new if x in self.older])
        fresh = [x for x in new if x not in self.older]
        joins = [self.cuts and JOINS.match(x) is not None for x in fresh]
        for parts in (list(compress(fresh, joins)), [x for x, ok in zip(fresh, joins, strict=True) if not ok]):
            values = self._together(parts) if self.cuts and parts and JOINS.match(parts[0]) else None
            if values is None:
                values = self._aligned(parts, self.first.encode(parts), self.second.encode(parts))
            self.kept.update(zip(parts, values, strict=True))
        found = [list(map(self.kept.__getitem__, parts)) for parts in cut]
        for part in fresh:
            if len(part) > KEPT_LETTERS:
                del self.kept[part]
        return found

    def _gives_back(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.first.table.__getitem__, a)) == data == b"".join(map(self.second.table.__getitem__, b))

    def _together(self, parts: list[str]) -> list[tuple | None] | None:
        """Values of parts that follow each other in one text (:data:`JOINS`). None if either tokenizer does not give the
        text back, has a token without bytes in it, or one across two parts: :meth:`_aligned` sees to these."""
        data = list(map(str.encode, parts))
        first, second = self.first.encode(["".join(parts)])[0], list(chain.from_iterable(self.second.encode(parts)))
        if not self._gives_back(b"".join(data), first, second):
            return None
        a, b = np.array(first), np.array(second)
        lengths_a, lengths_b = (np.array(x)[y] for x, y in zip(self.sizes, (a, b), strict=True))
        ends_a, ends_b, ends = np.cumsum(lengths_a), np.cumsum(lengths_b), np.cumsum(list(map(len, data)))
        ending = np.zeros((2, ends[-1] + 1), bool)
        ending[0, ends_a], ending[1, ends_b] = True, True
        common = np.flatnonzero(ending[0] & ending[1])
        last = np.searchsorted(common, ends)  # the last group of each part
        if not (lengths_a.all() and lengths_b.all() and np.array_equal(common[last], ends)):
            return None
        cuts_a, cuts_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        links = (a[cuts_a - 1] << 32 | b[cuts_b - 1]).astype(np.int64).tobytes()
        # The ids of a group stand behind those of the groups before it, A's before B's.
        spelt, size_a, size_b = np.empty(len(a) + len(b), np.int64), len(self.sizes[0]), len(self.sizes[1])
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        at_a += np.append(0, cuts_b)[np.searchsorted(cuts_a, at_a, "right")]
        at_b += cuts_a[np.searchsorted(cuts_b, at_b, "right")]
        spelt[at_a], spelt[at_b] = a, b + 2 * size_a
        spelt[at_a[cuts_a - 1]] += size_a
        spelt[at_b[cuts_b - 1]] += size_b
        spelt[at_b[cuts_b[last] - 1]] += size_b
        text = self.spelt.take(pa.array(spelt))
        starts = np.frombuffer(text.buffers()[1], np.int32)[np.append(0, cuts_a[last] + cuts_b[last])].tolist()
        letters = text.buffers()[2].to_pybytes().decode()
        counts = [np.diff(x, prepend=0).tolist() for x in (cuts_a[last], cuts_b[last], last + 1)]
        groups = np.append(0, 8 * (last + 1)).tolist()
        return [
            (letters[i:j], links[p:q], *own)
            for (i, j), (p, q), *own in zip(pairwise(starts), pairwise(groups), *counts, strict=True)
        ]

    def _aligned(self, parts: list[str], first: list[list[int]], second: list[list[int]]) -> list[tuple | None]:
        """Values of some parts. One after the other they are one text, in which every part's end is a common end."""
        if not parts:
            return []
        a, b = list(chain.from_iterable(first)), list(chain.from_iterable(second))
        if not self._gives_back("".join(parts).encode(), a, b):
            good = [self._gives_back(p.encode(), x, y) for p, x, y in zip(parts, first, second, strict=True)]
            rest = iter(self._aligned(*(list(compress(x, good)) for x in (parts, first, second))) if any(good) else ())
            return [next(rest) if ok else None for ok in good]
        cuts_a, cuts_b, to_a, to_b = align(a, b, ends_of(a, self.sizes[0]), ends_of(b, self.sizes[1]))
        if len(to_a) != len(cuts_a):  # tokens without bytes: which part they belong to is seen in it alone
            if len(parts) > 1:
                return [self._aligned([p], [x], [y])[0] for p, x, y in zip(parts, first, second, strict=True)]
        names_a, names_b = list(map(self.names[0].__getitem__, a)), list(map(self.names[1].__getitem__, b))
        groups = group_texts(names_a, names_b, cuts_a, cuts_b)
        links = array("q", [x << 32 | y for x, y in zip(to_a, to_b)]).tobytes()
        if len(parts) == 1:
            return [(";".join(groups), links, len(a), len(b), len(groups))]
        ends = np.searchsorted(cuts_a, np.cumsum([len(x) for x in first])) + 1
        return [
            (";".join(groups[i:j]), links[8 * i : 8 * j], len(x), len(y), j - i)
            for i, j, x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), first, second, strict=True)
        ]


class _Block:
    """Papers whose links are numbered together: places among the block's distinct pairs, sorted."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch, links: list[np.ndarray]) -> None:
        self.parts.append(rows)
        self.links += links
        self.size += sum(map(len, links))

    def batches(self, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows, each with its block; the first one has the block's pairs and how often each is linked there."""
        pairs, places = np.unique(np.concatenate(self.links), return_inverse=True)
        times = np.bincount(places, minlength=len(pairs))
        places = places.astype(np.int32)
        ends = np.cumsum([0, *map(len, self.links)])
        at = 0
        for part in self.parts:
            n = part.num_rows
            own = pa.array(ends[at : at + n + 1] - ends[at], pa.int32())
            head = pa.array([0] + [0 if at else len(pairs)] * n, pa.int32())
            missing = pa.array([bool(at) or k > 0 for k in range(n)])
            held = [pa.ListArray.from_arrays(head, pa.array(x if not at else x[:0], pa.int64()), mask=missing) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([number] * n, pa.int64()), *held,
                 pa.ListArray.from_arrays(own, pa.array(places[ends[at] : ends[at + n]]))],
                names,
            )
            at += n


def align_papers(papers: DataFrame, first: ByteLevel, second: Pieces, carry: Sequence[str] = ()) -> DataFrame:
    """Where the tokens of two tokenizers end together, for whole papers.

    ``papers`` has paper_id and text; other columns are ignored but for those named in ``carry``. ``first`` (A) encodes a
    blank and the text, ``second`` (B) the text, before which it puts a blank itself. Returns one row per row: paper_id,
    n_a, n_b, n_groups (long), groups (string ``a1,a2|b1;a3|b2,b3``: ids of A and of B between common ends), the carried
    columns, and the links, which are all pairs of tokens whose byte ranges end together, in the form that
    :func:`links_of` spells out and :func:`score_links` counts: block, pairs and times (on the first row of a block: its
    distinct pairs, as id of A times 2**32 plus id of B, and their links), places (of the row's links among the pairs).

    Null and empty texts, and texts that the bytes of either tokenizer's tokens do not give back (a text with U+2581, for
    B), have no tokens: zeros, '' and no links. Repeated rows and rows without an id are rows.
    """
    names = ["paper_id", "n_a", "n_b", "n_groups", "groups", *carry, "block", "pairs", "times", "places"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        # The number of a block is that of its task and its own there; once the rows are written, a block keeps it.
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in text_batches(batches, SLICE):
            counts, groups, links = [], [], []
            for parts in aligner.parts(batch.column("text").to_pylist()):
                if None in parts:
                    parts = []
                texts, pairs, *numbers = zip(*parts, strict=True) if parts else ((),) * 5
                groups.append(";".join(texts))
                links.append(np.frombuffer(b"".join(pairs), np.int64))
                counts.append(list(map(sum, numbers)))
            n_a, n_b, n_groups = (pa.array(x, pa.int64()) for x in zip(*counts, strict=True))
            rows = pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), n_a, n_b, n_groups, pa.array(groups, pa.string()), *[batch.column(c) for c in carry]],
                names[:-4],
            )
            block.add(rows, links)
            if block.size >= BLOCK_LINKS:
                yield from block.batches(number, names)
                number, block = number + 1, _Block()
        if block.parts:
            yield from block.batches(number, names)

    longs = T.ArrayType(T.LongType(), False)
    out = T.StructType([
        papers.schema["paper_id"], *[T.StructField(x, T.LongType()) for x in ("n_a", "n_b", "n_groups")],
        T.StructField("groups", T.StringType()), *[papers.schema[c] for c in carry], T.StructField("block", T.LongType()),
        T.StructField("pairs", longs), T.StructField("times", longs), T.StructField("places", T.ArrayType(T.IntegerType(), False)),
    ])
    return papers.select(*dict.fromkeys(["paper_id", "text", *carry])).mapInArrow(task, out)


def links_of(aligned: DataFrame) -> DataFrame:
    """The links of :func:`align_papers` spelt out: its columns with links (array of struct of a and b, in text order) in
    place of the four that hold them."""
    blocks = stored(aligned)
    pairs = blocks.where("pairs IS NOT NULL").select("block", F.col("pairs").alias("_pairs"))
    pair = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("a"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("b"))
    held = blocks.join(pairs, "block").withColumn(
        "links", F.transform("places", lambda at: pair(F.element_at("_pairs", at + 1)))
    )
    return held.drop("block", "pairs", "times", "places", "_pairs")


def _scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of a block with the sums over their links of (count, whether it is the highest of its id of B)."""
    order = np.argsort(right.column("pair").to_numpy())
    count = right.column("count").to_numpy()[order]
    best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    places = [x.values.to_numpy() for x in left.column("places")]
    return pa.table({
        "row": left.column("row"), "n_links": pa.array([len(x) for x in places], pa.int64()),
        "n_best": pa.array([int(best[x].sum()) for x in places], pa.int64()),
        "count_sum": pa.array([int(count[x].sum()) for x in places], pa.int64()),
    })


def score_links(aligned: DataFrame) -> DataFrame:
    """How usual the links of each paper are over all papers.

    ``aligned`` has the links of :func:`align_papers`. Returns its other columns and n_links, n_best (links whose
    count is the highest of all pairs with their id of B, ties included) and count_sum (sum of the links' counts), all
    long; the count of a pair of ids is how many links of all rows hold it. A row without links has zeros.

    Papers are put in blocks of a bounded number of links, and links are numbered inside their block. So one row per
    block and distinct pair meets the counts and comes back, not one per link.
    """
    others = [c for c in aligned.columns if c not in ("block", "pairs", "times", "places")]
    row = T.StructField("row", aligned.select(F.struct(*others).alias("row")).schema["row"].dataType)
    blocks = stored(aligned.select("block", "pairs", "times", "places", F.struct(*others).alias("row")))
    held = stored(
        blocks.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    )
    counts = stored(held.groupBy("pair").agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    highest = counts.groupBy(second.alias("second")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("second", second).join(highest, "second").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    met = held.select("block", "pair").join(known, "pair")
    full = blocks.where("size(places) > 0").select("block", "places", "row")
    out = T.StructType([row, *[T.StructField(x, T.LongType()) for x in ("n_links", "n_best", "count_sum")]])
    scored = full.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_scored, out)
    zero = F.lit(0).cast("long")
    empty = blocks.where("size(places) = 0").select(
        "row", zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum")
    )
    return scored.unionByName(empty).select("row.*", "n_links", "n_best", "count_sum")
