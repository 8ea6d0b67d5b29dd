"""Benchmark decontamination: papers that hold a question of a card set, also with other numbers, names or units.

Texts become templates: numbers, names and units are typed placeholders, other words are themselves. The hashed windows of
papers' template words are joined with those of the cards' fronts, and what stands in the placeholders has to agree: one
value of a card is one value in the paper. Copies are also looked for in the plain words, without case and punctuation:
a long run of a card's words is a hit whatever share of the card it is. A sieve of fixed size keeps windows that are in
no card out of the join.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperlake.llm.common import in_sieve, maybe_among, row_key, sieve_of, stored, text_batches
from paperlake.llm.shingles import GOLDEN, mix, windows

# Measures that count as units, and words that count as numbers.
UNITS = frozenset((
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre",
    "metres", "mg", "g", "kg", "gram", "grams", "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter",
    "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent", "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts", "byte", "bytes",
))
NUMBER_WORDS = frozenset((
    "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "thousand", "million",
))
NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*[%€$£]?")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = re.compile(r"[\W_]+")
ASCII_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
ENDS = (".", "!", "?", ":", ";")

WORD, NUMERIC, UNIT, CAPITAL = range(4)
ENDS_BIT, SKIP_BIT = 4, 8
LOW_BITS = np.uint64(15)

#: Distinct tokens after which their table is started anew; it only saves work.
MEMO_TOKENS = 100_000
#: Bits of the sieve of the cards' windows, whatever their number: 4 MB.
SIEVE_BITS = 1 << 25
#: The two kinds of windows: of template words, and of plain words.
TEMPLATE, RUN = 0, 1


class Tokens(dict):
    """Raw token -> its place in ``packed`` and ``plain``, computed once per distinct token.

    ``packed`` is the hash of its normal form with kind and flags in the low bits, ``plain`` that of its letters and
    digits alone, without case.
    """

    def __init__(self) -> None:
        self.packed, self.plain = array("Q"), array("Q")

    def __missing__(self, raw: bytes) -> int:
        token = raw.decode("utf-8", "surrogatepass")
        inner = token.strip(ASCII_MARKS)
        if inner.isalpha():  # most tokens: letters between ASCII marks, which the patterns leave as they are
            plain, number = inner.casefold(), False
        else:
            inner = EDGES.sub("", token)
            plain = MARKS.sub("", inner).casefold()
            number = NUMBER.fullmatch(token.rstrip(".,;:!?)\"'").lstrip("(\"'")) is not None
        if number:
            inner, kind = token.strip(".,;:!?()\"'+$€£%"), NUMERIC
        else:
            lower = inner.lower()
            kind = NUMERIC if lower in NUMBER_WORDS else UNIT if lower in UNITS else CAPITAL if inner[:1].isupper() else WORD
            inner = lower
        flags = kind | (ENDS_BIT if token.rstrip("\"'").endswith(ENDS) else 0) | (0 if inner else SKIP_BIT)
        value = xxhash.xxh3_64_intdigest(inner.encode("utf-8", "surrogatepass"))
        self.packed.append((value & ~15) | flags)
        self.plain.append(value if plain == inner else xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")))
        place = self[raw] = len(self)
        return place

    def of(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``packed`` and ``plain`` of tokens; those that come again in ``raw`` are looked up once."""
        if len(self) >= MEMO_TOKENS:
            self.clear()
            self.packed, self.plain = array("Q"), array("Q")
        coded = raw.dictionary_encode()
        distinct = coded.dictionary
        places = np.fromiter(map(self.__getitem__, distinct.to_pylist()), np.int64, len(distinct))[coded.indices.to_numpy()]
        return np.frombuffer(self.packed, np.uint64)[places], np.frombuffer(self.plain, np.uint64)[places]


@dataclass
class Template:
    """Template words of some texts, one after the other."""

    codes: np.ndarray  # of template words: placeholders share one code per kind
    values: np.ndarray  # of what stood there
    slots: np.ndarray  # bool
    plain: np.ndarray  # of letters and digits alone, whatever the kind
    text: np.ndarray  # number of the text
    place: np.ndarray  # place in the text


def templates(texts: list[str | None] | pa.Array, memo: Tokens) -> Template:
    """Template words of whole texts. A capitalised word is a name unless it starts a sentence."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    raw = pc.ascii_split_whitespace(texts)  # at the ends of a text it may give empty tokens, which are skipped
    text = np.repeat(np.arange(len(raw)), pc.fill_null(pc.list_value_length(raw), 0).to_numpy())
    packed, plain = memo.of(raw.flatten().cast(pa.binary()))
    keep = (packed & np.uint64(SKIP_BIT)) == 0
    packed, plain, text = packed[keep], plain[keep], text[keep]
    kind = packed & np.uint64(3)
    first = np.ones(len(packed), bool)
    first[1:] = text[1:] != text[:-1]
    begins = np.flatnonzero(first)
    place = np.arange(len(packed)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(packed)]))))
    starts = first.copy()
    starts[1:] |= (packed[:-1] & np.uint64(ENDS_BIT)) != 0
    values = packed & ~LOW_BITS
    slots = (kind == NUMERIC) | (kind == UNIT) | ((kind == CAPITAL) & ~starts)
    return Template(np.where(slots, kind, values), values, slots, plain, text, place)


def _within(one: Template, size: int) -> np.ndarray:
    """Places of the windows of ``size`` words that lie in one text."""
    return np.flatnonzero(one.text[: len(one.text) - size + 1] == one.text[size - 1 :]) if len(one.text) >= size else np.zeros(0, np.int64)


def window_hashes(one: Template, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every window of ``size`` template words that has at least ``least_words`` plain ones."""
    places = _within(one, size)
    plain = np.concatenate(([0], np.cumsum(~one.slots)))
    places = places[plain[places + size] - plain[places] >= min(least_words, size)]
    return _salted(windows(one.codes, size)[places], TEMPLATE, size), places


def _salted(hashes: np.ndarray, kind: int, size: int) -> np.ndarray:
    return mix(hashes + np.uint64((2 * size + kind) * int(GOLDEN) % 2**64))


def run_hashes(plain: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` plain words, put together from those of half the width."""
    if width == 1:
        return plain
    half = width // 2
    part = run_hashes(plain, half)
    factor = np.uint64(pow(int(GOLDEN), half, 1 << 64))
    count = max(0, len(plain) - width + 1)
    total = part[:count] * factor + part[half : half + count]
    return total if width % 2 == 0 else total * GOLDEN + plain[width - 1 : width - 1 + count]


def runs_of(one: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every run of ``size`` plain words."""
    places = _within(one, size)
    return _salted(run_hashes(one.plain, size)[places], RUN, size), places


_LONGS = T.ArrayType(T.LongType(), False)
_CARD_WINDOW = [
    ("kind", T.IntegerType()), ("size", T.IntegerType()), ("hash", T.LongType()), ("place", T.LongType()),
    ("start", T.IntegerType()), ("total", T.IntegerType()), ("steps", _LONGS), ("codes", _LONGS), ("held", _LONGS),
]
_PAPER_WINDOW = [
    ("_key", T.StringType()), ("kind", T.IntegerType()), ("size", T.IntegerType()), ("hash", T.LongType()),
    ("at", T.IntegerType()), ("values", _LONGS),
]


def _shape(fields: list, *more: T.StructField) -> tuple[T.StructType, pa.Schema]:
    shape = T.StructType([*more, *[T.StructField(name, kind) for name, kind in fields]])
    return shape, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape.fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def card_windows(cards: DataFrame, width: int, least_words: int, run: int, least_run: int) -> DataFrame:
    """Hashed windows of the cards' fronts: card_id, front_key, kind, size, hash, place (its bit of the sieve), start, total (windows of the card), and
    for template windows the steps at which placeholders stand, their codes and what they hold.

    A card shorter than ``width`` is one window of its length, and one shorter than ``run`` one run.
    """
    shape, schema = _shape(_CARD_WINDOW, cards.schema["card_id"], T.StructField("front_key", T.LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for batch in batches:
            rows = []
            for card, key, front in zip(*(batch.column(c).to_pylist() for c in ("card_id", "front_key", "front")), strict=True):
                one = templates([front], memo)
                size, length = min(width, len(one.codes)), min(run, len(one.codes))
                if size >= least_words:  # shorter ones cannot be told from chance
                    hashes, places = window_hashes(one, size, least_words)
                    for h, at in zip(_signed(hashes).tolist(), places.tolist(), strict=True):
                        steps = np.flatnonzero(one.slots[at : at + size])
                        rows.append((card, key, TEMPLATE, size, h, h % SIEVE_BITS, at, len(places), steps.tolist(),
                                     _signed(one.codes[at + steps]).tolist(), _signed(one.values[at + steps]).tolist()))
                if length >= max(1, least_run):
                    hashes, places = runs_of(one, length)
                    rows += [(card, key, RUN, length, h, h % SIEVE_BITS, at, 0, [], [], []) for h, at in zip(_signed(hashes).tolist(), places.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cards.select("card_id", F.xxhash64("front").alias("front_key"), "front").mapInArrow(task, shape)


def paper_windows(papers: DataFrame, sieve: np.ndarray, sizes: list[tuple[int, int]], least_words: int) -> DataFrame:
    """Windows of papers (_key, text) whose hash may be that of a card's window: _key, kind, size, hash, at, and for template
    windows the values of their words. All texts of a slice are taken at once."""
    shape, schema = _shape(_PAPER_WINDOW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for batch in text_batches(batches):
            one = templates(batch.column("text"), memo)
            for kind, size in sizes:
                hashes, places = window_hashes(one, size, least_words) if kind == TEMPLATE else runs_of(one, size)
                likely = np.flatnonzero(in_sieve(sieve, hashes % np.uint64(SIEVE_BITS)))
                if not len(likely):
                    continue
                places, count = places[likely], len(likely)
                values = one.values[places[:, None] + np.arange(size)] if kind == TEMPLATE else np.zeros((count, 0), np.uint64)
                offsets = pa.array(np.arange(count + 1) * values.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(one.text[places])), pa.array(np.full(count, kind), pa.int32()),
                     pa.array(np.full(count, size), pa.int32()), pa.array(_signed(hashes[likely])),
                     pa.array(one.place[places], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(_signed(values.ravel())))],
                    schema=schema,
                )

    return papers.select("_key", "text").mapInArrow(task, shape)


def agreeing(rows: list[tuple[int, list[int], list[int], list[int], list[int]]]) -> tuple[list[int], bool]:
    """Of one reading of a card, windows (start, steps, codes, held, values) in order: the starts of those whose
    placeholders agree, with each other too, and whether one of them holds something else than the card."""
    slots: dict[tuple[int, int], int] = {}
    found, changed = [], False
    for start, steps, codes, held, values in rows:
        fresh = {}
        for step, code, own in zip(steps, codes, held, strict=True):
            value = values[step]
            if slots.get((code, own), fresh.get((code, own), value)) != value:
                break
            fresh[code, own] = value
        else:
            slots |= fresh
            found.append(start)
            changed = changed or any(own != value for (_, own), value in fresh.items())
    return found, changed


def longest_run(starts: list[int], size: int) -> int:
    """Words of the longest run that windows of ``size`` words at these places (sorted, distinct) make; 0 for none."""
    longest = length = 0
    for k, start in enumerate(starts):
        length = length + 1 if k and start == starts[k - 1] + 1 else size
        longest = max(longest, length)
    return longest


def _read_once(table: pa.Table) -> pa.Table:
    """What one reading of a card in a paper (all windows at one distance from the card's) gives."""
    rows = sorted(
        {(r["kind"], r["start"]): r for r in table.to_pylist()}.values(), key=lambda r: (r["kind"], r["start"])
    )
    windows_, runs = [r for r in rows if r["kind"] == TEMPLATE], [r for r in rows if r["kind"] == RUN]
    found, changed = agreeing([(r["start"], r["steps"], r["codes"], r["held"], r["values"]) for r in windows_])
    run = longest_run([r["start"] for r in runs], runs[0]["size"]) if runs else 0
    starts = found or [None]
    one = table.slice(0, 1)
    return pa.table({
        **{c: pa.concat_arrays([one.column(c).combine_chunks()] * len(starts)) for c in ("_key", "card_id", "front_key")},
        "start": pa.array(starts, pa.int32()), "total": pa.array([max((r["total"] for r in windows_), default=0)] * len(starts), pa.int32()),
        "changed": pa.array([changed] * len(starts), pa.bool_()), "run": pa.array([run] * len(starts), pa.int32()),
    })


def _hits(papers: DataFrame, cards: DataFrame, width: int, least_words: int, coverage: float, run: int, least_run: int) -> DataFrame:
    """(_key, hits) of the papers (_key, text) that hold a card."""
    known = cards.where("front IS NOT NULL").select("card_id", "front").distinct()
    theirs = stored(card_windows(known, width, least_words, run, least_run))
    sizes = sorted((r.kind, r["size"]) for r in theirs.select("kind", "size").distinct().collect())  # at most one a length
    sieve = sieve_of(theirs.select("place"), SIEVE_BITS)
    ours = paper_windows(papers, sieve, sizes, least_words)
    # Repeated rows of a paper give the same windows.
    ours = ours.groupBy("_key", "kind", "size", "hash", "at").agg(F.first("values").alias("values"))
    met = ours.join(theirs, ["kind", "size", "hash"]).withColumn("shift", F.col("at") - F.col("start"))
    card_kind = cards.schema["card_id"].dataType
    shape = T.StructType([
        T.StructField("_key", T.StringType()), T.StructField("card_id", card_kind), T.StructField("front_key", T.LongType()),
        T.StructField("start", T.IntegerType()), T.StructField("total", T.IntegerType()),
        T.StructField("changed", T.BooleanType()), T.StructField("run", T.IntegerType()),
    ])
    readings = met.groupBy("_key", "card_id", "front_key", "shift").applyInArrow(_read_once, shape)
    found = readings.groupBy("_key", "card_id", "front_key").agg(
        F.count_distinct("start").cast("int").alias("windows"), F.max("total").alias("total"),
        F.max("changed").alias("changed"), F.max("run").alias("run"),
    ).withColumn("coverage", F.when(F.col("total") > 0, F.col("windows") / F.col("total")).otherwise(0.0))
    kept = found.where((F.col("run") > 0) | ((F.col("windows") > 0) & (F.col("coverage") >= coverage)))
    hit = F.struct("card_id", "coverage", "windows", "changed", "run")
    return kept.groupBy("_key").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def mark_contamination(
    papers: DataFrame, cards: DataFrame, width: int = 8, least_words: int = 4, coverage: float = 0.5,
    run: int = 13, carry: Sequence[str] = (), least_run: int | None = None,
) -> DataFrame:
    """Which cards' questions the papers hold.

    ``papers`` has paper_id and text, ``cards`` card_id and front; other columns are ignored but for those named in
    ``carry``, which come back as they are. Returns one row per row of papers: paper_id, hits (array of card_id,
    coverage, windows, changed, run; empty where there is none) and the carried columns.

    A card is hit where at least ``coverage`` of its windows of ``width`` template words are in the paper with
    placeholders that agree, or where ``run`` of its words (all, if it has fewer) follow each other in the paper in any
    case and punctuation; ``run`` of a hit is the longest such run, 0 if none is long enough. Template windows with fewer
    than ``least_words`` plain words are not looked for; cards of fewer words than ``least_run`` (if not given,
    ``least_words``; 1 for all) are not either, as they say nothing of where they come from, nor are null and blank
    fronts. ``changed`` says that a placeholder of a template window holds another value than the card. Null and empty
    papers hold nothing; repeated cards count once, ids that have several fronts once per front.

    Windows of papers pass a sieve of the cards' windows and are joined with them by their hash; the windows of a paper
    that meet a card at one distance are one group. Neither cards nor papers go through the driver.
    """
    least_run = least_words if least_run is None else least_run
    keyed = papers.select(*dict.fromkeys(["paper_id", "text", *carry])).withColumn("_key", row_key())
    hits = stored(_hits(keyed, cards, width, least_words, coverage, run, least_run))
    split = maybe_among(keyed, "_key", hits.select("_key"), "_maybe")
    none = F.array().cast(hits.schema["hits"].dataType)
    found = split.where("_maybe").join(hits, "_key", "left").withColumn("hits", F.coalesce("hits", none))
    clean = split.where("NOT _maybe").withColumn("hits", none)
    columns = list(dict.fromkeys(["paper_id", *carry, "hits"]))
    return clean.select(*columns).unionByName(found.select(*columns))


def contaminated_papers(papers: DataFrame, cards: DataFrame, **options) -> DataFrame:
    """(paper_id, card_id, coverage, windows, changed, run) for every paper and card that :func:`mark_contamination` finds."""
    marked = mark_contamination(papers, cards, **options)
    return marked.select("paper_id", F.explode("hits").alias("hit")).select("paper_id", "hit.*")
