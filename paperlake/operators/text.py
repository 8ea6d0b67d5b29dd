"""Documents to sentences, request chunks and model contexts.

A document is one row, so everything that happens inside a document is an array expression on that row: no shuffle,
no window, no Python. Only :func:`assemble_text` (many page rows to one document) groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import squeeze, strip
from paperlake.operators.rows import exploded

MIN_SENTENCE_CHARS = 12
CHUNK_CHARS, CHUNK_ITEMS = 5000, 60
SLICE_CHARS = 2000
MIN_CHUNK_CHARS = 100
FALLBACK_CHARS = 6000
PREFIX_CHARS = 8000
BUDGET_CHARS, BUDGET_HEAD = 20000, 0.6

# Text put between head and tail of a shortened document.
OMISSION = "\n\n[...middle sections omitted for brevity...]\n\n"
# Characters that always end a sentence.
SENTENCE_ENDS = "。！？!?；;"
# Abbreviations whose period does not end a sentence.
ABBREVIATIONS = (
    "et", "al", "etal", "fig", "figs", "eq", "eqs", "no", "nos", "vs", "cf", "ie", "eg", "pp", "vol", "sec",
    "secs", "ref", "refs", "tab", "tabs", "approx", "resp", "viz", "mr", "mrs", "ms", "dr", "prof", "inc", "ltd",
    "dept", "univ", "ch", "chap", "st", "co", "corp", "eds", "ed",
)

# Unicode noncharacters: reserved for internal use, so they cannot occur in valid text.
_DOT, _END = "\ufdd0", "\ufdd1"
# A period at the end of a word stays inside the sentence when the run of letters and periods in front of it contains a
# period itself, or is a single letter or an abbreviation. Both patterns start at a period, which is rare.
_DOTTED = r"(\.\p{L}*)\.(?= |\z)"
_ABBREVIATED = r"(?i)\.(?<=(?<![\p{L}.])(?:\p{L}|" + "|".join(ABBREVIATIONS) + r")\.)(?= |\z)"
_SENTENCE_END = rf"([{SENTENCE_ENDS}]|\.(?= |\z))"


def unwrap(c: Column) -> Column:
    """Merge visual lines; a blank goes in only between two ASCII letters or digits."""
    spaced = F.regexp_replace(c, r"([A-Za-z0-9])\n+(?=[A-Za-z0-9])", "$1 ")
    return F.regexp_replace(spaced, r"\n", "")


def unwrap_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, unwrap(F.col(text)))


def sentence_array(c: Column) -> Column:
    """Cleaned sentences of at least 12 characters, in order; the unterminated tail counts as one."""
    # White space is normalised once for the whole text: a period before any white space is then one before a blank.
    held = F.regexp_replace(F.regexp_replace(squeeze(c), _DOTTED, "$1" + _DOT), _ABBREVIATED, _DOT)
    marked = F.translate(F.regexp_replace(held, _SENTENCE_END, "$1" + _END), _DOT, ".")
    return F.filter(F.transform(F.split(marked, _END), lambda s: F.trim(s)), lambda s: F.length(s) >= MIN_SENTENCE_CHARS)


def sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", page: str | None = None) -> DataFrame:
    """One row per sentence of each page: ``(doc, page_index, sentence_no, sentence_id, text)``."""
    page_index = F.col(page) if page else F.lit(0)
    rows = exploded(df, sentence_array(F.col(text)), "text", F.col(doc_id), page_index.alias("page_index"))
    return rows.select(
        doc_id,
        "page_index",
        (F.col("pos") + 1).alias("sentence_no"),
        sentence_id(F.col("page_index"), F.col("pos") + 1).alias("sentence_id"),
        "text",
    )


def sentence_id(page_index: Column, sentence_no: Column) -> Column:
    return F.concat(
        F.lit("p"), (page_index + 1).cast("string"), F.lit("_s"), sentence_no.cast("string")
    )


def chunk_starts(lengths: Column, max_chars: int = CHUNK_CHARS, max_items: int = CHUNK_ITEMS) -> Column:
    """0-based index of the first item of every greedily packed chunk.

    The sum resets at each chunk, so this is a fold and not a running-sum window. Only the start positions are
    accumulated, which keeps the fold linear for long documents.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("items"),
        F.lit(0).cast("bigint").alias("chars"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, length: Column) -> Column:
        full = (acc["items"] > 0) & ((acc["chars"] + length > max_chars) | (acc["items"] >= max_items))
        opens = full | (acc["i"] == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, 1).otherwise(acc["items"] + 1).alias("items"),
            F.when(full, length.cast("bigint")).otherwise(acc["chars"] + length).alias("chars"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(lengths, start, step, lambda acc: acc["starts"])


def pack_sentence_chunks(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    page: str | None = None,
    max_chars: int = CHUNK_CHARS,
    max_items: int = CHUNK_ITEMS,
) -> DataFrame:
    """One row per request chunk ``(doc, chunk_no, items)``, ``items`` being at most 60 sentence structs.

    With ``page`` given, the pages of a document are first brought together in page order: chunks span pages.
    """
    page_index = F.col(page) if page else F.lit(0)
    per_page = df.select(
        F.col(doc_id),
        page_index.alias("page_index"),
        F.transform(
            sentence_array(F.col(text)),
            lambda s, i: F.struct(sentence_id(page_index, i + 1).alias("sentence_id"), page_index.alias("page_index"), s.alias("text")),
        ).alias("items"),
    )
    if page:
        pages = F.sort_array(F.collect_list(F.struct("page_index", "items")))
        per_page = per_page.groupBy(doc_id).agg(F.flatten(F.transform(pages, lambda p: p["items"])).alias("items"))
    folded = per_page.withColumn(
        "starts", chunk_starts(F.transform("items", lambda s: F.length(s["text"])), max_chars, max_items)
    )
    cut = F.transform(
        "starts",
        lambda lo, i: F.slice(
            "items", lo + 1, F.coalesce(F.get("starts", i + 1), F.size("items")) - lo
        ),
    )
    chunks = exploded(folded.select(doc_id, cut.alias("chunks")), "chunks", "items", doc_id)
    return chunks.select(doc_id, F.col("pos").alias("chunk_no"), "items")


def pack_chunks(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    page: str | None = None,
    max_chars: int = CHUNK_CHARS,
    max_items: int = CHUNK_ITEMS,
) -> DataFrame:
    """One row per sentence with the number of the chunk it goes into."""
    chunks = pack_sentence_chunks(df, doc_id, text, page, max_chars, max_items)
    return chunks.select(doc_id, "chunk_no", F.inline("items"))


def assemble_text(
    pages: DataFrame, doc_id: str = "paper_id", page: str = "page_no", text: str = "text"
) -> DataFrame:
    """Non-blank pages of a document, in page order, joined by blank lines: ``(doc, n_pages, page_texts, text)``.

    A document whose pages are all blank has an empty text. A document has to fit in one value whatever the plan, so intake bounds it (see ``sources.files.accept_files``).
    """
    ordered = F.sort_array(F.collect_list(F.when(strip(F.col(text)) != "", F.struct(page, text))))
    grouped = pages.groupBy(doc_id).agg(F.transform(ordered, lambda p: p[text]).alias("page_texts"))
    return grouped.select(
        doc_id, F.size("page_texts").alias("n_pages"), "page_texts", F.array_join("page_texts", "\n\n").alias("text")
    )


def section_chunks(text: Column, titles: Column) -> Column:
    """Text cut at the first case-insensitive occurrence of each section title, as an array.

    No sections: one chunk. Fewer than two titles found: slices of 2000 characters. Otherwise the text before the
    first title is kept and each chunk runs to the next position. An empty title matches the start of the text, and
    equal positions give an empty chunk.
    """
    low = F.lower(text)
    starts = F.array_sort(
        F.filter(
            F.transform(titles, lambda t: F.call_function("locate", F.lower(F.coalesce(t, F.lit(""))), low)),
            lambda p: p > 0,
        )
    )
    length = F.length(text)
    bounds = F.when(F.get(starts, F.lit(0)) > 1, F.concat(F.array(F.lit(1)), starts)).otherwise(starts)
    by_title = F.transform(
        bounds,
        lambda b, i: F.substring(text, b, F.coalesce(F.get(bounds, i + 1), length + 1) - b),
    )
    slices = F.when(
        length > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(length, F.lit(1)), F.lit(SLICE_CHARS)),
            lambda b: F.substring(text, b, F.lit(SLICE_CHARS)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return (
        F.when(titles.isNull() | (F.size(titles) == 0), F.array(text))
        .when(F.size(starts) < 2, slices)
        .otherwise(by_title)
    )


def _text_with_titles(texts: DataFrame, sections: DataFrame, doc_id: str) -> DataFrame:
    """Attach each document's section titles (from one model response, hence few) in section order."""
    titles = sections.groupBy(doc_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("section_no", "title"))), lambda s: s["title"]).alias("titles")
    )
    return texts.join(titles, doc_id, "left")


def split_sections(texts: DataFrame, sections: DataFrame, doc_id: str = "paper_id") -> DataFrame:
    """All chunks of each text: ``(doc, chunk_no, text)``. ``sections`` has ``(doc, section_no, title)``."""
    joined = _text_with_titles(texts.select(doc_id, "text"), sections, doc_id)
    rows = exploded(joined, section_chunks(F.col("text"), F.col("titles")), "chunk", doc_id)
    return rows.select(doc_id, F.col("pos").alias("chunk_no"), F.col("chunk").alias("text"))


def select_chunks(texts: DataFrame, sections: DataFrame, doc_id: str = "paper_id") -> DataFrame:
    """Chunks worth a model call (at least 100 characters once stripped); with none, the first 6000 characters."""
    joined = _text_with_titles(texts.select(doc_id, "text"), sections, doc_id)
    kept = joined.withColumn(
        "kept",
        F.filter(section_chunks(F.col("text"), F.col("titles")), lambda c: F.length(strip(c)) >= MIN_CHUNK_CHARS),
    )
    chosen = F.when(F.size("kept") > 0, F.col("kept")).otherwise(
        F.array(F.substring("text", 1, FALLBACK_CHARS))
    )
    rows = exploded(kept, chosen, "chunk", doc_id)
    return rows.select(doc_id, F.col("pos").alias("chunk_no"), F.col("chunk").alias("text"))


def contexts(texts: DataFrame, doc_id: str = "paper_id") -> DataFrame:
    """Prefix contexts: the first two pages, and the first 8000 characters."""
    return texts.select(
        doc_id,
        F.array_join(F.slice("page_texts", 1, 2), "\n\n").alias("first_pages"),
        F.substring("text", 1, PREFIX_CHARS).alias("prefix"),
    )


def budget(text: Column, max_chars: int = BUDGET_CHARS, head: float = BUDGET_HEAD) -> Column:
    n_head = int(max_chars * head)
    cut = F.concat(F.substring(text, 1, n_head), F.lit(OMISSION), F.right(text, F.lit(max_chars - n_head)))
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


def budget_context(
    texts: DataFrame, max_chars: int = BUDGET_CHARS, head: float = BUDGET_HEAD, doc_id: str = "paper_id"
) -> DataFrame:
    """Whole text within the budget, else its head and tail; a document without text gives ''."""
    return texts.select(doc_id, F.coalesce(budget(F.col("text"), max_chars, head), F.lit("")).alias("context"))
