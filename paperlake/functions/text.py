"""Text rules that decide keys, names and escapes (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip and str.split know, as a plain character class (Unicode-aware
# \s is several times slower, and lacks the four separator controls).
_WS_NOT_BLANK = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[ {_WS_NOT_BLANK}]"
_ASCII = r"\A\p{ASCII}*\z"

UNTITLED = "Untitled"
MAX_NOTE_NAME = 120
MAX_FILE_NAME = 100

# LaTeX escapes in the order in which they must be applied.
BIBTEX_ESCAPES = (
    ("\\", "\\textbackslash{}"),
    ("&", "\\&"),
    ("%", "\\%"),
    ("$", "\\$"),
    ("#", "\\#"),
    ("_", "\\_"),
    ("{", "\\{"),
    ("}", "\\}"),
    ("~", "\\textasciitilde{}"),
    ("^", "\\textasciicircum{}"),
)


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and strip the ends."""
    # Single blanks between words are left alone, so clean text is matched but not rebuilt.
    return F.trim(F.regexp_replace(c, rf" {WS}+|[{_WS_NOT_BLANK}]{WS}*", " "))


def or_default(c: Column, default: Column | str) -> Column:
    """``c`` unless it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(F.length(c) > 0, c).otherwise(fallback)


def or_text(c: Column, default: str) -> Column:
    """``or_default`` for a plain word: one pass over ``c`` where a condition would compute it twice."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\z", default)


def normalize_tags(c: Column) -> Column:
    """Comma-separated text to a list of trimmed, non-empty tags."""
    return normalize_tag_list(F.split(c, ","))


def normalize_tag_list(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda tag: tag != "")


def key_simple(c: Column) -> Column:
    """Entity key for extraction and exports: lower-cased and stripped."""
    return strip(F.lower(c))


def nfkc(c: Column) -> Column:
    """NFKC form. ASCII text is already in it; the rest goes through ICU, which Spark ships, inside the JVM."""
    composed = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    return F.when(c.isNull() | c.rlike(_ASCII), c).otherwise(composed)


def _casefold(c: Column) -> Column:
    folded = F.call_function(
        "java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)
    )
    return F.when(c.isNull() | c.rlike(_ASCII), F.lower(c)).otherwise(folded)


def key_nfkc(c: Column) -> Column:
    """Entity key for note links: NFKC, white space collapsed, case folded."""
    return _casefold(squeeze(nfkc(F.coalesce(c, F.lit("")))))


def sanitize_name(c: Column, fallback: str = UNTITLED, max_length: int = MAX_NOTE_NAME) -> Column:
    """A note name that is safe both as a file name and as a link target."""
    value = nfkc(F.coalesce(c, F.lit("")))
    # Slashes become underscores, brackets vanish, the other reserved characters become blanks.
    value = F.translate(value, "/\\#:^<>\"|?*[]", "__         ")
    value = F.regexp_replace(F.regexp_replace(value, rf"{WS}+", " "), r"\A[ .]+|[ .]+\z", "")
    value = F.regexp_replace(F.regexp_replace(value, "_+", "_"), r"\A_|_\z", "")
    cut = F.regexp_replace(F.substring(or_text(value, fallback), 1, max_length), r"[ ._]+\z", "")
    return or_text(cut, fallback)


def safe_filename(c: Column, max_length: int = MAX_FILE_NAME) -> Column:
    """Reserved characters to underscores, cut, then stripped."""
    return strip(F.substring(F.translate(c, '<>:"/\\|?*', "_" * 9), 1, max_length))


def yaml_quote(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def bibtex_escape(c: Column) -> Column:
    for char, escape in BIBTEX_ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(escape))
    return c


def cite_key(c: Column) -> Column:
    return or_text(F.regexp_replace(c, "[^A-Za-z0-9_:-]", ""), "ref")


def split_name(c: Column) -> Column:
    """Full name to ``struct(given, family)``; the last word is the family name, a single word has none."""
    words = F.split(squeeze(c), " ")
    several = F.size(words) >= 2
    given = F.when(several, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(c)
    family = F.when(several, F.element_at(words, -1)).otherwise(F.lit(""))
    return F.struct(given.alias("given"), family.alias("family"))


def title_case(c: Column) -> Column:
    """Capitalise each run of letters, lower-casing the rest of the run."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def file_stem(c: Column) -> Column:
    """Last path segment without its final extension."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*\z", "")
