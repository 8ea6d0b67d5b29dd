"""Intake of paper files and existing notes, and the export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from paperlake.functions.text import strip

PDF_MAGIC = b"%PDF"
DEFAULT_MAX_MB = 50
_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def reject_reason(content: Column, max_mb: int = DEFAULT_MAX_MB, length: Column | None = None) -> Column:
    """Why a file is not taken, or null: ``empty``, ``too_large`` or ``not_pdf``."""
    size = F.octet_length(content) if length is None else length
    return (
        F.when(size.isNull() | (size == 0), "empty")
        .when(size > max_mb * 1024 * 1024, "too_large")
        .when(~F.startswith(content, F.lit(PDF_MAGIC)), "not_pdf")
    )


def accept_files(df: DataFrame, max_mb: int = DEFAULT_MAX_MB, content: str = "content") -> DataFrame:
    """Add ``reject_reason`` and ``accepted``. Files that come with their ``length`` (``read_files``) are judged by it:
    the content of those that are too large is never read, and is null in the result."""
    if "length" in df.columns:
        limit = max_mb * 1024 * 1024
        large = df.filter(F.col("length") > limit).withColumn(content, F.lit(None).cast("binary"))
        df = df.filter(F.coalesce("length", F.lit(0)) <= limit).unionByName(large)
        reason = reject_reason(F.col(content), max_mb, F.col("length"))
    else:
        reason = reject_reason(F.col(content), max_mb)
    return df.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def decode_payload(df: DataFrame, payload: str = "b64") -> DataFrame:
    """Strict base64 to bytes, with separate reasons for text that is no base64 and bytes that are no PDF."""
    valid = F.col(payload).rlike(_BASE64)
    decoded = df.withColumn("content", F.when(valid, F.try_to_binary(payload, F.lit("base64"))))
    reason = F.when(F.col("content").isNull(), "invalid_base64").when(
        ~F.startswith("content", F.lit(PDF_MAGIC)), "not_pdf"
    )
    return decoded.withColumn("reject_reason", reason)


def front_matter(text: Column) -> Column:
    """Key/value map of a note's front matter; empty without one. A repeated key keeps its last value."""
    inner = F.regexp_extract(text, r"(?s)\A---(.*?)---", 1)
    lines = F.filter(F.split(inner, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda line: line.contains(":"))

    def entry(line: Column) -> Column:
        colon = F.call_function("locate", F.lit(":"), line)
        raw = strip(F.substring(line, colon + 1, F.length(line)))
        bare = F.regexp_extract(raw, r'(?s)\A"(.*)"\z', 1)
        plain = F.replace(F.replace(bare, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        value = F.when(raw.rlike(r'(?s)\A".*"\z'), plain).otherwise(raw)
        return F.struct(strip(F.substring(line, F.lit(1), colon - 1)).alias("key"), value.alias("value"))

    # In order of key and place, an entry counts if another key follows it.
    placed = F.array_sort(F.transform(F.transform(lines, entry), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
    followed = F.arrays_zip(placed.alias("own"), F.slice(placed, F.lit(2), F.greatest(F.size(placed), F.lit(1))).alias("next"))
    last = F.filter(followed, lambda e: ~e["own"]["key"].eqNullSafe(e["next"]["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["own"]["key"].alias("key"), e["own"]["value"].alias("value"))))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes below ``path``, outside dot folders: ``(relative_path, front_matter)``.

    Only the front matter is used, so the text itself is not carried further.
    """
    root = path.rstrip("/") + "/"
    raw = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), "value")
    )
    relative = F.regexp_replace("file", F.lit(r"\A.*?\Q" + root.split(":", 1)[-1].lstrip("/") + r"\E"), F.lit(""))
    notes = raw.select(relative.alias("relative_path"), front_matter(F.col("value")).alias("front_matter"))
    return notes.filter(~F.col("relative_path").rlike(r"(\A|/)\."))


def note_inventory(notes: DataFrame, vault_path: str, key_prefix: str) -> DataFrame:
    """What ``lifecycle.resolve_paths`` needs to know of the notes present."""
    kind = F.col("front_matter")[f"{key_prefix}_type"]
    return notes.select(
        F.lit(vault_path).alias("vault_path"),
        "relative_path",
        kind.alias("note_type"),
        F.when(kind == "paper", F.col("front_matter")[f"{key_prefix}_id"])
        .when(kind == "entity", F.col("front_matter")[f"{key_prefix}_entity_key"])
        .alias("note_id"),
    )


def write_export(df: DataFrame, fmt: str, path: str) -> None:
    """Write an export table as CSV, JSON lines or text, in as many files as there are partitions."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").option(
            "lineSep", "\r\n"
        ).option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "text":
        writer.text(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")


def write_notes(notes: DataFrame, path: str) -> None:
    """Write notes as a table (``note_files.write_note_files`` writes them as files)."""
    notes.write.mode("overwrite").parquet(path)


def align_schema(df: DataFrame, schema: StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring an older table to ``schema``: missing columns are added with their default or null, others are cast."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    defaults = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def read_versions(
    spark: SparkSession, path: str, schema: StructType | str, defaults: dict[int, dict[str, object]] | None = None
) -> DataFrame:
    """A table that was written in several versions, below ``path`` in folders ``version=<n>``, as rows of ``schema``.

    All versions are one scan with the target's schema: columns that a version does not have are null or the default
    that ``defaults`` gives for that version, and narrower numbers (int, float, shorter decimals) are read as the wider
    ones of the schema. ``version`` is added as the last column. Filters on it leave folders out.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*target.fields, StructField("version", IntegerType())])).parquet(path)
    columns = {}
    for version, values in (defaults or {}).items():
        for name, value in values.items():
            own = columns.get(name, F.col(name))
            columns[name] = F.when(F.col("version") == version, F.lit(value).cast(target[name].dataType)).otherwise(own)
    return rows.withColumns(columns)
