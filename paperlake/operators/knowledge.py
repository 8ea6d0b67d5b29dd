"""Entity and relation tables: flatten, de-duplicate, resolve, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.functions.text import file_stem, key_nfkc, key_simple, or_default, sanitize_name, strip
from paperlake.operators.rows import exploded

ID_HEX = 24
# Defaults of the index tables.
ENTITY_TYPE, IMPORTANCE = "concept", 0.5
RELATION_TYPE, CONFIDENCE = "uses", 0.5
DIFFICULTY = 3
START_INTERVAL, START_EASE, START_REPETITIONS = 1.0, 2.5, 0


def make_id(prefix: str, *natural_key: Column) -> Column:
    """A stable id from the natural key: the same on every task retry, and long enough for billions of rows."""
    digest = F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in natural_key]), 256)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, ID_HEX))


# ---- flattening model responses -------------------------------------------------------------------------------


def entity_mentions(responses: DataFrame) -> DataFrame:
    """``(paper_id, chunk_no, pos, name, type, aliases, definition, importance)`` from parsed chunk responses."""
    rows = exploded(responses, "parsed.entities", "e", "paper_id", "chunk_no")
    return rows.select(
        "paper_id", "chunk_no", "pos", "e.name", "e.type", "e.aliases", "e.definition", "e.importance"
    )


def relation_mentions(responses: DataFrame) -> DataFrame:
    rows = exploded(responses, "parsed.relationships", "r", "paper_id", "chunk_no")
    return rows.select(
        "paper_id", "chunk_no", "pos", "r.source", "r.target", "r.type", "r.description", "r.confidence"
    )


# Items of a paper's second request are numbered from here on, those of the third from twice that: more than an array has.
REQUEST_STEP = 2**31


def _items(responses: DataFrame, path: str, name: str) -> DataFrame:
    """Items of responses with their place in the paper: that in the response, moved on by its request."""
    chunk = F.coalesce("chunk_no", F.lit(0)) if "chunk_no" in responses.columns else F.lit(0)
    rows = exploded(responses, path, name, "paper_id", chunk.alias("chunk_no"))
    return rows.withColumn("pos", F.col("chunk_no").cast("bigint") * REQUEST_STEP + F.col("pos"))


def sections(responses: DataFrame) -> DataFrame:
    """Sections numbered ``sec_1, sec_2 …`` in response order; those of a later request carry its number too."""
    rows = _items(responses, "parsed.sections", "s")
    place = (F.col("pos") % REQUEST_STEP + 1).cast("string")
    later = F.when(F.col("chunk_no") > 0, F.concat(F.col("chunk_no").cast("string"), F.lit("_"))).otherwise("")
    return rows.select(
        "paper_id",
        (F.col("pos") + 1).alias("section_no"),
        F.concat(F.lit("sec_"), later, place).alias("id"),
        "s.title",
        "s.level",
        "s.summary",
    )


def findings(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "parsed.findings", "f")
    return rows.select(
        make_id("find", F.col("paper_id"), F.col("pos")).alias("id"),
        "paper_id",
        "chunk_no",
        "pos",
        "f.type",
        "f.title",
        "f.statement",
        "f.description",
        "f.evidence",
    )


def methods(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "parsed.methods", "m")
    return rows.select("paper_id", "pos", "m.name", "m.description", "m.inputs", "m.outputs")


def datasets(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "parsed.datasets", "d")
    return rows.select("paper_id", "pos", "d.name", "d.description", "d.usage")


def new_cards(responses: DataFrame, now: Column) -> DataFrame:
    """Cards of a response with their defaults, due at once."""
    rows = _items(responses, "parsed.flashcards", "c")
    return rows.select(
        make_id("fc", F.col("paper_id"), F.col("pos")).alias("id"),
        "paper_id",
        "pos",
        F.coalesce("c.front", F.lit("")).alias("front"),
        F.coalesce("c.back", F.lit("")).alias("back"),
        F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("c.difficulty", F.lit(DIFFICULTY)).alias("difficulty"),
        F.lit(START_INTERVAL).alias("interval_days"),
        F.lit(START_EASE).alias("ease_factor"),
        F.lit(START_REPETITIONS).alias("repetitions"),
        now.alias("next_review"),
        F.lit(None).cast("timestamp_ntz").alias("last_review"),
    )


# ---- de-duplication and resolution ----------------------------------------------------------------------------


def dedup_entities(mentions: DataFrame) -> DataFrame:
    """One row per (paper, key): the most important mention, the earliest among equals.

    ``first_chunk, first_pos`` keep the place where the key first appeared, which is the order of the result. Mentions
    are dealt by paper, and so is the result: a join by paper that follows needs no shuffle of its own.
    """
    payload = [c for c in mentions.columns if c not in ("paper_id", "chunk_no", "pos")]
    rank = F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("chunk_no"), -F.col("pos"))
    best = (
        mentions.withColumn("entity_key", key_simple(F.col("name")))
        .filter(F.col("entity_key") != "")
        .repartition("paper_id")
        .groupBy("paper_id", "entity_key")
        .agg(
            F.max_by(F.struct(*payload), rank).alias("best"),
            F.min(F.struct("chunk_no", "pos")).alias("first"),
        )
    )
    return best.select(
        "paper_id",
        "entity_key",
        "best.*",
        F.col("first.chunk_no").alias("first_chunk"),
        F.col("first.pos").alias("first_pos"),
    )


def entity_index(entities: DataFrame) -> DataFrame:
    """De-duplicated entities with ids and index defaults."""
    defaults = {
        "name": F.coalesce("name", F.lit("")),
        "type": F.coalesce("type", F.lit(ENTITY_TYPE)),
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "importance": F.coalesce("importance", F.lit(IMPORTANCE)),
    }
    return entities.withColumns(
        {"id": make_id("ent", F.col("paper_id"), F.col("entity_key")), **defaults}
    )


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends are entities of the same paper, by exact lower-cased name.

    The lookup does not strip while de-duplication does, so a padded name stays unresolved. De-duplicated names differ
    in their lower-cased form within a paper, so neither lookup can multiply rows. The entities' own names come along as
    ``source_name`` and ``target_name``.

    Both tables are dealt by paper, which they are already if they were made here, and both ends are looked up there: the
    entities of a name stand in one group with the relations that name it. Joins by paper and name would shuffle the
    relations once for each end, and the entities too.
    """
    rest = [c for c in relations.columns if c != "paper_id"]
    names = entities.select("paper_id", F.lower("name").alias("_key"), F.struct("id", "name").alias("_entity"))
    named = relations.select("paper_id", F.lower("source").alias("_key"), F.struct(*rest).alias("_relation"))
    both = names.repartition("paper_id").unionByName(named.repartition("paper_id"), allowMissingColumns=True)
    group, is_relation = W.partitionBy("paper_id", "_key"), F.col("_relation").isNotNull()

    def looked_up(rows: DataFrame) -> DataFrame:
        known = rows.filter(F.col("paper_id").isNotNull() & F.col("_key").isNotNull())
        return known.withColumn("_found", F.collect_list("_entity").over(group))

    # An entity stays one row for the second end; a relation has a row for each entity found, which is one at most.
    source = F.explode(F.when(is_relation, F.col("_found")).otherwise(F.array("_entity"))).alias("_source")
    target = F.when(is_relation, F.lower("_relation.target")).otherwise(F.col("_key")).alias("_key")
    ends = looked_up(both).select("paper_id", "_relation", "_entity", target, source)
    resolved = looked_up(ends).filter(is_relation).select("paper_id", "_relation", "_source", F.explode("_found").alias("_target"))
    return resolved.select(
        "paper_id", "_relation.*",
        F.col("_source.id").alias("source_entity_id"), F.col("_source.name").alias("source_name"),
        F.col("_target.id").alias("target_entity_id"), F.col("_target.name").alias("target_name"),
    ).withColumns(
        {
            "id": make_id("rel", F.col("paper_id"), F.col("chunk_no"), F.col("pos")),
            "type": F.coalesce("type", F.lit(RELATION_TYPE)),
            "confidence": F.coalesce("confidence", F.lit(CONFIDENCE)),
        }
    )


def paper_index(papers: DataFrame, failed_calls: DataFrame, errors: DataFrame) -> DataFrame:
    """Index row per paper. Failed model calls leave a paper completed with empty parts; other failures are errors.

    ``papers`` carries ``metadata``; ``failed_calls`` has one row per failed call; ``errors`` has (paper_id, message).
    """
    failed = failed_calls.groupBy("paper_id").agg(F.count(F.lit(1)).alias("failed_calls"))
    messages = errors.groupBy("paper_id").agg(F.max("message").alias("extraction_error"))
    joined = papers.join(failed, "paper_id", "left").join(messages, "paper_id", "left")
    ok = F.col("extraction_error").isNull()
    return joined.select(
        "paper_id",
        F.when(ok, F.coalesce("metadata.title", F.lit(""))).otherwise("").alias("title"),
        F.when(ok, F.col("metadata.doi")).alias("doi"),
        F.when(ok, F.col("metadata.arxiv_id")).alias("arxiv_id"),
        F.when(ok, F.col("metadata.year")).alias("year"),
        F.when(ok, F.col("metadata.venue")).alias("venue"),
        F.when(ok, "completed").otherwise("error").alias("extraction_status"),
        "extraction_error",
        F.coalesce("failed_calls", F.lit(0)).alias("failed_calls"),
    )


# ---- across papers --------------------------------------------------------------------------------------------


def with_paper(items: DataFrame, papers: DataFrame, *columns: str) -> DataFrame:
    """Attach columns of the item's paper."""
    return items.join(papers.select("paper_id", *columns), "paper_id")


def global_entities(entities: DataFrame, papers: DataFrame) -> DataFrame:
    """First appearance of each key per user over papers in (created_at, paper_id) order."""
    rows = with_paper(entities, papers, "user_id", "created_at")
    payload = F.struct("name", "type", "aliases", "definition", "importance", "id", "paper_id")
    order = F.struct("created_at", "paper_id", "first_chunk", "first_pos")
    firsts = (
        rows.withColumn("entity_key", key_simple(F.col("name")))
        .filter(F.col("entity_key") != "")
        .groupBy("user_id", "entity_key")
        .agg(F.min_by(payload, order).alias("e"))
    )
    return firsts.select("user_id", "entity_key", "e.*")


def entity_papers(entities: DataFrame, papers: DataFrame) -> DataFrame:
    """Inverted index, one row per occurrence: attributes of the first appearance, then the paper title.

    Kept long on purpose: a popular entity may occur in a large share of all papers, and its list would not fit in one
    row. ``created_at, paper_id, first_chunk, first_pos`` give the order of the list. The first appearance is found in
    the same shuffle, by a running window that holds no list either.
    """
    keys, order = ["user_id", "entity_key"], ["created_at", "paper_id", "first_chunk", "first_pos"]
    rows = with_paper(entities, papers, "user_id", "created_at", "title")
    occurrences = rows.withColumn("entity_key", key_simple(F.col("name"))).filter(
        (F.col("entity_key") != "") & F.col("user_id").isNotNull()
    )
    running = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first(F.struct("name", "type", "aliases", "definition", "importance")).over(running)
    return occurrences.select(*keys, *order, "title", first.alias("e")).select(*keys, *order, "title", "e.*")


def note_entities(papers: DataFrame, document_entities: DataFrame, index_entities: DataFrame) -> DataFrame:
    """Entities a paper's note lists: those of its document, or of the index where the document has none.

    The first of each link key wins. Blank names count as missing in a document; ``entity_type`` and ``description``
    are accepted as alternative spellings.
    """
    from_document = document_entities.select(
        "paper_id",
        F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"),
        "pos",
        strip(F.col("name")).alias("name"),
        or_default(F.col("type"), or_default(F.col("entity_type"), ENTITY_TYPE)).alias("type"),
        or_default(F.col("definition"), or_default(F.col("description"), "")).alias("definition"),
    ).filter(F.col("name") != "")
    from_index = (
        index_entities.join(from_document.select("paper_id"), "paper_id", "left_anti")
        .select(
            "paper_id",
            F.col("first_chunk").alias("chunk_no"),
            F.col("first_pos").alias("pos"),
            "name",
            "type",
            F.coalesce("definition", F.lit("")).alias("definition"),
        )
    )
    rows = from_document.unionByName(from_index).join(papers.select("paper_id", "user_id"), "paper_id")
    firsts = (
        rows.withColumn("entity_key", key_nfkc(F.col("name")))
        .groupBy("user_id", "paper_id", "entity_key")
        .agg(F.min_by(F.struct("name", "type", "definition", "chunk_no", "pos"), F.struct("chunk_no", "pos")).alias("e"))
    )
    return firsts.select("user_id", "paper_id", "entity_key", "e.*")


def entity_paper_links(
    mapping: DataFrame, index_entities: DataFrame, papers: DataFrame, current: DataFrame | None = None
) -> DataFrame:
    """Papers an entity appears in, per user and link key: ``(user_id, entity_key, paper_id, title, target)``.

    Sources are earlier note mappings and the entity index. ``target`` is the mapped note's name, else the sanitised
    title. ``current`` (paper_id, title, target) holds papers rendered in this run, whose own values win.
    """
    from_mapping = mapping.filter(F.col("item_type") == "entity").select(
        "user_id", F.col("normalized_key").alias("entity_key"), "paper_id"
    )
    owned = index_entities.join(papers.select("paper_id", "user_id"), "paper_id")
    from_index = owned.select("user_id", key_nfkc(F.col("name")).alias("entity_key"), "paper_id")
    pairs = from_mapping.unionByName(from_index).distinct()
    note_of = (
        mapping.filter(F.col("item_type") == "paper")
        .groupBy("user_id", "paper_id")
        .agg(F.min("relative_path").alias("note_path"))
    )
    titles = papers.select("paper_id", or_default(F.col("title"), F.col("paper_id")).alias("title"))
    linked = pairs.join(titles, "paper_id").join(note_of, ["user_id", "paper_id"], "left")
    target = F.coalesce(file_stem(F.col("note_path")), sanitize_name(F.col("title")))
    if current is None:
        return linked.select("user_id", "entity_key", "paper_id", "title", target.alias("target"))
    own = current.select("paper_id", F.col("title").alias("own_title"), F.col("target").alias("own_target"))
    return linked.join(own, "paper_id", "left").select(
        "user_id",
        "entity_key",
        "paper_id",
        F.coalesce("own_title", "title").alias("title"),
        F.coalesce("own_target", target).alias("target"),
    )


def incident_relations(relations: DataFrame) -> DataFrame:
    """Each relation once per distinct link key of its ends: an equi-joinable form of "source or target is the entity"."""
    keys = F.array_distinct(F.array(key_nfkc(F.col("source")), key_nfkc(F.col("target"))))
    return relations.withColumn("_keys", keys).select(
        F.explode("_keys").alias("entity_key"), *relations.columns
    )
