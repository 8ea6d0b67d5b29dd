"""Table lifecycle: claims, expiry, reconciliation, deletion, state from logs, incremental notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.functions.text import file_stem
from paperlake.schemas import TASK_STATES_CLOSED, TASK_STATES_OPEN
from paperlake.session import stored

ORPHAN_MESSAGE = "processing interrupted (service restart)"


def plan_extraction(tasks: DataFrame, papers: DataFrame) -> DataFrame:
    """What to do for each completed task: ``start_new``, ``restart``, ``skip_running`` or ``skip_completed``.

    ``papers`` holds at most one row per task.
    """
    existing = papers.select("task_id", "paper_id", "extraction_status")
    joined = tasks.filter(F.col("status") == "completed").join(existing, "task_id", "left")
    action = (
        F.when(F.col("paper_id").isNull(), "start_new")
        .when(F.col("extraction_status") == "extracting", "skip_running")
        .when(F.col("extraction_status") == "completed", "skip_completed")
        .otherwise("restart")
    )
    return joined.select("task_id", "user_id", "paper_id", action.alias("action"))


def claim_papers(papers: DataFrame, plan: DataFrame, model: str, now: Column) -> DataFrame:
    """The paper table after the claims of ``plan``: restarted papers are extracting without error, new ones appended."""
    restarted = plan.filter(F.col("action") == "restart").select("task_id", F.lit(True).alias("_claimed"))
    claimed = F.coalesce("_claimed", F.lit(False))
    kept = (
        papers.join(restarted, "task_id", "left")
        .withColumns(
            {
                "extraction_status": F.when(claimed, "extracting").otherwise(F.col("extraction_status")),
                "extraction_error": F.when(~claimed, F.col("extraction_error")),
                "extraction_model": F.when(claimed, model).otherwise(F.col("extraction_model")),
                "updated_at": F.when(claimed, now).otherwise(F.col("updated_at")),
            }
        )
        .drop("_claimed")
    )
    fresh = plan.filter(F.col("action") == "start_new").select(
        F.concat(F.lit("pk_"), F.substring(F.sha2("task_id", 256), 1, 24)).alias("paper_id"),
        "task_id",
        "user_id",
        F.lit("extracting").alias("extraction_status"),
        F.lit(model).alias("extraction_model"),
        now.alias("updated_at"),
    )
    return kept.unionByName(fresh, allowMissingColumns=True)


def expired(
    df: DataFrame, now: Column, ttl_minutes: int, states: tuple[str, ...] | None = TASK_STATES_CLOSED
) -> DataFrame:
    """Rows created before ``now - ttl``, in one of ``states`` (None: any state, as for drafts)."""
    cutoff = now - F.make_dt_interval(mins=F.lit(ttl_minutes))
    rows = df.filter(F.col("created_at") < cutoff)
    return rows if states is None else rows.filter(F.col("status").isin(*states))


def reconcile_orphans(tasks: DataFrame, message: str = ORPHAN_MESSAGE) -> DataFrame:
    """Tasks that no process drives any more become errors; finished ones stay as they are."""
    orphan = F.col("status").isin(*TASK_STATES_OPEN)
    return tasks.withColumns(
        {
            "error": F.when(orphan, message).otherwise(F.col("error")),
            "message": F.when(orphan, message).otherwise(F.col("message")),
            "status": F.when(orphan, "error").otherwise(F.col("status")),
        }
    )


def delete_papers(tables: dict[str, DataFrame], paper_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given papers."""
    return {name: table.join(paper_ids.select("paper_id"), "paper_id", "left_anti") for name, table in tables.items()}


def latest_state(progress: DataFrame) -> DataFrame:
    """Last update of each task by (ts, seq): a plain aggregate, so long logs combine before the shuffle."""
    payload = [c for c in progress.columns if c != "task_id"]
    last = progress.groupBy("task_id").agg(F.max_by(F.struct(*payload), F.struct("ts", "seq")).alias("s"))
    return last.select("task_id", "s.*")


# ---- incremental notes ----------------------------------------------------------------------------------------


def mapping_id(user: Column, paper: Column, item_type: Column, item: Column, vault: Column) -> Column:
    raw = F.concat_ws(":", user.cast("string"), paper, item_type, item, vault)
    return F.concat(F.lit("obs_"), F.substring(F.sha1(raw), 1, 24))


def plan_notes(notes: DataFrame, mapping: DataFrame, inventory: DataFrame, now: Column) -> DataFrame:
    """Compare rendered notes with the mapping table and with the files present.

    ``notes``: (mapping_id, user_id, paper_id, item_type, item_id, normalized_key, source_name, vault_path,
    relative_path, content_hash), one row per note. ``inventory``: (vault_path, relative_path) of existing files.
    The result is the new mapping table plus ``state``: ``skipped`` (same hash and the file is there), ``written``, or
    null for mappings without a note in this run.
    """
    present = inventory.select("vault_path", "relative_path", F.lit(True).alias("_present"))
    new = notes.join(present, ["vault_path", "relative_path"], "left").alias("n")
    old = mapping.alias("o")
    same = (F.col("o.content_hash") == F.col("n.content_hash")) & F.coalesce("n._present", F.lit(False))
    state = F.when(F.col("n.mapping_id").isNotNull(), F.when(same, "skipped").otherwise("written"))
    columns = [
        "user_id", "paper_id", "item_type", "item_id", "normalized_key", "source_name", "vault_path",
        "relative_path", "content_hash",
    ]
    updated = F.when(F.col("n.mapping_id").isNotNull(), now).otherwise(F.col("o.updated_at"))
    return new.join(old, F.col("n.mapping_id") == F.col("o.mapping_id"), "full_outer").select(
        F.coalesce("n.mapping_id", "o.mapping_id").alias("mapping_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns],
        updated.alias("updated_at"),
        state.alias("state"),
    )


def note_counts(planned: DataFrame) -> DataFrame:
    return planned.agg(
        F.count_if(F.col("state") == "written").alias("files_written"),
        F.count_if(F.col("state") == "skipped").alias("files_skipped"),
    )


_ITEM = ["vault_path", "item_type", "item_id"]


def resolve_paths(items: DataFrame, mapping: DataFrame, inventory: DataFrame, root: str = "Papers") -> DataFrame:
    """Give every note a path: ``(vault_path, item_type, item_id, …, relative_path)``.

    ``items``: (vault_path, item_type, item_id, normalized_key, source_name, folder, desired_name, mapping_id), one row
    per (vault, type, id). ``inventory``: (vault_path, relative_path, note_type, note_id), the notes present with what
    their front matter says. In order: the mapped path if that file still exists, a present note that says it is this
    item, the desired name if it is free, the desired name with a suffix.

    The first claimant of a name (by item id) gets it plain. The others add three hex digits of their own hash, which
    spreads even a very common name over 4096 stems. Those of a stem are numbered, and the numbers that files already
    have are left out: the claimants take the free ones in order.
    """
    files = inventory.select("vault_path", "relative_path").distinct()
    known = mapping.select("mapping_id", F.col("relative_path").alias("_mapped"))
    inside = ~F.concat(F.lit("/"), F.col("_mapped"), F.lit("/")).contains("/../") & ~F.col("_mapped").startswith("/")
    mapped = (
        items.join(known, "mapping_id", "left")
        .withColumn("relative_path", F.when(inside, F.col("_mapped")))
        .join(files.withColumn("_there", F.lit(True)), ["vault_path", "relative_path"], "left")
        .withColumn("_mapped", F.when(F.col("_there"), F.col("relative_path")))
        .drop("relative_path", "_there")
    )
    claimed = inventory.groupBy(
        "vault_path", F.col("note_type").alias("item_type"), F.col("note_id").alias("_note_id")
    ).agg(F.min("relative_path").alias("_found"))
    # A paper note names its paper id, an entity note its link key.
    suffix = F.substring(F.sha1(F.concat_ws(":", "item_type", "normalized_key", "source_name")), 1, 3)
    base = F.concat_ws("/", F.lit(root), F.col("folder"), F.col("desired_name"))
    located = stored(
        mapped.withColumn("_note_id", F.col("normalized_key"))
        .join(claimed, ["vault_path", "item_type", "_note_id"], "left")
        .withColumns({"_settled": F.coalesce("_mapped", "_found"), "_base": base, "_stem": F.concat_ws("-", base, suffix)})
        .select(*items.columns, "_settled", "_base", "_stem")
    )
    done = located.filter(F.col("_settled").isNotNull()).select(*items.columns, F.col("_settled").alias("relative_path"))
    todo = located.filter(F.col("_settled").isNull())

    # Plain names: the smallest item id wins a name that is not taken.
    winner = todo.groupBy("vault_path", "_base").agg(F.min(F.struct("item_type", "item_id")).alias("_first"))
    held = files.select("vault_path", F.col("relative_path").alias("_plain"), F.lit(True).alias("_taken"))
    candidates = (
        todo.join(winner, ["vault_path", "_base"]).withColumn("_plain", F.concat("_base", F.lit(".md")))
        .join(held, ["vault_path", "_plain"], "left")
    )
    plain = (F.col("_first") == F.struct("item_type", "item_id")) & F.col("_taken").isNull()
    candidates = stored(candidates.select(*items.columns, "_plain", "_stem", plain.alias("_placed")))
    placed = candidates.filter("_placed").select(*items.columns, F.col("_plain").alias("relative_path"))

    # Numbers of a stem that are taken, by files or by plain names of this run: 1 for the stem itself.
    used = files.unionByName(placed.select("vault_path", "relative_path")).distinct()
    name = F.regexp_replace("relative_path", r"\.md\z", "")
    numbered = F.regexp_extract(name, r"_([2-9]|[1-9][0-9]{1,8})\z", 1)
    readings = F.array(
        F.struct(name.alias("_stem"), F.lit(1).cast("bigint").alias("number")),
        F.struct(F.regexp_replace(name, r"_[0-9]+\z", "").alias("_stem"), F.nullif(numbered, F.lit("")).cast("bigint").alias("number")),
    )
    rest = candidates.filter(~F.col("_placed"))
    stem = ["vault_path", "_stem"]
    taken = (
        used.select("vault_path", F.inline(readings)).filter(F.col("number").isNotNull()).distinct()
        .join(rest.select(*stem).distinct(), stem, "left_semi")
    )
    # So many numbers below the j-th taken one are free; claimant n passes all taken ones that have fewer than n. In one
    # order of both, that is how many taken ones stand before the claimant.
    free = F.col("number") - F.row_number().over(W.partitionBy(*stem).orderBy("number"))
    turn = F.row_number().over(W.partitionBy(*stem).orderBy("item_type", "item_id"))
    both = rest.select(*items.columns, "_stem", turn.cast("bigint").alias("_turn"), F.lit(0).alias("_held")).unionByName(
        taken.select(*stem, free.alias("_turn"), F.lit(1).alias("_held")), allowMissingColumns=True
    )
    before = W.partitionBy(*stem).orderBy("_turn", "_held").rowsBetween(W.unboundedPreceding, 0)
    number = F.col("_turn") + F.col("_passed")
    path = F.concat("_stem", F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(".md"))
    others = both.withColumn("_passed", F.sum("_held").over(before)).filter(F.col("_held") == 0).select(
        *items.columns, path.alias("relative_path")
    )
    return done.unionByName(placed).unionByName(others)


def note_target(relative_path: Column) -> Column:
    """Link target of a note: its file name without extension."""
    return file_stem(relative_path)
