"""Spaced repetition (SM-2): review state, due cards, and intake checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.functions.text import normalize_tags
from paperlake.operators.knowledge import DIFFICULTY, START_EASE, START_INTERVAL, START_REPETITIONS, make_id

MIN_EASE = 1.3
# A due date later than this many days after its review is put there: the calendar ends in the year 9999.
MAX_DAYS = 2_900_000.0
# Reviews of a card within so many days are folded together, whatever their number elsewhere.
BLOCK_DAYS = 7
_DAY_MICROS = 86_400_000_000


def ease_shift(quality: Column) -> Column:
    miss = 5 - quality
    return 0.1 - miss * (0.08 + miss * 0.02)


def next_ease(ease: Column, quality: Column) -> Column:
    miss = 5 - quality
    return F.greatest(F.lit(MIN_EASE), ease + 0.1 - miss * (0.08 + miss * 0.02))


def due_after(ts: Column, interval: Column) -> Column:
    """``ts`` plus a fractional number of days, to the microsecond, within the calendar."""
    micros = F.round(F.least(interval, F.lit(MAX_DAYS)) * _DAY_MICROS).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, ts)


def _fold_block(log: Column, ease: Column) -> Column:
    """SM-2 over the ordered reviews of a block, for a card that enters it with ``ease``.

    ``repetitions`` and ``interval`` are those after the last failed review if there is one (``failed``). If not, the
    block only carries on: ``grow0`` is what it multiplies an interval by, ``grow1`` and ``grow2`` the same without its
    first one or two reviews, whose intervals are fixed.
    """

    def step(acc: Column, review: Column) -> Column:
        quality, passed = review["quality"], review["quality"] >= 3
        grown = (
            F.when(acc["repetitions"] == 0, F.lit(1.0))
            .when(acc["repetitions"] == 1, F.lit(6.0))
            .otherwise(acc["interval"] * acc["ease"])
        )
        return F.struct(
            (acc["failed"] | ~passed).alias("failed"),
            F.when(passed, acc["repetitions"] + 1).otherwise(0).alias("repetitions"),
            F.when(passed, grown).otherwise(1.0).alias("interval"),
            *[
                (acc[f"grow{k}"] * F.when(acc["repetitions"] >= k, acc["ease"]).otherwise(1.0)).alias(f"grow{k}")
                for k in (0, 1, 2)
            ],
            next_ease(acc["ease"], quality).alias("ease"),
        )

    start = F.struct(
        F.lit(False).alias("failed"), F.lit(0).alias("repetitions"), F.lit(1.0).alias("interval"),
        *[F.lit(1.0).alias(f"grow{k}") for k in (0, 1, 2)], ease.alias("ease"),
    )
    return F.aggregate(log, start, step)


def _carry_on(state: Column, block: Column) -> Column:
    """State of a card after a folded block."""
    total = state["repetitions"] + block["repetitions"]
    continued = (
        F.when(state["repetitions"] >= 2, state["interval"] * block["grow0"])
        .when(state["repetitions"] == 1, 6.0 * block["grow1"])
        .when(block["repetitions"] >= 2, 6.0 * block["grow2"])
        .otherwise(1.0)
    )
    return F.struct(
        F.when(block["failed"], block["repetitions"]).otherwise(total).alias("repetitions"),
        F.when(block["failed"], block["interval"]).otherwise(continued).alias("interval"),
        block["ease"].alias("ease"),
    )


def review_state(
    cards: DataFrame, reviews: DataFrame, card_id: str = "card_id", block_days: int = BLOCK_DAYS
) -> DataFrame:
    """SM-2 state of every card after its reviews, taken in (ts, review_id) order.

    Cards start from their stored state, or from the defaults where that is null, and keep it without reviews. Adds
    ``due_capped``: the due date would lie beyond the calendar and was put at ``MAX_DAYS``.

    Logs are folded in blocks of ``block_days``, each in a row of its own, so that a long log is spread over tasks. Over
    a block the ease becomes ``max(floor, ease + shift)`` with two numbers of the block alone; running sums and maxima
    of these give the ease that enters every block. Folded blocks then chain up to the card's state. Other block lengths
    give the same state up to floating-point rounding.
    """
    start = cards.withColumns(
        {
            "interval_days": F.coalesce("interval_days", F.lit(START_INTERVAL)),
            "ease_factor": F.coalesce("ease_factor", F.lit(START_EASE)),
            "repetitions": F.coalesce("repetitions", F.lit(START_REPETITIONS)),
        }
    )
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (block_days * _DAY_MICROS)).alias("_block")
    logs = reviews.select(card_id, "ts", "review_id", "quality", block).groupBy(card_id, "_block").agg(
        F.sort_array(F.collect_list(F.struct("ts", "review_id", "quality"))).alias("_log"), F.max("ts").alias("_ts")
    )
    effect = F.aggregate(
        "_log",
        F.struct(F.lit(float("-inf")).alias("floor"), F.lit(0.0).alias("shift")),
        lambda acc, r: F.struct(
            next_ease(acc["floor"], r["quality"]).alias("floor"), (acc["shift"] + ease_shift(r["quality"])).alias("shift")
        ),
    )
    order = W.partitionBy(card_id).orderBy("_block")
    until = order.rowsBetween(W.unboundedPreceding, 0)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    effects = (
        logs.select(card_id, "_block", effect.alias("e"))
        .withColumn("_sum", F.sum("e.shift").over(until))
        .withColumn("_least", F.max(F.col("e.floor") - F.col("_sum")).over(before))
        .withColumn("_before", F.lag("_sum").over(order))
    )
    entering = effects.join(start.select(card_id, "ease_factor"), card_id).select(
        card_id, "_block",
        F.when(F.col("_before").isNull(), F.col("ease_factor"))
        .otherwise(F.greatest("ease_factor", "_least") + F.col("_before")).alias("_ease"),
    )
    folded = logs.join(entering, [card_id, "_block"]).select(
        card_id, "_block", "_ts", _fold_block(F.col("_log"), F.col("_ease")).alias("_fold")
    )
    chained = folded.groupBy(card_id).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_fold"))).alias("_blocks"), F.max("_ts").alias("_ts")
    )
    initial = F.struct(
        F.col("repetitions"), F.col("interval_days").alias("interval"), F.col("ease_factor").alias("ease")
    )
    blocks = F.coalesce(F.transform("_blocks", lambda b: b["_fold"]), F.array().cast(folded.select(F.array("_fold")).schema[0].dataType))
    kept = [c for c in start.columns if c not in ("repetitions", "interval_days", "ease_factor")]
    # The fold is the output of a generator, so that a later filter on it (what is due) does not run it again.
    state = start.join(chained, card_id, "left").select(
        *kept, "_ts", F.inline(F.array(F.aggregate(blocks, initial, _carry_on)))
    ).withColumnsRenamed({"interval": "interval_days", "ease": "ease_factor"})
    reviewed = F.col("_ts").isNotNull()
    due = F.when(reviewed, due_after(F.col("_ts"), F.col("interval_days"))).otherwise(F.col("next_review"))
    return state.withColumns(
        {
            "next_review": due,
            "last_review": F.coalesce("_ts", "last_review"),
            "due_capped": reviewed & (F.col("interval_days") > MAX_DAYS),
        }
    ).select(*start.columns, "due_capped")


def valid_reviews(reviews: DataFrame, cards: DataFrame) -> DataFrame:
    """Add ``reason``: null if the review may be applied, else why not."""
    owners = cards.select("card_id", F.col("user_id").alias("_owner"))
    reason = (
        F.when(~F.col("quality").between(0, 5), "bad_quality")
        .when(F.col("_owner").isNull(), "not_found")
        .when(F.col("_owner") != F.col("user_id"), "forbidden")
    )
    return reviews.join(owners, "card_id", "left").withColumn("reason", reason).drop("_owner")


def due_cards(state: DataFrame, now: Column, limit: int = 20, user: int | None = None) -> DataFrame:
    """Cards due at ``now``, soonest first, at most ``limit`` per user.

    The rank filter becomes a per-partition limit before the shuffle, so a user with very many cards sends only a few.
    """
    due = state.filter(F.col("next_review") <= now)
    if user is not None:
        return due.filter(F.col("user_id") == user).orderBy("next_review", "card_id").limit(limit)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("next_review", "card_id"))
    return due.withColumn("rank", rank).filter(F.col("rank") <= limit)


def due_count(state: DataFrame, now: Column) -> DataFrame:
    return state.groupBy("user_id").agg(F.count_if(F.col("next_review") <= now).alias("due"))


def accept_cards(new: DataFrame, papers: DataFrame, now: Column) -> DataFrame:
    """Hand-made cards whose paper exists and belongs to the same user."""
    owned = new.join(papers.select("paper_id", "user_id"), ["paper_id", "user_id"], "left_semi")
    return owned.select(
        make_id("fc", F.col("paper_id"), F.col("user_id"), F.col("front"), F.col("back")).alias("card_id"),
        "paper_id",
        "user_id",
        "front",
        "back",
        normalize_tags(F.col("tags")).alias("tags"),
        F.coalesce("difficulty", F.lit(DIFFICULTY)).alias("difficulty"),
        F.lit(START_INTERVAL).alias("interval_days"),
        F.lit(START_EASE).alias("ease_factor"),
        F.lit(START_REPETITIONS).alias("repetitions"),
        now.alias("next_review"),
    )


def accept_annotations(new: DataFrame, papers: DataFrame) -> DataFrame:
    """Annotations whose paper exists and belongs to the same user."""
    owned = new.join(papers.select("paper_id", "user_id"), ["paper_id", "user_id"], "left_semi")
    return owned.withColumns(
        {
            "annotation_id": make_id("ann", F.col("paper_id"), F.col("user_id"), F.col("created_at"), F.col("content")),
            "tags": normalize_tags(F.col("tags")),
        }
    )
