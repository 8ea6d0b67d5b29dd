"""Review state and task state as streams that can run for months: keyed state, timers, bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from paperlake.operators.knowledge import START_EASE, START_INTERVAL, START_REPETITIONS
from paperlake.operators.srs import MAX_DAYS, MIN_EASE, due_after, valid_reviews
from paperlake.schemas import TASK_STATES_CLOSED
from paperlake.session import stored
from paperlake.streaming.run import LatestRows, latest_rows

#: How far behind the latest review one may come and still take its place in the order.
DELAY = "30 days"

_STATE = "card_id string, repetitions int, interval_days double, ease_factor double, at long, settled long, waiting long"


def review_step(state: tuple[int, float, float], quality: int) -> tuple[int, float, float]:
    """SM-2: (repetitions, interval, ease) after one review."""
    repetitions, interval, ease = state
    if quality >= 3:
        interval = 1.0 if repetitions == 0 else 6.0 if repetitions == 1 else interval * ease
        repetitions += 1
    else:
        repetitions, interval = 0, 1.0
    miss = 5 - quality
    return repetitions, interval, max(MIN_EASE, ease + 0.1 - miss * (0.08 + miss * 0.02))


class _Reviews(StatefulProcessor):
    """The settled state of a card, and its reviews that the watermark has not passed yet.

    A review may still come between those that wait, so they are folded in order for every update but stay apart. A
    timer at the first of them settles what the watermark has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, so that a key costs one read and one write: each call goes to the state store and back.
        self.card = handle.getValueState(
            "card", "repetitions int, interval double, ease double, at long, reviews long, timer long, "
            "waiting array<struct<at: long, review_id: long, quality: int>>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, start = [], None
        for row in rows:
            new.append((row.at, row.review_id, row.quality))
            start = start or (row.start_repetitions, row.start_interval, row.start_ease, None, 0)
        card = self.card.get()
        *known, timer, waiting = card if card is not None else (*start, None, [])
        known, waiting = self._settle(
            tuple(known), [tuple(x) for x in waiting] + new, timer, timerValues.getCurrentWatermarkInMs()
        )
        state, at = known[:3], known[3]
        for at, _, quality in waiting:
            state = review_step(state, quality)
        yield Row(
            card_id=key[0], repetitions=state[0], interval_days=state[1], ease_factor=state[2], at=at,
            settled=known[4], waiting=len(waiting),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *known, _, waiting = self.card.get()
        self._settle(tuple(known), [tuple(x) for x in waiting], None, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def _settle(
        self, known: tuple, waiting: list[tuple], timer: int | None, watermark: int
    ) -> tuple[tuple, list[tuple]]:
        """Fold the reviews before the watermark into the settled state; keep the others, in order. ``timer`` is the one
        that is set, which stays if the first review that waits is the same."""
        waiting.sort()
        passed = sum(1 for at, _, _ in waiting if at < watermark * 1000)
        state, at = known[:3], known[3]
        for at, _, quality in waiting[:passed]:
            state = review_step(state, quality)
        known, waiting = (*state, at, known[4] + passed), waiting[passed:]
        due = waiting[0][0] // 1000 + 1 if waiting else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.card.update((*known, due, waiting))
        return known, waiting

    def close(self) -> None:
        pass


def review_states(reviews: DataFrame, cards: DataFrame, delay: str = DELAY) -> DataFrame:
    """Stream of review states: a row for every card that a trigger brings reviews of, by keyed state.

    ``reviews``: streaming (card_id, user_id, ts, review_id, quality); ``cards``: the stored states to start from.
    Reviews of bad quality, of unknown cards or of someone else's are left out. A trigger reads its own reviews and the
    states of their cards, however long the log has grown; of a card's log only the reviews within ``delay`` are held.
    Later ones are dropped by the watermark and counted by the stream (``numRowsDroppedByWatermark``).

    Columns: card_id, repetitions, interval_days, ease_factor, at (microseconds of the last review), settled and waiting
    (reviews that are final, and that an earlier one may still come before). Use output mode ``update``.
    """
    start = cards.select(
        "card_id", F.coalesce("repetitions", F.lit(START_REPETITIONS)).alias("start_repetitions"),
        F.coalesce("interval_days", F.lit(START_INTERVAL)).alias("start_interval"),
        F.coalesce("ease_factor", F.lit(START_EASE)).alias("start_ease"),
    )
    seen = F.col("ts").cast("timestamp")
    valid = valid_reviews(reviews, cards).filter(F.col("reason").isNull()).join(start, "card_id")
    timed = valid.select(
        "card_id", "review_id", F.col("quality").cast("int").alias("quality"), seen.alias("seen"),
        F.unix_micros(seen).alias("at"), "start_repetitions", "start_interval", "start_ease",
    )
    return timed.withWatermark("seen", delay).groupBy("card_id").transformWithState(
        _Reviews(), _STATE, outputMode="Update", timeMode="EventTime"
    )


def run_reviews(reviews: DataFrame, cards: DataFrame, delay: str = DELAY) -> LatestRows:
    """Run :func:`review_states` until the source is used up. ``rows`` has the current state of every card that was
    reviewed, in the columns of ``cards`` and ``due_capped``, as :func:`srs.review_state` gives it for the same reviews;
    ``late`` is how many came too late."""
    cards = stored(cards)  # every trigger joins them
    run = latest_rows(review_states(reviews, cards, delay), "card_id")
    kept = [c for c in cards.columns if c not in ("repetitions", "interval_days", "ease_factor", "next_review", "last_review")]
    last = F.timestamp_micros("at").cast("timestamp_ntz")
    state = run.rows.join(cards.select(*kept), "card_id").withColumn("last_review", last)
    state = state.withColumn("next_review", due_after(F.col("last_review"), F.col("interval_days")))
    state = state.withColumn("due_capped", F.col("interval_days") > MAX_DAYS)
    fields = [*cards.schema.fields, StructField("due_capped", BooleanType())]
    rows = state.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType(fields)])
    return LatestRows(rows, run.late, run.state_rows)


def apply_reviews(reviews: DataFrame, cards: DataFrame, delay: str = DELAY) -> DataFrame:
    """State of every card that a stream of reviews reached, when its source is used up (:func:`run_reviews`)."""
    return run_reviews(reviews, cards, delay).rows


class _Tasks(StatefulProcessor):
    """The last update of a task; forgotten a while after the task has closed."""

    def __init__(self, columns: list[tuple[str, str]], keep_ms: int) -> None:
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"`{c}` {kind}" for c, kind in self.columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c for c, _ in self.columns]
        at, seq, status = names.index("_at"), names.index("seq"), names.index("status")
        best = tuple(self.last.get()) if self.last.exists() else None
        for row in rows:
            new = tuple(row[c] for c in names)
            if best is None or (new[at], new[seq]) >= (best[at], best[seq]):
                best = new
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[status] in TASK_STATES_CLOSED:
            until = max(best[at] // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(until)
        yield Row(task_id=key[0], **dict(zip(names, best, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_state_stream(progress: DataFrame, delay: str = "7 days", keep_days: float = 1.0) -> DataFrame:
    """Current state of each task from a stream of updates; the last by (ts, seq) wins. Use output mode ``update``.

    A closed task is forgotten ``keep_days`` after its last update, when the watermark (``delay`` behind the latest
    update) has passed that; so state holds open tasks and recently closed ones, and closed tasks stay in the sink.
    Updates that come later than ``delay`` are dropped and counted.
    """
    seen = F.col("ts").cast("timestamp")
    timed = progress.withColumns({"_seen": seen, "_at": F.unix_micros(seen)})
    kept = [c for c in progress.columns if c not in ("task_id", "ts")]
    kinds = dict(progress.dtypes)
    columns = [("_at", "bigint"), *[(c, kinds[c]) for c in kept]]
    shape = ", ".join(f"`{c}` {kind}" for c, kind in [("task_id", kinds["task_id"]), *columns])
    states = timed.select("task_id", "_seen", "_at", *kept).withWatermark("_seen", delay).groupBy("task_id").transformWithState(
        _Tasks(columns, int(keep_days * 86_400_000)), shape, outputMode="Update", timeMode="EventTime"
    )
    return states.withColumn("ts", F.timestamp_micros("_at").cast(kinds["ts"])).select(*progress.columns)
