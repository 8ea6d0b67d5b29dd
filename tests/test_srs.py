import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperlake.operators import srs as R
from paperlake.plans.bindings import now
from paperlake.session import stored
from pyspark.sql.types import StructType

from paperlake.streaming.reviews import apply_reviews, latest_state_stream, review_states, run_reviews
from paperlake.streaming.run import latest_rows

START = datetime(2024, 1, 1)
REVIEW = "card_id string, ts timestamp_ntz, review_id long, quality int"
CARD = "card_id string, user_id long, interval_days double, ease_factor double, repetitions int, next_review timestamp_ntz, last_review timestamp_ntz"


def logs(spark, qualities):
    rows = [(card, START + timedelta(hours=i), i, q) for card, qs in qualities.items() for i, q in enumerate(qs)]
    random.Random(1).shuffle(rows)
    cards = spark.createDataFrame([(c, 1, None, None, None, START, None) for c in qualities], CARD)
    return cards, spark.createDataFrame(rows, REVIEW)


def plain(qualities, repetitions=0, interval=1.0, ease=2.5):
    """SM-2 review by review."""
    for q in qualities:
        grown = {0: 1.0, 1: 6.0}.get(repetitions, interval * ease)
        repetitions, interval = (repetitions + 1, grown) if q >= 3 else (0, 1.0)
        ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    return repetitions, interval, ease


def close(row, state):
    repetitions, interval, ease = state
    assert row.repetitions == repetitions, row
    assert math.isclose(row.interval_days, interval, rel_tol=1e-9) and math.isclose(row.ease_factor, ease, rel_tol=1e-9), row


def test_anchor(spark):
    cards, reviews = logs(spark, {"a": [5, 4, 2, 3], "b": []})
    got = {r.card_id: r for r in R.review_state(cards, reviews).collect()}
    a = got["a"]
    assert (a.repetitions, a.interval_days, round(a.ease_factor, 6)) == (1, 1.0, 2.14)
    assert a.last_review == START + timedelta(hours=3) and a.next_review == a.last_review + timedelta(days=1)
    b = got["b"]
    assert (b.repetitions, b.interval_days, b.ease_factor, b.last_review) == (0, 1.0, 2.5, None) and b.next_review == START


def test_any_block_length_gives_the_same_state(spark):
    rng = random.Random(7)
    qualities = {f"c{i}": [rng.randint(0, 5) for _ in range(rng.randint(1, 60))] for i in range(12)}
    qualities |= {"good": [rng.choice([3, 4, 5, 5]) for _ in range(40)], "start": [4] * 5 + [5] * 6, "one": [2]}
    cards, reviews = logs(spark, qualities)
    stored_state = cards.withColumns(
        {"repetitions": F.when(F.col("card_id") == "good", 1), "ease_factor": F.when(F.col("card_id") == "start", 1.4)}
    )
    for days in (1 / 6, 1, 1_000_000):
        rows = {r.card_id: r for r in R.review_state(cards, reviews, block_days=days).collect()}
        assert rows.keys() == qualities.keys()
        for card, row in rows.items():
            close(row, plain(qualities[card]))
            assert row.last_review == START + timedelta(hours=len(qualities[card]) - 1)
        for row in R.review_state(stored_state, reviews, block_days=days).collect():
            close(row, plain(qualities[row.card_id], int(row.card_id == "good"), ease=1.4 if row.card_id == "start" else 2.5))


def test_due_date_beyond_the_calendar_stays_due_at_its_end(spark):
    cards, reviews = logs(spark, {"a": [5] * 40, "b": [5]})
    got = {r.card_id: r for r in R.review_state(cards, reviews).collect()}
    assert got["a"].due_capped and got["a"].next_review.year > 9000 and not got["b"].due_capped
    due = R.due_cards(R.review_state(cards, reviews), now("9998-01-01 00:00:00")).collect()
    assert {r.card_id for r in due} == {"a", "b"}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    qualities = {f"c{i}": [rng.randint(0, 5) for _ in range(20)] for i in range(6)}
    cards, reviews = logs(spark, qualities)
    cards = cards.withColumns({"interval_days": F.lit(15.0), "ease_factor": F.lit(2.0), "repetitions": F.lit(3)})
    sent = reviews.withColumn("user_id", F.lit(1).cast("bigint"))
    source = str(tmp_path / "in")
    # Three triggers, out of order, and a review of someone else's card.
    wrong = sent.limit(1).withColumns({"user_id": F.lit(2).cast("bigint"), "quality": F.lit(0)})
    for part in (sent.filter("review_id % 3 = 1"), sent.filter("review_id % 3 = 0").unionByName(wrong), sent.filter("review_id % 3 = 2")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = {r.card_id: r for r in apply_reviews(stream, cards).collect()}
    assert rows.keys() == qualities.keys()
    for card, row in rows.items():
        close(row, plain(qualities[card], 3, 15.0, 2.0))


def streamed(spark, folder, sent, parts):
    """A stream with a trigger for each of the conditions, in their order."""
    for part in parts:
        sent.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_reviews_are_dropped_and_counted(spark, tmp_path):
    qualities = {"a": [5, 4, 2, 3, 5, 1, 4, 4], "b": [3] * 8}
    cards, reviews = logs(spark, qualities)
    sent = reviews.withColumn("user_id", F.lit(1).cast("bigint"))
    hour = F.lit(START).cast("timestamp_ntz")
    sent = sent.withColumn("h", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(hour.cast("timestamp"))) / 3_600_000_000).cast("int"))
    # Hours 0 and 4 come, then 7 and 3 (in time), then, when the watermark is at 7 - 2, the late 1 and 5 and 6 in time.
    stream = streamed(spark, str(tmp_path / "in"), sent, ["h IN (0, 4)", "h IN (3, 7)", "h IN (1, 5, 6)"])
    run = run_reviews(stream.drop("h"), cards, delay="2 hours")
    assert run.late == 2
    rows = {r.card_id: r for r in run.rows.collect()}
    kept = sent.filter("h IN (0, 4, 3, 7, 5, 6)").drop("h", "user_id")
    for r in R.review_state(cards, kept).collect():
        own = rows[r.card_id]
        assert (own.repetitions, own.last_review, own.next_review) == (r.repetitions, r.last_review, r.next_review)
        assert abs(own.ease_factor - r.ease_factor) < 1e-9 and abs(own.interval_days - r.interval_days) < 1e-9


def test_settled_reviews_leave_the_state(spark, tmp_path):
    cards, reviews = logs(spark, {"a": [3] * 12})
    sent = reviews.withColumn("user_id", F.lit(1).cast("bigint"))
    stream = streamed(spark, str(tmp_path / "in"), sent, [f"review_id % 12 = {k}" for k in (*range(1, 12), 0)])
    run = latest_rows(review_states(stream, cards, "2 hours"), "card_id")
    rows = run.rows.collect()  # the first review comes last, which is too late
    assert len(rows) == 1 and rows[0].settled + rows[0].waiting == 11 and rows[0].waiting <= 4 and run.late == 1


def test_folders_of_triggers_are_folded(spark, tmp_path, monkeypatch):
    from paperlake.streaming import run as run_module

    monkeypatch.setattr(run_module, "FOLD_EVERY", 3)
    schema = "k string, v long"
    log = run_module.RowLog(spark, str(tmp_path / "log"), "k", StructType.fromDDL(schema))
    for number in range(11):
        log.write(spark.createDataFrame([("a", number), (f"b{number}", 0)], schema), number)
        log.write(spark.createDataFrame([("a", number), (f"b{number}", 1)], schema), number)  # tried again
        got = {r.k: r.v for r in log.read().collect()}
        assert got == {"a": number} | {f"b{k}": 1 for k in range(number + 1)}
    assert len(list((tmp_path / "log/rows").iterdir())) <= 6 and len(list((tmp_path / "log/base").iterdir())) <= 2


def test_closed_tasks_leave_the_state(spark, tmp_path):
    rows = [(f"t{k}", START + timedelta(hours=k), k, "completed" if k % 2 else "parsing", k) for k in range(20)]
    rows += [("t3", START + timedelta(hours=1), 100, "pending", 1)]  # older than what is there
    sent = spark.createDataFrame(rows, "task_id string, ts timestamp_ntz, seq long, status string, percent int")
    stream = streamed(spark, str(tmp_path / "in"), sent, [f"seq % 100 BETWEEN {4 * k} AND {4 * k + 3}" for k in range(5)])
    run = latest_rows(latest_state_stream(stream, "20 hours", keep_days=1 / 24), "task_id")
    found = {r.task_id: (r.status, r.seq, r.ts) for r in run.rows.collect()}
    assert len(found) == 20 and found["t3"] == ("completed", 3, START + timedelta(hours=3))
    kept = latest_rows(latest_state_stream(streamed(spark, str(tmp_path / "again"), sent, [f"seq % 100 BETWEEN {4 * k} AND {4 * k + 3}" for k in range(5)]), "2 hours", keep_days=1 / 24), "task_id")
    assert kept.rows.count() == 20  # all of them stay in the table
    assert kept.state_rows < run.state_rows


def test_stream_without_rows_is_an_empty_table(spark, tmp_path):
    cards, reviews = logs(spark, {"a": [3]})
    sent = reviews.withColumn("user_id", F.lit(1).cast("bigint"))
    source = tmp_path / "none"
    source.mkdir()
    assert apply_reviews(spark.readStream.schema(sent.schema).parquet(str(source)), cards).count() == 0


def test_due_cards_and_counts(spark):
    rows = [(f"c{i}", i % 2, START + timedelta(days=i)) for i in range(10)]
    state = spark.createDataFrame(rows, "card_id string, user_id long, next_review timestamp_ntz")
    at = now("2024-01-08 00:00:00")
    due = sorted((r.user_id, r["rank"], r.card_id) for r in R.due_cards(state, at, limit=2).collect())
    assert due == [(0, 1, "c0"), (0, 2, "c2"), (1, 1, "c1"), (1, 2, "c3")]
    assert [r.card_id for r in R.due_cards(state, at, limit=3, user=1).collect()] == ["c1", "c3", "c5"]
    assert {r.user_id: r.due for r in R.due_count(state, at).collect()} == {0: 4, 1: 4}


def test_reviews_and_cards_are_checked(spark):
    cards = spark.createDataFrame([("a", 1)], "card_id string, user_id long")
    sent = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("b", 1, 3), ("a", 2, 3)], "card_id string, user_id long, quality int")
    reasons = sorted((r.card_id, r.user_id, r.quality, r.reason) for r in R.valid_reviews(sent, cards).collect() if r.reason)
    assert reasons == [("a", 1, 6, "bad_quality"), ("a", 2, 3, "forbidden"), ("b", 1, 3, "not_found")]
    papers = spark.createDataFrame([("p", 1)], "paper_id string, user_id long")
    new = spark.createDataFrame(
        [("p", 1, "f", "b", "reading,important", None), ("p", 2, "f", "b", "", 1), ("q", 1, "f", "b", "", 1)],
        "paper_id string, user_id long, front string, back string, tags string, difficulty int",
    )
    (card,) = R.accept_cards(new, papers, now()).collect()
    assert card.tags == ["reading", "important"] and card.difficulty == 3 and card.ease_factor == 2.5


def test_stored_reads_back(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert stored(df).collect() == df.collect()


def test_a_card_costs_one_read_and_one_write_of_state():
    from types import SimpleNamespace

    from paperlake.streaming.reviews import _Reviews

    calls, value, timers = [], [None], set()
    state = SimpleNamespace(get=lambda: calls.append("get") or value[0], update=lambda x: calls.append("update") or value.__setitem__(0, x))
    handle = SimpleNamespace(
        getValueState=lambda name, schema: state,
        registerTimer=lambda at: calls.append("set") or timers.add(at), deleteTimer=lambda at: calls.append("unset") or timers.remove(at),
    )
    reviews, mark = _Reviews(), [0]
    reviews.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark[0])

    def sent(*rows):
        calls.clear()
        rows = [SimpleNamespace(at=at * 1000, review_id=at, quality=q, start_repetitions=0, start_interval=1.0, start_ease=2.5) for at, q in rows]
        return list(reviews.handleInputRows(("a",), iter(rows), clock))[0]

    row = sent((30, 4), (20, 5))
    assert calls == ["get", "set", "update"] and timers == {21} and (row.settled, row.waiting, row.at) == (0, 2, 30_000)
    row = sent((40, 2))  # the first that waits is the same
    assert calls == ["get", "update"] and (row.settled, row.waiting) == (0, 3)
    close(row, plain([5, 4, 2]))
    row = sent((10, 3))
    assert calls == ["get", "unset", "set", "update"] and timers == {11}
    close(row, plain([3, 5, 4, 2]))
    mark[0] = 35
    timers.clear()  # it has fired
    assert list(reviews.handleExpiredTimer(("a",), clock, None)) == [] and timers == {41}
    row = sent((50, 5))
    assert (row.settled, row.waiting) == (3, 2) and timers == {41}
    close(row, plain([3, 5, 4, 2, 5]))
