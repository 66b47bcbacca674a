"""Quotas whose state ends with the day, appends that happen once, and rosters that change under a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lyceum.streaming import events as S
from lyceum.streaming import ledger, quota

EVENTS = "event_id long, user_id long, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, quota.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def test_state_of_idle_users_is_gone_after_a_day(rocks, tmp_path):
    spark = rocks
    batches = [
        [(3, 1, at(1, 9)), (1, 1, at(1, 8)), (2, 1, at(1, 8)), (4, 2, at(1, 9))],
        [(5, 1, at(1, 12)), (6, 1, at(2, 1))],
        [(7, 3, at(5))],
        [(8, 3, at(5, 1))],
        [(9, 1, at(5, 2))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source, state = tmp_path / "src", str(tmp_path / "state")
    source.mkdir()
    got, left = [], []
    for i in range(len(batches)):
        next((tmp_path / f"in/{i}").glob("part-*")).rename(source / f"{i}.parquet")
        stream = quota.capped(spark.readStream.schema(EVENTS).parquet(str(source)), 2)
        q = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).start()
        q.awaitTermination()
        left.append(sorted((r.key.user_id, r.user_map_key.day, r.user_map_value.n) for r in spark.read.format("statestore").option("path", state).option("stateVarName", "days").load().collect()))
    day = lambda d: dt.date(2024, 1, d)
    assert sorted(got) == [(1, 1, day(1), 1, True), (2, 1, day(1), 2, True), (3, 1, day(1), 3, False), (4, 2, day(1), 1, True), (5, 1, day(1), 4, False), (6, 1, day(2), 1, True), (7, 3, day(5), 1, True), (8, 3, day(5), 2, True), (9, 1, day(5), 1, True)]
    assert [len({u for u, _, _ in x}) for x in left][:2] == [2, 2] and {(u, n) for u, _, n in left[-1]} == {(3, 2), (1, 1)}


def test_days_of_a_block_are_one_entry(rocks, tmp_path):
    """A batch writes an entry of the state for a block of days, not for each day; numbers go on in later batches, whatever block they lie in."""
    spark = rocks
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    batches = [[(i, 1, d) for i, d in enumerate(days)], [(100 + i, 1, d) for i, d in enumerate(days)], [(200, 2, dt.datetime(2024, 6, 1))], [(300, 2, dt.datetime(2024, 6, 1, 1))]]
    source, state = tmp_path / "src", str(tmp_path / "state")
    source.mkdir()
    got, left = [], []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        next((tmp_path / f"in/{i}").glob("part-*")).rename(source / f"{i}.parquet")
        stream = quota.capped(spark.readStream.schema(EVENTS).parquet(str(source)), 1, late="90 days")
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).start().awaitTermination()
        left.append([(r.key.user_id, r.user_map_value.n) for r in spark.read.format("statestore").option("path", state).option("stateVarName", "days").load().collect()])
    want = [(i, 1, d.date(), 1, True) for i, d in enumerate(days)] + [(100 + i, 1, d.date(), 2, False) for i, d in enumerate(days)]
    assert sorted(got) == want + [(200, 2, dt.date(2024, 6, 1), 1, True), (300, 2, dt.date(2024, 6, 1), 2, False)]
    assert all(len(x) <= 3 for x in left) and [sum(n for u, n in x if u == 1) for x in left[:2]] == [60, 120]
    # 90 days before the first of June is the third of March, after the first user's days.
    assert left[-1] == [(2, 2)]


def test_a_batch_is_added_once(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "log"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert book.read("v int").count() == 0
    assert book.append("asks", 0, rows(1, 2)) and not book.append("asks", 0, rows(1, 2, 3)) and book.append("other", 0, rows(9))
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # dead between the rows and the entry
        m.setattr(book.store, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        book.append("asks", 1, rows(3, 4))
    assert sorted(r.v for r in book.read("v int").collect()) == [1, 2, 9]
    again = ledger.Ledger(spark, str(tmp_path / "log"))
    put = again.sink("asks", lambda df: df.filter("v > 3"))
    put(rows(3, 4), 1)
    put(rows(3, 4), 1)
    assert sorted(r.v for r in again.read("v int").collect()) == [1, 2, 4, 9]


def test_a_removed_student_is_refused_in_the_next_batch(spark, tmp_path):
    roster = ledger.Refreshed(spark, str(tmp_path / "roster"), "students")
    book = ledger.Ledger(spark, str(tmp_path / "log"), "day")
    source = tmp_path / "src"
    source.mkdir()
    schema = "id long, email string, ts timestamp"

    def ask(n, *emails):
        spark.createDataFrame([(10 * n + i, e, at(n)) for i, e in enumerate(emails)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        next((tmp_path / f"in/{n}").glob("part-*")).rename(source / f"{n}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(source))
        ledger.gate_stream(stream, roster, book, "asks", str(tmp_path / "state"), day=F.to_date("ts")).awaitTermination()

    with pytest.raises(FileNotFoundError):
        roster.now()
    roster.publish(spark.createDataFrame([("a@x.org",), ("b@x.org",), ("b@x.org",), (None,)], "email string"))
    ask(1, "a@x.org", "b@x.org", None, "c@x.org")
    roster.publish(spark.createDataFrame([("a@x.org",)], "email string"))
    ask(2, "a@x.org", "b@x.org")
    got = {r.id: r.admitted for r in book.read("id long, email string, ts timestamp, admitted boolean, day date").collect()}
    assert got == {10: True, 11: True, 12: False, 13: False, 20: True, 21: False}


def test_sources_read_what_is_there(spark):
    assert S.source(spark, "/root/testdata/sf0.001/events.parquet").isStreaming
