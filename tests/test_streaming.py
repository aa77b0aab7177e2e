from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import START, rows
from tidemark.operators import changesets as cs
from tidemark.operators.capture import capture_keyed_changes
from tidemark.schemas import CHANGELOG
from tidemark.session import materialise, streaming_session
from tidemark.streaming.capture import capture_stream, captured_rows, late_rows
from tidemark.streaming.changesets import (
    changesets_of,
    late_entries,
    stream_changesets,
    streamed_entries,
    streamed_versions,
)
from tidemark.streaming.late import corrected
from tidemark.streaming.run import run_available
from tidemark.streaming.sessions import collect_sessions, stream_sessions, streamed_rows, streamed_sessions
from tidemark.streaming.store import Commit, Store

LOG_KEYS = ["id", "entity_type", "entity_id", "transaction_id", "created_at"]


def run(spark, tmp_path, batches, build):
    """Each batch becomes available only after the query has stopped on the one before."""
    session = streaming_session(spark)
    for number, batch in enumerate(batches):
        batch.write.parquet(str(tmp_path / "in" / str(number)))
        stream = (
            session.readStream.schema(batch.schema)
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        result = run_available(build(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(result.schema).parquet(str(tmp_path / "out"))


def run_into(spark, tmp_path, batches, start, read):
    """The same for a query that keeps its tables in a store."""
    session = streaming_session(spark)
    for number, batch in enumerate(batches):
        batch.write.parquet(str(tmp_path / "in" / str(number)))
        stream = (
            session.readStream.schema(batch.schema)
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return read(spark, str(tmp_path / "out"))


@pytest.fixture
def log_of(make_log):
    def make(*entries, first=1):
        made = make_log(*entries).select(*LOG_KEYS)
        return made.withColumn("id", made["id"] + first - 1)

    return make


FAR = ("end", 10**10, {"entity_id": "sentinel"})


def test_sessions_close_behind_the_watermark(spark, tmp_path, log_of):
    batches = [
        log_of(("a1", 0), ("a2", 500), ("a3", 1001)),
        # the second row is later than the delay and is left out
        log_of(("a4", 60_000), first=4),
        log_of(("a5", 100), FAR, first=5),
    ]
    found = run(spark, tmp_path, batches, lambda s: stream_sessions(s, 500, "5 seconds"))
    found = found.filter("entity_id <> 'sentinel'")
    assert rows(found, "transaction_id", "n_operations", "is_autocommit_grouped") == [
        ("a1", 2, True), ("a3", 1, False), ("a4", 1, False),
    ]


def test_collected_sessions_equal_native_ones_and_keep_late_rows(spark, tmp_path, log_of):
    batches = [
        log_of(("a1", 0), ("a2", 500), ("a3", 1001)),
        log_of(("a4", 60_000), first=4),
        log_of(("a5", 100), ("a6", 60_400), FAR, first=5),
    ]
    found = run_into(
        spark, tmp_path, batches, lambda s, *to: collect_sessions(s, *to, 500, 5_000), streamed_sessions
    ).filter("entity_id <> 'sentinel'")
    assert rows(found, "transaction_id", "n_operations", "is_autocommit_grouped") == [
        ("a1", 2, True), ("a3", 1, False), ("a4", 2, True),
    ]
    arrived = streamed_rows(spark, str(tmp_path / "out"))
    assert rows(arrived.filter("is_late"), "transaction_id") == [("a5",)]
    assert arrived.count() == 7


def random_log(spark, seed=11):
    random.seed(seed)
    entries = []
    for number in range(400):
        tx = f"x{number // 9}" if random.random() < 0.4 else f"a{number}"
        at = START + timedelta(milliseconds=number * 40 + random.randrange(40))
        entity = "0" if random.random() < 0.4 else str(random.randrange(4))
        entries.append((number, "vessel", entity, "t", "1", "UPDATE", None, None, tx, at))
    return spark.createDataFrame(entries, CHANGELOG)


def end_of_log(spark):
    return spark.createDataFrame(
        [(-1, "vessel", "sentinel", "t", "1", "UPDATE", None, None, "end", START + timedelta(days=9))],
        CHANGELOG,
    )


# All scopes through windows; all above 20 rows through range pieces.
@pytest.mark.parametrize("heavy_rows", [2_000_000, 20])
def test_changesets_equal_batch(spark, tmp_path, heavy_rows):
    log = random_log(spark)
    batches = [
        log.filter("id < 150"),
        log.filter("id >= 150 and id < 300"),
        log.filter("id >= 300").unionByName(end_of_log(spark)),
    ]

    def start(stream, *to):
        return stream_changesets(stream, *to, 100, 2_000, 1_000, heavy_rows=heavy_rows)

    found = run_into(spark, tmp_path, batches, start, streamed_versions).filter("entity_id <> 'sentinel'")
    built = cs.build_changesets(log, 100)
    assert rows(changesets_of(found)) == rows(built)
    assert late_entries(spark, str(tmp_path / "out")).count() == 0


def test_a_batch_of_light_entities_stores_its_rows_twice(spark, tmp_path, monkeypatch):
    """F8: groups, horizons, numbers and last versions come from one reading of the open transactions."""
    log, names = random_log(spark, 13), []

    def stored(df, name):
        names.append(name)
        return materialise(df, name)

    monkeypatch.setattr("tidemark.streaming.changesets.materialise", stored)
    batches = [log.filter("id < 200"), log.filter("id >= 200").unionByName(end_of_log(spark))]
    found = run_into(
        spark, tmp_path, batches, lambda s, *to: stream_changesets(s, *to, 100, 2_000, 1_000), streamed_versions
    ).filter("entity_id <> 'sentinel'")
    assert rows(changesets_of(found)) == rows(cs.build_changesets(log, 100))
    assert names == ["open", "placed"] * 2


def test_last_versions_of_null_scopes_go_on(spark, tmp_path, log_of):
    """An entity without an id, in a scope of its own, is numbered on from batch to batch."""
    nameless = lambda df: df.withColumn("entity_id", F.lit(None).cast("string"))
    batches = [
        nameless(log_of(("tx1", 0), ("tx1", 10))),
        nameless(log_of(("tx2", 9_000), ("tx2", 9_010), first=3)),
        log_of(("end", 99_000), first=6),
    ]
    found = run_into(
        spark, tmp_path, batches, lambda s, *to: stream_changesets(s, *to, 500, 2_000, 1_000), streamed_versions
    ).filter("entity_id IS NULL")
    assert rows(found, "version", "transaction_id", "rows") == [(1, "tx1", 2), (2, "tx2", 2)]


def test_changesets_wait_split_and_keep_late_rows(spark, tmp_path, log_of):
    batches = [
        log_of(("tx1", 0), ("tx1", 10), ("a1", 400)),
        log_of(("a2", 5_000), first=4),
        # tx1 was closed after its timeout; its rest counts as another changeset
        log_of(("tx1", 9_000), ("tx2", 9_100), ("tx2", 9_200), first=5),
        log_of(("late", 50), FAR, first=8),
    ]
    found = run_into(
        spark, tmp_path, batches, lambda s, *to: stream_changesets(s, *to, 500, 2_000, 1_000), streamed_versions
    ).filter("entity_id <> 'sentinel'")
    assert rows(found, "version", "transaction_id", "rows") == [
        (1, "tx1", 2), (2, "a1", 1), (3, "a2", 1), (4, "tx1", 1), (5, "tx2", 2),
    ]
    assert rows(late_entries(spark, str(tmp_path / "out")), "transaction_id") == [("late",)]


def test_late_rows_are_kept_and_put_right(spark, tmp_path):
    log = random_log(spark, 12)
    late = "id % 40 = 3 and id < 200 and entity_id <> '2'"
    batches = [
        log.filter(f"id < 250 and not ({late})"),
        log.filter(f"id >= 250 or ({late})").unionByName(end_of_log(spark)),
    ]
    found = run_into(
        spark, tmp_path, batches, lambda s, *to: stream_changesets(s, *to, 100, 2_000, 1_000), streamed_versions
    ).filter("entity_id <> 'sentinel'")
    arrived = streamed_entries(spark, str(tmp_path / "out")).filter("entity_id <> 'sentinel'")
    assert rows(arrived, "id") == rows(log, "id")
    behind = late_entries(spark, str(tmp_path / "out"))
    assert rows(behind, "id") == rows(log.filter(late), "id") and behind.count() > 2
    streamed = changesets_of(found)
    right = corrected(log, behind, streamed, lambda entries: cs.build_changesets(entries, 100))
    assert rows(streamed) != rows(cs.build_changesets(log, 100))
    assert rows(right) == rows(cs.build_changesets(log, 100))


def test_a_failed_batch_leaves_nothing_and_a_repeated_one_adds_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    frame = spark.range(3)
    store.open(spark, out=frame.schema)

    def fails(batch, last):
        store.write(batch, "out")
        raise ValueError("lost")

    with pytest.raises(ValueError):
        store.advance(frame, 0, fails)
    assert Store(store.folder).added(spark, "out").count() == 0
    step = lambda batch, last: Commit(0, {"s": [store.write(batch, "s")]}, {"out": [store.write(batch, "out")]}, 5)
    store.advance(frame, 0, step)
    for again in (store, Store(store.folder)):
        again.advance(frame, 0, step)
        assert again.added(spark, "out").count() == 3 and again.state(spark, "s", frame.schema).count() == 3
        assert again.last(spark).watermark_ms == 5
    store.open(spark, out=frame.schema)
    assert store.added(spark, "out").count() == 3


def test_a_query_stopped_in_mid_batch_goes_on(spark, tmp_path, monkeypatch):
    log = random_log(spark, 13)
    batches = [log.filter("id < 200"), log.filter("id >= 200").unionByName(end_of_log(spark))]
    commit, calls = Store._commit, []

    def lost_once(store, spark, made):
        calls.append(made.batch)
        if calls.count(1) == 1 and made.batch == 1:
            raise ValueError("the driver is gone")
        commit(store, spark, made)

    monkeypatch.setattr(Store, "_commit", lost_once)
    start = lambda s, *to: stream_changesets(s, *to, 100, 2_000, 1_000)
    with pytest.raises(Exception, match="the driver is gone"):
        run_into(spark, tmp_path, batches, start, streamed_versions)
    session = streaming_session(spark)
    stream = session.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = streamed_versions(spark, str(tmp_path / "out")).filter("entity_id <> 'sentinel'")
    assert rows(changesets_of(found)) == rows(cs.build_changesets(log, 100))


@pytest.mark.parametrize("heavy_rows", [2_000_000, 2])
def test_capture_keeps_the_last_image(spark, tmp_path, heavy_rows):
    schema = "table_name string, row_id string, seq long, image string"
    changes = [("t", "1", 1, "a"), ("t", "2", 2, "x"), ("t", "1", 4, None), ("t", "1", 3, "b"),
               ("t", "1", 5, "c"), ("t", "2", 6, "y"), ("t", "1", 7, "d"), (None, "1", 8, "n"), ("t", "3", 9, None)]
    batches = [
        spark.createDataFrame(changes[:4], schema),
        spark.createDataFrame([*changes[4:], ("t", "1", 2, "old"), ("t", "1", 7, "e"), ("t", "1", None, "f")], schema),
        spark.createDataFrame([("t", "1", 7, "g"), ("t", "2", 10, None)], schema),
    ]

    def start(stream, *to):
        return capture_stream(stream, *to, ["table_name", "row_id"], buckets=3, heavy_rows=heavy_rows)

    found = run_into(spark, tmp_path, batches, start, captured_rows)
    applied, late = late_rows(found)
    batch = capture_keyed_changes(
        spark.createDataFrame([*changes, ("t", "2", 10, None)], schema), ["table_name", "row_id"], "seq"
    )
    assert rows(applied) == rows(batch)
    assert rows(late, "seq", "old_values", "new_values") == [
        (2, None, "old"), (7, None, "e"), (7, None, "g"), (None, None, "f"),
    ]


def test_captured_stream_becomes_changesets(spark, tmp_path):
    """Upserts to operations, to owners, to transaction ids, to the stored log, to history."""
    from tidemark.operators.capture import assign_transaction_id, resolve_entity_ids
    from tidemark.schemas import ENTITY_MAP
    from tidemark.sources.changelog import read_changelog, write_changelog

    entity_map = spark.createDataFrame(
        [("vessel", "vessel", True, "id", ["id"]), ("vessel", "cabin", False, "vesselId", ["id"])], ENTITY_MAP
    )
    schema = "table_name string, row_id string, seq long, image string, transaction_id string, created_at timestamp"
    at = lambda n: START + timedelta(seconds=n)
    batches = [
        spark.createDataFrame([("vessel", "7", 1, '{"id":7}', "t1", at(0)), ("cabin", "1", 2, '{"id":1,"vesselId":7}', "t1", at(0))], schema),
        spark.createDataFrame([("cabin", "1", 3, '{"id":1,"vesselId":7,"deck":2}', None, at(9)), ("vessel", "7", 4, None, None, at(20))], schema),
    ]
    found = run_into(spark, tmp_path, batches, lambda s, *to: capture_stream(s, *to, ["table_name", "row_id"], buckets=2), captured_rows)
    applied, _ = late_rows(found)
    owned = resolve_entity_ids(assign_transaction_id(applied), entity_map).withColumnRenamed("seq", "id")
    write_changelog(owned, str(tmp_path / "log"))
    log = read_changelog(spark, str(tmp_path / "log"))
    assert rows(log, "id", "operation", "entity_id") == [(1, "INSERT", "7"), (2, "INSERT", "7"), (3, "UPDATE", "7"), (4, "DELETE", "7")]
    assert rows(cs.build_changesets(log), "version", "n_operations") == [(1, 2), (2, 1), (3, 1)]


def test_feed_streams_into_the_stored_changelog(spark, tmp_path):
    from tidemark.operators.capture import capture_change_feed
    from tidemark.schemas import ENTITY_MAP
    from tidemark.sources.changelog import append_stream, read_changelog

    session = streaming_session(spark)
    schema = (
        "seq long, table_name string, operation string, old_values string, new_values string, "
        "transaction_id string, created_at timestamp"
    )
    entity_map = session.createDataFrame([("vessel", "cabin", False, "vesselId", ["id"])], ENTITY_MAP)
    for number in (1, 2):
        image = f'{{"id":{number},"vesselId":618}}'
        row = (number, "cabin", "INSERT", None, image, None, START + timedelta(days=number))
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = append_stream(
            capture_change_feed(stream, entity_map), str(tmp_path / "log"), str(tmp_path / "state")
        )
        query.awaitTermination()
    stored = read_changelog(spark, str(tmp_path / "log"))
    assert rows(stored, "id", "entity_id", "row_id") == [(1, "618", "1"), (2, "618", "2")]
    assert (tmp_path / "log" / "entity_type=vessel" / "created_date=2031-07-10").is_dir()
