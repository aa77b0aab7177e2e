"""Snapshot store and refresh, keys found from values, several databases, times without zone."""

from __future__ import annotations

from datetime import timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import START, rows
from tidemark.operators import changesets as cs
from tidemark.operators import drift
from tidemark.operators.capture import unmapped_changes
from tidemark.schemas import CATALOG
from tidemark.sources import profile, snapshots
from tidemark.sources.catalog import schema_snapshot
from tidemark.sources.changelog import read_changelog

LEDGER = [("id", "bigint", False, True), ("amount", "numeric", True, False)]


def catalog_of(spark, **tables):
    described = [("app", name, n, *c) for name, columns in tables.items() for n, c in enumerate(columns, start=1)]
    return spark.createDataFrame(described, CATALOG)


@pytest.fixture
def stores(tmp_path):
    return str(tmp_path / "snapshots"), str(tmp_path / "changelog")


def test_snapshots_are_kept_once(spark, stores):
    taken = schema_snapshot(catalog_of(spark, ledger=LEDGER, audit=LEDGER[:1]), "2026-01-01 00:00:00")
    assert snapshots.read_snapshots(spark, stores[0]).count() == 0
    snapshots.write_snapshots(taken.filter("table_name = 'ledger'"), stores[0])
    for _ in range(2):
        snapshots.write_snapshots(taken, stores[0])
    kept = snapshots.read_snapshots(spark, stores[0])
    assert rows(kept, "table_name") == [("audit",), ("ledger",)]
    assert rows(drift.latest_snapshot(kept), "table_name", "columns") == rows(taken, "table_name", "columns")


def test_refresh_records_each_change_once(spark, stores):
    snapshots.write_snapshots(schema_snapshot(catalog_of(spark, ledger=LEDGER, audit=LEDGER), "2026-01-01 00:00:00"), stores[0])
    wider = catalog_of(spark, ledger=[*LEDGER, ("note", "text", True, False)])
    found = snapshots.refresh(wider, *stores, "2026-02-01 00:00:00")
    assert rows(found, "table_name", "added_columns", "removed_columns") == [("audit", [], ["id", "amount"]), ("ledger", ["note"], [])]
    assert rows(snapshots.refresh(wider, *stores, "2026-02-02 00:00:00")) == []
    log, kept = read_changelog(spark, stores[1]), snapshots.read_snapshots(spark, stores[0])
    assert log.count() == 2 and kept.count() == 4
    assert rows(log, "id") == rows(kept.filter("captured_at > '2026-01-15'"), "id")
    back = catalog_of(spark, ledger=LEDGER, audit=LEDGER)
    assert snapshots.refresh(back, *stores, "2026-03-01 00:00:00").count() == 2
    assert read_changelog(spark, stores[1]).count() == 4 and snapshots.read_snapshots(spark, stores[0]).count() == 6


def test_a_half_done_refresh_is_finished(spark, stores, monkeypatch):
    snapshots.write_snapshots(schema_snapshot(catalog_of(spark, ledger=LEDGER), "2026-01-01 00:00:00"), stores[0])
    narrower = catalog_of(spark, ledger=LEDGER[:1])
    catch_up, calls = snapshots._catch_up, []

    def lost(*arguments):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("lost")
        catch_up(*arguments)

    monkeypatch.setattr(snapshots, "_catch_up", lost)
    with pytest.raises(ValueError):
        snapshots.refresh(narrower, *stores, "2026-02-01 00:00:00")
    assert read_changelog(spark, stores[1]).count() == 1 and snapshots.read_snapshots(spark, stores[0]).count() == 1
    # Another time: the change is not recorded again.
    assert snapshots.refresh(narrower, *stores, "2026-02-05 00:00:00").count() == 0
    assert read_changelog(spark, stores[1]).count() == 1 and snapshots.read_snapshots(spark, stores[0]).count() == 2


def test_keys_and_references_are_found_from_values(spark):
    ports = spark.createDataFrame([(n, f"P{n}", n % 3, 0.5, None) for n in range(400)], "`port.id` int, code string, zone int, depth double, none long")
    calls = spark.createDataFrame(
        [(n, n % 390, f"P{n % 7}", None if n % 5 == 0 else n % 400, n % 401) for n in range(6000)],
        "id long, port long, code string, `next port` int, wrong int",
    )
    keys = profile.find_keys(ports)
    assert rows(keys.filter("is_unique"), "column_name", "n_rows") == [("code", 400), ("port.id", 400)]
    assert keys.count() == 5
    found = profile.discover_foreign_keys({"ports": ports, "calls": calls})
    want = {("calls", c, "ports", "port.id") for c in ("port", "next port")} | {("calls", "code", "ports", "code"), ("ports", "zone", "ports", "port.id")}
    want |= {("ports", c, "calls", "id") for c in ("port.id", "zone")} | {("calls", c, "calls", "id") for c in ("port", "next port", "wrong")}
    assert {tuple(r)[:4] for r in found.collect()} == want
    assert rows(profile.discover_foreign_keys({"ports": ports.limit(0)})) == []
    assert rows(profile.find_keys(ports.limit(0)).filter("n_rows > 0")) == []


def test_sketches_of_large_columns_lose_no_reference(spark):
    parents = spark.range(60_000).select((F.col("id") * 7).alias("key"))
    children = spark.range(150_000).select((F.col("id") % 50_000 * 7).alias("parent"), (F.col("id") % 50_000 * 7 + F.when(F.col("id") == 9, 1).otherwise(0)).alias("orphan"))
    found = profile.discover_foreign_keys({"parents": parents, "children": children})
    assert rows(found, "from_column", "to_column") == [("parent", "key")]


def test_histories_of_databases_do_not_melt(spark, make_log):
    log = make_log(("t1", 0), ("t1", 5), ("t2", 9_000), ("t3", 20_000))
    fleet = log.withColumn("schema_name", F.when(F.col("id") % 2 == 0, "north").otherwise("south"))
    history = cs.entity_history(fleet, "vessel", "618")
    assert rows(history, "schema_name", "id", "version") == [("north", 2, 1), ("north", 4, 2), ("south", 1, 1), ("south", 3, 2)]
    assert rows(cs.entity_history(fleet, "vessel", "618", schema_name="north"), "id", "version") == [(2, 1), (4, 2)]
    expected = spark.createDataFrame([("north", "vessel", "vessel"), ("east", "vessel", "vessel")], "schema_name string, entity_type string, table_name string")
    assert rows(drift.capture_coverage(expected, fleet), "schema_name", "entries") == [("east", 0), ("north", 2)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times_without_zone_are_utc(spark, make_log, zone):
    log = make_log(("a", 0), ("b", 400), ("c", 2_000))
    want = [(1, 2), (2, 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        bare = spark.createDataFrame([tuple(r) for r in log.select("id", "transaction_id").collect()], "id long, transaction_id string")
        spark.conf.set("spark.sql.session.timeZone", zone)
        offsets = F.when(F.col("id") == 1, 0).when(F.col("id") == 2, 400).otherwise(2_000)
        base = F.lit(START.isoformat(sep=" ")).cast("timestamp_ntz")
        at = base + F.make_dt_interval(secs=offsets / 1000)
        ntz = bare.select("id", F.lit("vessel").alias("entity_type"), F.lit("618").alias("entity_id"), "transaction_id", at.cast("timestamp_ntz").alias("created_at"))
        built = cs.build_changesets(ntz)
        assert rows(built, "version", "n_operations") == want
        micros = built.select(F.unix_millis("timestamp").alias("ms")).filter("version = 1").first()["ms"]
        assert micros == round(START.replace(tzinfo=timezone.utc).timestamp() * 1000)
        assert cs.assign_versions(ntz).count() == 3 and cs.place_operations(ntz.withColumns({c: F.lit("x") for c in ("table_name", "row_id", "operation")})).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unmapped_changes_are_counted(spark):
    changes = spark.createDataFrame([("a", START), ("b", START), ("b", START)], "table_name string, created_at timestamp")
    owned = spark.createDataFrame([("a",)], "table_name string")
    assert rows(unmapped_changes(changes, owned), "table_name", "changes") == [("b", 2)]
