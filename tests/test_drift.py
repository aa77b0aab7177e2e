from __future__ import annotations

from datetime import timedelta

import pytest

from tests.conftest import START, rows
from tidemark.operators import diff, drift
from tidemark.schemas import CATALOG, ENTITY_MAP, SNAPSHOTS

VESSEL = [("id", "integer", False, True), ("name", "varchar", False, False)]
WIDER = [*VESSEL, ("tonnage", "varchar", True, False)]


@pytest.fixture
def snapshots(spark):
    def at(number, table, columns):
        return (number, "app", table, columns, START + timedelta(days=number % 10))

    return spark.createDataFrame(
        [
            at(1, "vessel", VESSEL),
            at(2, "vessel", WIDER),
            at(11, "cabin", VESSEL),
            at(12, "cabin", VESSEL),
            at(21, "voyage", VESSEL),
            at(22, "voyage", WIDER),
            at(31, "dropped", VESSEL),
            # the key flag alone is no change
            at(41, "crew", VESSEL),
            at(618, "crew", [(n, t, y, False) for n, t, y, _ in VESSEL]),
        ],
        SNAPSHOTS,
    )


@pytest.fixture
def live(spark):
    def columns(table, *described):
        return [("app", table, n, *c) for n, c in enumerate(described, start=1)]

    return spark.createDataFrame(
        columns("vessel", ("id", "bigint", False, True), ("tonnage", "varchar", False, False),
                ("level", "integer", True, False))
        + columns("cabin", *VESSEL)
        + columns("new", *VESSEL),
        CATALOG,
    )


def watched(spark, *tables):
    return spark.createDataFrame([("app", t) for t in tables], "schema_name string, table_name string")


def test_drift(spark, snapshots, live):
    found = drift.schema_drift(live, snapshots, watched(spark, "vessel", "cabin", "dropped", "new"))
    columns = ["table_name", "added_columns", "removed_columns", "modified_columns"]
    assert rows(found, *columns) == [
        ("dropped", [], ["id", "name"], []),
        ("vessel", ["level"], ["name"], ["id", "tonnage"]),
    ]


def test_recorded_changes_end_the_drift(spark, snapshots, live):
    tables = watched(spark, "vessel", "cabin", "dropped")
    found = drift.schema_drift(live, snapshots, tables)
    entries, recorded = drift.record_schema_changes(found, live, snapshots, "2031-08-01 00:00:00")
    assert rows(entries, "entity_type", "entity_id", "table_name", "row_id", "operation") == [
        ("__schema", "*", t, "*", "SCHEMA_CHANGE") for t in ("dropped", "vessel")
    ]
    changes = rows(diff.schema_change_diff(entries), "table_name", "change", "name")
    assert changes == [
        ("dropped", "removed", "id"), ("dropped", "removed", "name"),
        ("vessel", "added", "level"), ("vessel", "removed", "name"),
    ]
    after = snapshots.unionByName(recorded)
    assert drift.schema_drift(live, after, tables).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_timeline(spark, snapshots, limit):
    found = drift.schema_timeline(
        snapshots, watched(spark, "vessel", "cabin", "crew"), heavy_rows=limit
    )
    assert rows(found, "table_name", "created_at") == [("vessel", START + timedelta(days=2))]
    assert rows(diff.schema_change_diff(found), "change", "name", "nullable") == [
        ("added", "tonnage", True)
    ]


def test_coverage(spark, make_log, snapshots, live):
    entity_map = spark.createDataFrame(
        [("vessel", "vessel", True, "id", ["id"]), ("vessel", "cabin", False, "vesselId", ["id"])],
        ENTITY_MAP,
    )
    log = make_log(("t1", 0), ("t2", 5), ("t3", 6, {"table_name": "other"}))
    coverage = drift.capture_coverage(entity_map, log)
    assert rows(coverage, "table_name", "entries", "is_missing") == [
        ("cabin", 0, True), ("vessel", 2, False),
    ]
    none = drift.schema_drift(live, snapshots, watched(spark, "cabin"))
    health = drift.capture_health(coverage, none).first()
    assert (health.expected_tables, health.seen_tables, health.drifted_tables, health.ok) == (2, 1, 0, False)
    complete = drift.capture_health(coverage.filter("NOT is_missing"), none).first()
    assert complete.ok
