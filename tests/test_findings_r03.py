"""What the findings of round 3 asked for."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTERED
from tidemark import testdata as td
from tidemark.functions.numbers import canonical_numbers
from tidemark.operators import entities
from tidemark.plans import heavy
from tidemark.sources.catalog import catalog_columns

from .conftest import rows


@pytest.fixture
def folder(spark, tmp_path):
    """Events of three users and lines of two suppliers."""
    events = [(n, f"2024-01-0{1 + n % 3} 00:0{n % 6}:00", n % 3, ["signup", "view", "error"][n % 3 - 1], json.dumps({"k": n})) for n in range(24)]
    events = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    lines = [(o, p, s, 1 + (o + p) % 7) for o in range(12) for p in range(40) for s in (1, 2)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "scope"), [("render_text", ["entity_type", "entity_id"]), ("render_schema_text", ["schema_name", "entity_type", "entity_id"])])
def test_a_changeset_is_one_whole_text(spark, folder, name, scope):
    found = REGISTERED[name](spark, folder)
    assert found.columns == [*scope, "version", "text"]
    assert found.count() == found.select(*scope, "version").distinct().count() > 1
    assert all("\n  -- " in r.text for r in found.collect())


def test_a_changeset_is_one_whole_document(spark, folder):
    found = REGISTERED["changesets_json"](spark, folder)
    ids = [int(i) for r in found.collect() for i in r.ids.split(",")]
    assert sorted(ids) == list(range(24))
    assert found.count() < 24


def test_numbers_are_cut_without_an_expression_for_each_part(spark):
    # Tokens are found by one expression; before, each token met eighteen of them.
    plan = spark.range(1).select(canonical_numbers(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_") <= 1


def test_fleet_reads_the_lines_once_for_all_frames(spark, folder):
    for derive in (td.fleet_catalog, td.fleet_foreign_keys, td.fleet_snapshots, td.fleet_live_catalog, td.fleet_watched):
        plan = derive(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan, derive.__name__


def test_columns_are_joined_once(spark):
    tables = spark.createDataFrame([("a", "t", "BASE TABLE")] * 2 + [("a", "v", "VIEW")], "schema_name string, table_name string, table_type string")
    columns = spark.createDataFrame(
        [("a", "t", "x", 1, "integer", "NO"), ("a", "t", "x", 1, "integer", "NO"), ("a", "t", None, 2, "text", "YES"), ("a", "v", "x", 1, "text", "NO"), (None, "t", "x", 1, "text", "NO")],
        "schema_name string, table_name string, column_name string, ordinal int, data_type string, is_nullable string",
    )
    keys = spark.createDataFrame([("a", "t", "x"), ("a", "t", "x"), ("a", "t", None)], "schema_name string, table_name string, column_name string")
    found = catalog_columns(tables, columns, keys, ordered=False)
    names = ["table_name", "ordinal", "name", "is_pk"]
    assert rows(found, *names) == sorted([("t", 1, "x", True)] * 2 + [("t", 2, None, False)], key=repr)
    assert "Sort" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_entity_map_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(name):
        made.add(1)
        return name

    entity_map = spark.createDataFrame(
        [("a", "one", "t", False, "k", ["id"]), ("a", "two", "t", False, "k", ["id"])],
        "schema_name string, entity_type string, table_name string, is_root boolean, entity_key_col string, row_key_cols array<string>",
    ).withColumn("entity_type", same("entity_type"))
    assert entities.validate_entity_map(entity_map, entity_map.select("schema_name")).count() == 1
    # Once for the stored map, and once more where the caller's frame is given as schemas.
    assert made.value <= 2


def test_rows_of_a_window_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(heavy, "WINDOW_ROWS", 10)
    frame = spark.range(200).select((F.col("id") % 50).alias("k"), "id", F.array("id").alias("wide"))
    found = heavy.with_previous(frame, ["k"], ["id"], ["wide"])
    assert found.rdd.getNumPartitions() == 20
    expected = [(i % 50, i, [i], ([i - 50],) if i >= 50 else None) for i in range(200)]
    assert sorted((r.k, r.id, r.wide, tuple(r.previous) if r.previous else None) for r in found.collect()) == sorted(expected)


def test_a_refresh_pins_one_snapshot_per_table(spark, monkeypatch):
    from datetime import datetime

    from tidemark.schemas import SNAPSHOTS
    from tidemark.session import materialise, new_path
    from tidemark.sources import snapshots

    pinned = {}

    def seen(df, name):
        pinned[name] = materialise(df, name)
        return pinned[name]

    monkeypatch.setattr(snapshots, "materialise", seen)
    column = lambda kind: [("x", kind, True, False)]
    history = [(n, "a", "t", column("text" if n == 8 else "integer"), datetime(2031, 7, 1 + n)) for n in range(9)]
    store, log = new_path(spark, "snapshots"), new_path(spark, "changelog")
    snapshots.write_snapshots(spark.createDataFrame(history + history, SNAPSHOTS), store)
    assert snapshots.read_snapshots(spark, store).count() == 9
    live = spark.createDataFrame([("a", "t", 1, "x", "bigint", True, False)], "schema_name string, table_name string, ordinal int, name string, data_type string, nullable boolean, is_pk boolean")
    drift = snapshots.refresh(live, store, log, "2031-08-01 00:00:00")
    assert [r.id for r in pinned["known-snapshots"].collect()] == [8]
    assert [r.modified_columns for r in drift.collect()] == [["x"]]
