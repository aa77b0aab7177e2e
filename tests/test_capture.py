from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import START, rows
from tidemark.functions.ids import content_hash
from tidemark.operators import capture
from tidemark.schemas import ENTITY_MAP

BEFORE = [(1, 10, "a", Decimal("1.50"), None), (2, 10, "b", None, 1.0), (3, 11, "c", None, float("nan"))]
AFTER = [(1, 10, "a", Decimal("1.50"), None), (2, 12, "b", None, 1.0), (3, 11, "c", None, float("nan")),
         (4, 11, "x", Decimal("12345.67"), None)]
SCHEMA = "`row-id` int, parent int, name string, amount decimal(12,2), rate double"


def captured(spark, before, after, **options):
    return capture.capture_snapshot_diff(
        spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA), ["row-id"],
        **{
            "table_name": "line", "entity_type": "order", "entity_key_col": "parent",
            "captured_at": "2031-07-09 14:23:07", "transaction_id": "s1", **options,
        },
    )


def test_snapshot_diff(spark):
    found = captured(spark, BEFORE, AFTER)
    # The moved row is logged under its new parent; equal rows, nulls and NaN give nothing.
    assert rows(found, "operation", "entity_id", "row_id") == [
        ("INSERT", "11", "4"), ("UPDATE", "12", "2"),
    ]
    images = {r.operation: (r.old_values, r.new_values) for r in found.collect()}
    assert images["INSERT"][0] is None
    assert json.loads(images["INSERT"][1])["amount"] == 12345.67
    old, new = map(json.loads, images["UPDATE"])
    assert (old["parent"], new["parent"], new["amount"]) == (10, 12, None)


def test_delete_takes_the_old_side(spark):
    found = captured(spark, BEFORE, BEFORE[:1])
    assert rows(found, "operation", "entity_id", "row_id", "new_values") == [
        ("DELETE", "10", "2", None), ("DELETE", "11", "3", None),
    ]


def test_bulk_insert_gives_an_entry_per_row(spark):
    many = [(n, 1, "n", None, None) for n in range(5)]
    found = captured(spark, [], many)
    assert found.count() == 5
    assert found.select("id").distinct().count() == 5
    assert {r.transaction_id for r in found.collect()} == {"s1"}


def test_capture_flags_and_added_columns(spark):
    found = captured(spark, BEFORE, AFTER, capture_old_values=False)
    assert {r.old_values for r in found.collect()} == {None}
    wider = spark.createDataFrame(AFTER[:1], SCHEMA).withColumn("level", F.lit("easy"))
    added = capture.capture_snapshot_diff(
        spark.createDataFrame(BEFORE[:1], SCHEMA), wider, ["row-id"], table_name="t",
        entity_type="t", entity_key_col="row-id", captured_at=START, transaction_id="s2",
    )
    (row,) = added.collect()
    assert row.operation == "UPDATE" and json.loads(row.new_values)["level"] == "easy"


def test_capture_repeats_itself(spark):
    first, second = (rows(captured(spark, BEFORE, AFTER)) for _ in range(2))
    assert first == second


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(
        [
            (1, "vessel", "insert", None, '{"id":618,"name":"x"}', "t1", START),
            (2, "cabin", "INSERT", None, '{"id":7,"vesselId":618}', "t1", START),
            (3, "cabin", "UPDATE", '{"id":7,"vesselId":618}', '{"id":7,"vesselId":619}', "t2", START),
            (4, "cabin", "DELETE", '{"id":7,"vesselId":619}', None, None, START),
            (5, "vessel", "UPDATE", '{"id":618}', '{"id":618}', "t3", START),
            (6, "cabin", "INSERT", None, '{"id":8,"vesselId":null}', "t4", START),
            (7, "other", "INSERT", None, '{"id":1}', "t5", START),
            (8, "vessel", "TRUNCATE", None, '{"id":618}', "t6", START),
        ],
        "seq long, table_name string, operation string, old_values string, new_values string, "
        "transaction_id string, created_at timestamp",
    )


@pytest.fixture
def entity_map(spark):
    return spark.createDataFrame(
        [("vessel", "vessel", True, "id", ["id"]), ("vessel", "cabin", False, "vesselId", ["id"])],
        ENTITY_MAP,
    )


def test_change_feed(feed, entity_map):
    entries, rejects = capture.split_rejects(capture.capture_change_feed(feed, entity_map))
    assert rows(entries, "id", "entity_type", "entity_id", "row_id", "operation") == [
        (1, "vessel", "618", "618", "INSERT"),
        (2, "vessel", "618", "7", "INSERT"),
        (3, "vessel", "619", "7", "UPDATE"),
        (4, "vessel", "619", "7", "DELETE"),
        (5, "vessel", "618", "618", "UPDATE"),
    ]
    # No owner, unknown operation; the table outside the map is not captured at all.
    assert rows(rejects, "id") == [(6,), (8,)]
    own = entries.filter("id = 4").first().transaction_id
    assert len(own) == 64
    bare = capture.capture_change_feed(feed, entity_map, False, False)
    assert {(r.old_values, r.new_values) for r in bare.collect()} == {(None, None)}


def test_every_row_of_a_mapped_table_is_an_entry_or_a_reject(spark, feed, entity_map, tmp_path):
    from tidemark.sources.changelog import read_changelog, write_changelog

    log, rejects = str(tmp_path / "log"), str(tmp_path / "rejects")
    captured = capture.capture_change_feed(feed, entity_map)
    write_changelog(captured, log, rejects)
    kept, refused = read_changelog(spark, log), spark.read.parquet(rejects)
    mapped = feed.join(entity_map, "table_name", "left_semi")
    assert kept.count() + refused.count() == mapped.count() and rows(refused, "id") == [(6,), (8,)]
    with pytest.raises(Exception, match="not a changelog entry"):
        write_changelog(captured, str(tmp_path / "other"))


def test_a_table_has_one_owner(spark, feed, entity_map):
    twice = entity_map.unionByName(entity_map.limit(1).withColumn("entity_type", F.lit("other")))
    with pytest.raises(ValueError, match="owners"):
        capture.capture_change_feed(feed, twice)


def test_one_map_for_many_databases(spark, feed, entity_map):
    databases = spark.createDataFrame([("north",), ("south",)], "schema_name string")
    own = F.concat("schema_name", F.lit("/"), "entity_type")
    fleet_map = entity_map.crossJoin(databases).withColumn("entity_type", own)
    fleet = feed.filter("seq <= 5").crossJoin(databases)
    got = capture.capture_change_feed(fleet, fleet_map)
    assert got.count() == 10 and got.filter("entity_type <> concat(schema_name, '/vessel')").count() == 0


def test_keys_and_ids_tell_rows_apart(spark):
    key = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), (None, "c")], "x string, `y.z` string")
    none = key.limit(0)
    got = capture.capture_snapshot_diff(
        none, key, ["x", "y.z"], table_name="t", entity_type="e", entity_key_col="y.z",
        captured_at=START, transaction_id="s",
    )
    assert rows(got, "row_id") == [('["a","b,c"]',), ('["a,b","c"]',), (None,)]
    assert rows(got, "entity_id") == [("b,c",), ("c",), ("c",)]
    assert got.select("id").distinct().count() == 3 and got.filter("id < 0").count() == 0
    parts = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, ""), ("", None)], "x string, y string")
    assert parts.select(content_hash(F.col("x"), F.col("y"))).distinct().count() == 4


@pytest.mark.parametrize("limit", [100, 0])
def test_keyed_changes(spark, limit):
    changes = spark.createDataFrame(
        [("t", "1", s, i) for s, i in [(3, None), (1, "a"), (2, "b"), (4, "c"), (5, None), (6, None)]],
        "table_name string, row_id string, seq long, image string",
    )
    found = capture.capture_keyed_changes(changes, ["table_name", "row_id"], "seq", limit)
    assert rows(found, "seq", "operation", "old_values", "new_values") == [
        (1, "INSERT", None, "a"), (2, "UPDATE", "a", "b"), (3, "DELETE", "b", None),
        (4, "INSERT", None, "c"), (5, "DELETE", "c", None), (6, "DELETE", None, None),
    ]


def test_stored_changelog_prunes_folders(spark, make_log, tmp_path):
    from tidemark.operators.query import query_changelog
    from tidemark.sources.changelog import read_changelog, write_changelog

    day = 86_400_000
    log = make_log(("t1", 0), ("t2", day), ("t3", 2 * day, {"entity_type": "crew"}))
    write_changelog(log, str(tmp_path / "log"))
    write_changelog(log.withColumn("id", F.col("id") + 10), str(tmp_path / "log"))
    stored = read_changelog(spark, str(tmp_path / "log"))
    assert stored.count() == 6
    found = query_changelog(stored, "vessel", "618", since="2031-07-10 00:00:00")
    assert [r.id for r in found.collect()] == [2, 12]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "EqualTo(entity_id,618)" in plan


def test_catalog_frames(spark):
    from tidemark.sources.catalog import catalog_columns, foreign_keys, schema_snapshot

    tables = spark.createDataFrame(
        [("app", "a", "BASE TABLE"), ("app", "v", "VIEW"), ("app", "__tidemark_x", "BASE TABLE"),
         ("app", "__tidemarkx", "BASE TABLE")],
        "schema_name string, table_name string, table_type string",
    )
    columns = spark.createDataFrame(
        [("app", t, c, n, "integer", y) for t in ("a", "v", "__tidemark_x", "__tidemarkx")
         for c, n, y in (("x", 2, "YES"), ("id", 1, "NO"))],
        "schema_name string, table_name string, column_name string, ordinal int, "
        "data_type string, is_nullable string",
    )
    keys = spark.createDataFrame(
        [("app", "a", "id")], "schema_name string, table_name string, column_name string"
    )
    found = catalog_columns(tables, columns, keys)
    assert rows(found, "table_name", "name", "nullable", "is_pk") == [
        ("__tidemarkx", "id", False, False), ("__tidemarkx", "x", True, False),
        ("a", "id", False, True), ("a", "x", True, False),
    ]
    snapshot = schema_snapshot(found, START).filter("table_name = 'a'").first()
    assert [c.name for c in snapshot.columns] == ["id", "x"]
    usage = "schema_name string, constraint_name string, table_name string, column_name string, position int"
    pairs = foreign_keys(
        spark.createDataFrame(
            [("app", "k", "FOREIGN KEY"), ("app", "p", "PRIMARY KEY")],
            "schema_name string, constraint_name string, constraint_type string",
        ),
        spark.createDataFrame(
            [("app", "k", "c", "a1", 1), ("app", "k", "c", "a2", 2), ("app", "p", "c", "id", 1)], usage
        ),
        spark.createDataFrame([("app", "k", "d", "b1", 1), ("app", "k", "d", "b2", 2)], usage),
    )
    assert rows(pairs, "from_column", "to_column") == [("a1", "b1"), ("a2", "b2")]


def test_profile_and_references(spark):
    from tidemark.sources.profile import check_foreign_keys, profile_keys

    child = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 9)], "id int, p int")
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert rows(profile_keys(child), "column_name", "n_nulls", "n_distinct", "is_unique") == [
        ("id", 0, 4, True), ("p", 1, 2, False),
    ]
    found = check_foreign_keys(
        {"c": child, "p": parent}, [("c", "p", "p", "id"), ("p", "id", "c", "id")]
    )
    assert rows(found, "from_table", "orphan_rows", "target_unique", "holds") == [
        ("c", 1, False, False), ("p", 0, True, True),
    ]
