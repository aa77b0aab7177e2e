"""The shape of the plans: what is shuffled, what reaches the scan."""

from __future__ import annotations

import pytest

from tidemark import testdata as td
from tidemark.operators import capture, changesets, diff, query

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan(df).count("Exchange ")


@pytest.fixture(scope="module")
def log(spark):
    return td.log_keys(spark, DATA)


def test_changesets_shuffle_once(log):
    found = changesets.build_changesets(log)
    assert exchanges(found) == 1
    # Neither images nor anything else but the keys is read for them.
    read = "ReadSchema: struct<id:bigint,entity_id:string,transaction_id:string,created_at:timestamp>"
    assert read in plan(found)


def test_joined_versions_reuse_the_scope_exchange(spark, log):
    # Without broadcast: one exchange for the keys, one for the entries, none for the join.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(changesets.assign_versions(log)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_field_diff_does_not_shuffle(spark, make_log):
    assert exchanges(diff.field_diff(make_log(("t", 0)))) == 0


def test_transaction_groups_combine_before_the_shuffle(log):
    found = query.transaction_groups(log)
    assert "partial_count" in plan(found)


def test_history_filters_reach_the_scan(spark):
    stored = td.stored_changelog(spark, DATA)
    found = query.query_changelog(stored, "vessel", "3", since="2024-01-05 00:00:00")
    text = plan(found)
    folders, pushed = text.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "entity_type" in folders and "created_date" in folders
    assert "EqualTo(entity_id,3)" in pushed and "GreaterThanOrEqual(created_at" in pushed


def test_topk_is_no_full_sort(make_log):
    found = query.query_changelog(make_log(("t", 0)), "vessel", limit=5)
    assert "TakeOrderedAndProject" in plan(found)


def test_snapshot_diff_joins_once_and_writes_json_of_changes_only(spark):
    orders = td.table(spark, DATA, "orders")
    found = capture.capture_snapshot_diff(
        orders, orders, ["o_orderkey"], table_name="o", entity_type="o",
        entity_key_col="o_orderkey", captured_at="2024-01-01", transaction_id="t",
    )
    text = plan(found)
    assert text.count("Join ") == 1
    # The filter on the operation lies below the projection that makes the images.
    assert text.index("StructsToJson") < text.index("Filter") < text.index("Join ")


def test_entity_history_prunes_folders(spark):
    stored = td.stored_changelog(spark, DATA)
    found = changesets.entity_history(stored, "vessel", "3", since="2024-01-05 00:00:00")
    folders, pushed = plan(found).split("PartitionFilters: ")[1].split("PushedFilters: ")[:2]
    assert "entity_type" in folders and "created_date" in folders
    assert "EqualTo(entity_id,3)" in pushed
