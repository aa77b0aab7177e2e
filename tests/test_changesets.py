from __future__ import annotations

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.conftest import START, rows
from tidemark.operators import changesets as cs
from tidemark.schemas import CHANGELOG

# Every case must come out the same whether or not the entity is above the one-task limit.
LIMITS = [1_000, 0]


CASES = {
    "one transaction": (
        [("tx1", t) for t in (0, 10, 20, 30, 40)],
        [(1, "tx1", 5, False)],
    ),
    "inside the window": ([("a1", 0), ("a2", 100), ("a3", 200)], [(1, "a1", 3, True)]),
    "outside the window": (
        [("a1", 0), ("a2", 1000), ("a3", 2000)],
        [(1, "a1", 1, False), (2, "a2", 1, False), (3, "a3", 1, False)],
    ),
    "mixed": (
        [("tx1", 0), ("tx1", 10), ("a1", 5000)],
        [(1, "tx1", 2, False), (2, "a1", 1, False)],
    ),
    "numbering": (
        [("tx1", 0), ("tx1", 10), ("tx2", 5000), ("tx2", 5010)],
        [(1, "tx1", 2, False), (2, "tx2", 2, False)],
    ),
    "single": ([("a1", 0)], [(1, "a1", 1, False)]),
    "gap of the window": ([("a1", 0), ("a2", 500)], [(1, "a1", 2, True)]),
    "gap one above": ([("a1", 0), ("a2", 501)], [(1, "a1", 1, False), (2, "a2", 1, False)]),
    "whole milliseconds count": ([("a1", 0), ("a2", 500.4)], [(1, "a1", 2, True)]),
    "chain longer than the window": (
        [("a1", 0), ("a2", 400), ("a3", 800), ("a4", 1200)],
        [(1, "a1", 4, True)],
    ),
    "transaction inside a chain": (
        [("a1", 0), ("tx1", 100), ("tx1", 150), ("a2", 300)],
        [(1, "a1", 2, True), (2, "tx1", 2, False)],
    ),
    "interleaved transactions": (
        [("tx1", 0), ("tx2", 1), ("tx1", 2), ("tx2", 3)],
        [(1, "tx1", 2, False), (2, "tx2", 2, False)],
    ),
    "transaction first in a millisecond": (
        [("a1", 0), ("tx1", 0.2), ("tx1", 9)],
        [(1, "tx1", 2, False), (2, "a1", 1, False)],
    ),
}


@pytest.mark.parametrize("limit", LIMITS)
def test_rules(make_log, limit):
    """Each case is an entity of its own in one log."""
    entries = [
        (tx, at, {"entity_id": case}) for case, (given, _) in CASES.items() for tx, at in given
    ]
    found = defaultdict(list)
    for r in cs.build_changesets(make_log(*entries), heavy_rows=limit).collect():
        found[r.entity_id].append(
            (r.version, r.transaction_id, r.n_operations, r.is_autocommit_grouped)
        )
    assert {case: sorted(f) for case, f in found.items()} == {
        case: expected for case, (_, expected) in CASES.items()
    }


def test_empty_log(make_log):
    assert cs.build_changesets(make_log(("a1", 0)).filter("id < 0")).count() == 0


def test_transaction_over_two_entities_is_autocommit_in_both(make_log):
    log = make_log(("tx1", 0), ("tx1", 10, {"entity_id": "619"}))
    found = cs.classify_transactions(log)
    assert rows(found, "id", "is_explicit") == [(1, False), (2, False)]
    unscoped = cs.classify_transactions(log, scope=[])
    assert rows(unscoped, "id", "is_explicit") == [(1, True), (2, True)]


def test_first_entry_gives_transaction_and_millisecond(make_log):
    log = make_log(("a2", 100.7), ("a1", 0.9))
    (row,) = cs.build_changesets(log).collect()
    assert (row.transaction_id, row.timestamp) == ("a1", START)


@pytest.fixture(scope="module")
def random_log(spark):
    """Dense ties, hot entity, transactions across entities and in any order."""
    random.seed(7)
    entries = []
    for number in range(3_000):
        entity = "hot" if random.random() < 0.4 else str(random.randrange(12))
        tx = f"x{random.randrange(400)}" if random.random() < 0.4 else f"a{number}"
        at = START + timedelta(microseconds=random.randrange(60_000) * 700)
        entries.append(
            (number, "vessel", entity, f"t{number % 5}", str(number), "UPDATE", None, None, tx, at)
        )
    return spark.createDataFrame(entries, CHANGELOG).repartition(5), entries


def expected_versions(entries, window_ms, scoped=True):
    scopes = defaultdict(list)
    for e in entries:
        scopes[e[2] if scoped else ""].append((e[9], e[0], e[8]))
    return {
        number: (version, len(ids), grouped)
        for scope in scopes.values()
        for version, ids, grouped in model.changesets(scope, window_ms)
        for number in ids
    }


@pytest.mark.parametrize("window_ms, limit", [(30, 10_000), (500, 500), (0, 20), (30, 20)])
def test_random_log_against_model(random_log, window_ms, limit):
    log, entries = random_log
    versions = cs.assign_versions(log, window_ms, heavy_rows=limit)
    found = {
        r.id: (r.version, r.n_operations, r.is_autocommit_grouped) for r in versions.collect()
    }
    assert found == expected_versions(entries, window_ms)


def test_more_heavy_keys_than_are_listed(random_log, monkeypatch):
    from tidemark.plans import heavy

    monkeypatch.setattr(heavy, "LISTED_KEYS", 2)
    log, entries = random_log
    found = cs.assign_versions(log, 30, heavy_rows=100)
    versions = {r.id: (r.version, r.n_operations, r.is_autocommit_grouped) for r in found.collect()}
    assert versions == expected_versions(entries, 30)


@pytest.mark.parametrize("limit", [10_000, 500])
def test_unscoped_random_log(random_log, limit):
    log, entries = random_log
    versions = cs.assign_versions(log, 20, scope=[], heavy_rows=limit)
    found = {
        r.id: (r.version, r.n_operations, r.is_autocommit_grouped) for r in versions.collect()
    }
    assert found == expected_versions(entries, 20, scoped=False)


@pytest.mark.parametrize("limit", [10_000, 100])
def test_nested_parts_are_whole_and_bounded(random_log, limit):
    log, entries = random_log
    nested = cs.nest_operations(log, 500, rows_per_part=7, heavy_rows=limit).collect()
    assert max(len(r.operations) for r in nested) == 7
    whole = defaultdict(list)
    for r in sorted(nested, key=lambda r: (r.entity_id, r.version, r.part)):
        whole[r.entity_id, r.version] += [o.id for o in r.operations]
    scopes = defaultdict(list)
    for e in entries:
        scopes[e[2]].append((e[9], e[0], e[8]))
    in_order = {
        (entity, version): [n for _, n, _ in sorted(e for e in scope if e[1] in set(ids))]
        for entity, scope in scopes.items()
        for version, ids, _ in model.changesets(scope, 500)
    }
    assert whole == in_order
    first_seen = {
        (r.entity_id, r.version): r.tables for r in nested
    }
    for key, ids in in_order.items():
        assert first_seen[key] == list(dict.fromkeys(f"t{n % 5}" for n in ids))


@pytest.mark.parametrize("limit", [10_000, 100])
def test_sessions_and_classes(random_log, limit):
    log, entries = random_log
    sessions = {
        r.transaction_id: r.session_first_id
        for r in cs.sessionize_autocommit(log, 500, heavy_rows=limit)
        .filter("entity_id = 'hot'")
        .collect()
    }
    hot = [(e[9], e[0], e[8]) for e in entries if e[2] == "hot"]
    tx_of = {number: tx for _, number, tx in hot}
    sizes = defaultdict(int)
    for _, _, tx in hot:
        sizes[tx] += 1
    expected = {
        tx_of[number]: ids[0]
        for _, ids, _ in model.changesets(hot, 500)
        for number in ids
        if sizes[tx_of[number]] == 1
    }
    assert sessions == expected
    classes = cs.classify_transactions(log, heavy_rows=limit).filter("entity_id = 'hot'")
    assert {r.transaction_id: r.transaction_rows for r in classes.collect()} == dict(sizes)


def test_history_of_a_time_range(make_log):
    log = make_log(("tx1", 0), ("tx1", 1000), ("a1", 2000), ("a2", 9000), ("tx2", 9100))
    since = START + timedelta(milliseconds=1000)
    until = START + timedelta(milliseconds=9000)
    sliced = cs.entity_history(log, "vessel", "618", since=since, until=until)
    # Both bounds are inclusive; the cut transaction counts as autocommit.
    assert rows(sliced, "id", "version") == [(2, 1), (3, 2), (4, 3)]
    whole = cs.entity_history(log, "vessel", "618", since=since, until=until, versions="full")
    assert rows(whole, "id", "version") == [(2, 1), (3, 2), (4, 3)]
    assert rows(whole, "id", "n_operations") == [(2, 2), (3, 1), (4, 2)]
    second = cs.entity_history(log, "vessel", "618", since=since, version=2)
    assert rows(second, "id") == [(3,)]
    assert cs.entity_history(log, "vessel", "619").count() == 0


def test_empty_filter_values_mean_no_filter(make_log):
    from tidemark.operators.query import query_changelog

    log = make_log(("a1", 5), ("a2", 0), ("a3", 9))
    assert [r.id for r in query_changelog(log, "", "", limit=0).collect()] == [2, 1, 3]
    assert [r.id for r in query_changelog(log, "vessel", limit=2).collect()] == [2, 1]


def test_statistics(make_log):
    from tidemark.operators.query import changelog_stats, entity_stats, transaction_groups

    log = make_log(("tx1", 0), ("tx1", 7, {"operation": "DELETE"}), ("a1", 3, {"entity_id": "619"}))
    assert rows(transaction_groups(log), "transaction_id", "count") == [("a1", 1), ("tx1", 2)]
    assert rows(entity_stats(log), "entity_id", "total", "updates", "deletes") == [
        ("618", 2, 1, 1),
        ("619", 1, 1, 0),
    ]
    stats = changelog_stats(log).first()
    assert (stats.total, stats.entity_types, stats.oldest) == (3, 1, START)
    assert changelog_stats(log.filter(F.lit(False))).first().total == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_null_scopes_and_transactions_lose_no_entry(make_log, limit):
    log = make_log(
        ("t1", 0), ("t1", 1), ("t2", 2000, {"entity_id": None}), ("t2", 2001, {"entity_id": None}),
        (None, 9000), ("t3", 9000, {"entity_id": None}),
    )
    flat = cs.assign_versions(log, heavy_rows=limit)
    assert flat.count() == 6
    sizes = cs.build_changesets(log, heavy_rows=limit)
    assert sorted(rows(sizes, "n_operations")) == [(1,), (1,), (2,), (2,)]
    assert cs.classify_transactions(log, heavy_rows=limit).count() == 6


def test_equal_ids_keep_one_order(make_log):
    log = make_log(*[("t1", 0, {"id": 1, "table_name": f"t{n % 7}", "row_id": str(n)}) for n in range(40)])
    placed = [
        rows(cs.place_operations(log.repartition(n)), "position", "table_name", "row_id") for n in (1, 7)
    ]
    assert placed[0] == placed[1]
