"""A voyage from end to end: feed, entities, changesets, text."""

from __future__ import annotations

from datetime import timedelta

import pytest

from tests.conftest import START
from tidemark.operators.capture import capture_change_feed
from tidemark.operators.changesets import build_changesets, entity_history
from tidemark.operators.render import newest_first, render_text
from tidemark.schemas import ENTITY_MAP

MAP = [
    ("vessel", "vessel", True, "id", ["id"]),
    ("vessel", "engine", False, "vessel_id", ["id"]),
    ("voyage", "voyage", True, "nr", ["nr"]),
    ("voyage", "log_line", False, "voyage_nr", ["id"]),
]
CALM, ROUGH = '{"id":9,"voyage_nr":70,"sea":"calm"}', '{"id":9,"voyage_nr":70,"sea":"rough"}'
# (ms, transaction, table, operation, old, new)
CHANGES = [
    (0, "launch", "vessel", "INSERT", None, '{"id":5,"name":"Petrel"}'),
    (0, "launch", "engine", "INSERT", None, '{"id":31,"vessel_id":5,"kw":900}'),
    (1000, None, "voyage", "INSERT", None, '{"nr":70,"from":"Oban"}'),
    (1300, None, "log_line", "INSERT", None, CALM),
    (3000, None, "log_line", "UPDATE", CALM, ROUGH),
    (3100, "refit", "engine", "DELETE", '{"id":31,"vessel_id":5,"kw":900}', None),
    (3100, "refit", "engine", "INSERT", None, '{"id":32,"vessel_id":5,"kw":1200}'),
    (3600, None, "vessel", "UPDATE", '{"id":5,"name":"Petrel"}', '{"id":5,"name":"Storm Petrel"}'),
    (9000, None, "log_line", "DELETE", ROUGH, None),
]


def captured(spark, native):
    feed = spark.createDataFrame(
        [
            (n, table, operation, old, new, tx if native else None, START + timedelta(milliseconds=ms))
            for n, (ms, tx, table, operation, old, new) in enumerate(CHANGES, start=1)
        ],
        "seq long, table_name string, operation string, old_values string, new_values string, "
        "transaction_id string, created_at timestamp",
    )
    return capture_change_feed(feed, spark.createDataFrame(MAP, ENTITY_MAP))


@pytest.mark.parametrize("native, expected", [
    (True, {("vessel", "5"): [2, 2, 1], ("voyage", "70"): [2, 1, 1]}),
    # Without native transactions time alone groups: all within half a second falls together.
    (False, {("vessel", "5"): [2, 3], ("voyage", "70"): [2, 1, 1]}),
])
def test_changesets(spark, native, expected):
    found = {}
    for r in build_changesets(captured(spark, native)).orderBy("version").collect():
        found.setdefault((r.entity_type, r.entity_id), []).append(r.n_operations)
    assert found == expected


def test_text_of_one_entity(spark):
    log = captured(spark, True)
    history = entity_history(log, "vessel", "5").select(*log.columns)
    lines = "\n".join(r.text for r in newest_first(render_text(history)).collect()).splitlines()
    assert [line for line in lines if not line.startswith("changeset")] == [
        "  tables: vessel",
        "  -- vessel (id=5)",
        "     UPDATE  name: Petrel -> Storm Petrel",
        "  tables: engine",
        "  -- engine (id=31)",
        "     DELETE",
        "  -- engine (id=32)",
        "     INSERT  vessel_id=5, kw=1200",
        "  tables: vessel, engine",
        "  -- vessel (id=5)",
        "     INSERT  name=Petrel",
        "  -- engine (id=31)",
        "     INSERT  vessel_id=5, kw=900",
    ]
    assert [line[:12] for line in lines if line.startswith("changeset")] == [
        "changeset v3", "changeset v2", "changeset v1",
    ]
