from __future__ import annotations

import json

import pytest

from tests.conftest import rows
from tidemark.operators import diff, render

LONG = "ran aground, " * 40 + "refloated"
UPDATE = {
    "old_values": '{"hull":{"length":31.50,"decks":[1,2]},"seaworthy":true,"log":"in port"}',
    "new_values": '{"hull":{"length":31.5,"decks":[1,2,3]},"seaworthy":false,"log":"%s"}' % LONG,
}
CABIN = {
    "table_name": "cabin",
    "row_id": "B/12",
    "operation": "INSERT",
    "new_values": '{"id":"B/12","suite":true,"beds":[{"width":90},{"width":140}],"view":null}',
}
DELETE = {
    "operation": "DELETE",
    "old_values": '{"id":618,"flags":["P","F"],"insured":false}',
}
COLUMNS = (
    '[{"name":"id","dataType":"uuid","nullable":false},'
    '{"name":"suite","dataType":"boolean","nullable":false},'
    '{"name":"rates","dataType":"jsonb","nullable":true}'
)
ADDED = COLUMNS.replace('{"name":"suite","dataType":"boolean","nullable":false},', "") + (
    ',{"name":"view","dataType":"text","nullable":true},{"name":"floor","dataType":"int2","nullable":false}]'
)
SCHEMA = {
    "entity_type": "__schema",
    "entity_id": "*",
    "table_name": "cabin",
    "row_id": "*",
    "operation": "SCHEMA_CHANGE",
}
TX = "9f3c51d7e2"


def text(log, **options):
    whole = render.whole_text(render.render_text(log, **options))
    return [r.text for r in whole.orderBy("version", ascending=False).collect()]


def test_text_of_an_update(make_log):
    (found,) = text(make_log((TX, 0, UPDATE)))
    *head, change = found.splitlines()
    assert head == ["changeset v1  [tx: 9f3c51d7]  2031-07-09 05:41:36 UTC", "  tables: vessel", "  -- vessel (id=618)"]
    # Keys of nested objects are in order, their numbers in one form.
    hull = 'hull: {"decks":[1,2],"length":31.5} -> {"decks":[1,2,3],"length":31.5}'
    assert change.startswith("     UPDATE  ")
    assert hull in change and "seaworthy: true -> false" in change
    assert f"log: in port -> {LONG}" in change


def test_text_is_newest_first_with_tables_by_appearance(make_log):
    log = make_log((TX, 0, UPDATE), (TX, 5, CABIN), (TX, 7, UPDATE), ("a1", 9000, DELETE))
    newest, oldest = text(log)
    assert newest.splitlines()[0].startswith("changeset v2")
    assert newest.splitlines()[3] == "     DELETE"
    assert oldest.splitlines()[1] == "  tables: vessel, cabin"
    inserted = '     INSERT  beds=[{"width":90},{"width":140}], suite=true, view=NULL'
    assert oldest.splitlines()[4] == "  -- cabin (id=B/12)" and sorted(oldest.splitlines()[5]) == sorted(inserted)


def test_verbose_shows_ids_and_deleted_values(make_log):
    newest, oldest = text(make_log((TX, 0, CABIN), ("a1", 9000, DELETE)), verbose=True)
    assert sorted(newest.splitlines()[-1]) == sorted('     DELETE  id=618, flags=["P","F"], insured=false')
    assert "id=B/12" in oldest and "suite=true" in oldest and "view=NULL" in oldest


def test_missing_images_leave_only_the_label(make_log):
    for operation in ("INSERT", "UPDATE", "DELETE"):
        (block,) = text(make_log((TX, 0, {"operation": operation})))
        assert block.splitlines()[-1] == f"     {operation}"


def test_schema_change_text(make_log):
    log = make_log((TX, 0, {**SCHEMA, "old_values": COLUMNS + "]", "new_values": ADDED}))
    assert text(log) == [
        "schema change  2031-07-09 05:41:36 UTC\n"
        "  -- cabin\n"
        "     + column 'view' (text, nullable)\n"
        "     + column 'floor' (int2)\n"
        "     - column 'suite'"
    ]
    back = make_log((TX, 0, {**SCHEMA, "old_values": ADDED, "new_values": COLUMNS + "]"}))
    assert text(back)[0].endswith("     + column 'suite' (boolean)\n     - column 'view'\n     - column 'floor'")
    blind = make_log((TX, 0, {**SCHEMA, "new_values": ADDED}))
    assert text(blind)[0].endswith("  -- cabin\n     SCHEMA_CHANGE")
    same = make_log((TX, 0, {**SCHEMA, "old_values": ADDED, "new_values": ADDED}))
    assert text(same)[0].endswith("  -- cabin")


@pytest.mark.parametrize("limit", [1_000, 0])
def test_a_changeset_of_any_size_has_one_row_per_operation(make_log, limit):
    log = make_log(*[(TX, t, UPDATE) for t in range(7)])
    lines = render.newest_first(render.render_text(log, heavy_rows=limit)).collect()
    assert [r.position for r in lines] == list(range(8))
    assert "\n".join(r.text for r in lines) == text(log, heavy_rows=limit)[0]


@pytest.mark.parametrize(
    "old, new, expected",
    [
        ('{"a":1}', '{"b":2}', [("b", "NULL", "2", True)]),
        ('{"a":1}', '{"a":null}', [("a", "1", "NULL", False)]),
        ('{}', '{"a":null}', [("a", "NULL", "NULL", True)]),
        ('{"a":null}', '{"a":null}', []),
        ('{"a":1}', '{"a":"1"}', [("a", "1", "1", False)]),
        ('{"a":1.0}', '{"a":1}', []),
        ('{"a":1e2}', '{"a":100}', []),
        ('{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', []),
        ('{"a":[1]}', '{"a":[1,2]}', [("a", "[1]", "[1,2]", False)]),
        ('{"a":9007199254740993}', '{"a":9007199254740992}',
         [("a", "9007199254740993", "9007199254740992", False)]),
        ('{"a":true}', '{"a":"say \\"hi\\""}', [("a", "true", 'say "hi"', False)]),
        ('{"a":1}', '{"a":1}', []),
    ],
)
def test_field_diff(make_log, old, new, expected):
    log = make_log((TX, 0, {"old_values": old, "new_values": new}))
    found = diff.field_diff(log)
    assert rows(found, "field", "old_value", "new_value", "was_missing") == expected


def test_field_diff_needs_both_images_and_an_update(make_log):
    log = make_log((TX, 0, {"new_values": '{"a":1}'}), (TX, 1, CABIN), (TX, 2, DELETE))
    assert diff.field_diff(log).count() == 0


def test_listed_fields(make_log):
    log = make_log((TX, 0, CABIN), (TX, 1, DELETE))
    assert rows(diff.image_fields(log, "INSERT"), "field", "value") == [
        ("beds", '[{"width":90},{"width":140}]'),
        ("suite", "true"),
        ("view", "NULL"),
    ]
    assert diff.image_fields(log, "INSERT", verbose=True).count() == 4
    assert diff.image_fields(log, "DELETE").count() == 0
    assert diff.image_fields(log, "DELETE", verbose=True).count() == 3


def test_schema_change_diff(make_log):
    log = make_log((TX, 0, {**SCHEMA, "old_values": COLUMNS + "]", "new_values": ADDED}))
    assert rows(diff.schema_change_diff(log), "change", "name", "data_type", "nullable") == [
        ("added", "floor", "int2", False), ("added", "view", "text", True), ("removed", "suite", "boolean", False)
    ]


def test_json_documents(make_log):
    log = make_log((TX, 0.5, UPDATE), (TX, 10, CABIN))
    (document,) = render.whole_documents(render.changesets_json(log)).collect()
    parsed = json.loads(document.json)
    assert list(parsed) == [
        "version", "transactionId", "timestamp", "operations", "isAutocommitGrouped",
    ]
    assert parsed["timestamp"] == "2031-07-09T05:41:36.000Z"
    assert parsed["isAutocommitGrouped"] is False
    first, second = parsed["operations"]
    assert first["id"] == "1" and first["oldValues"]["hull"] == {"length": 31.5, "decks": [1, 2]}
    assert first["newValues"]["log"] == LONG
    assert second["oldValues"] is None and second["newValues"]["beds"][1]["width"] == 140


def test_json_export_can_be_put_together_again(spark, make_log, tmp_path):
    log = make_log(*[(f"a{t}", 9000 * t, UPDATE) for t in (2, 0, 1)], (TX, 90_000, CABIN), (TX, 90_001, UPDATE))
    render.write_json(render.changesets_json(log), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    places = [(line["entity_type"], line["entity_id"], line["version"], line["position"]) for line in lines]
    assert places == [("vessel", "618", v, p) for v in (1, 2, 3) for p in (0, 1)] + [
        ("vessel", "618", 4, p) for p in (0, 1, 2)
    ]
    assert lines[-2]["document"]["tableName"] == "cabin" and lines[-3]["document"]["version"] == 4
