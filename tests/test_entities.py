from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import entities
from tidemark.schemas import CATALOG, FOREIGN_KEYS

# A shipping company. All tables have a key `id`, but `tide` is kept by `day` and `sensor` has none.
TABLES = ["flag", "port", "sailor", "vessel", "voyage", "cabin", "engine", "survey", "log_line", "duty",
          "cargo", "manifest", "beacon", "tide", "sensor"]
KEYS = [
    ("vessel", "flag_id", "flag"),
    ("vessel", "home_id", "port"),
    ("voyage", "vessel_id", "vessel"),
    ("voyage", "from_id", "port"),
    ("cabin", "vessel_id", "vessel"),
    ("engine", "vessel_id", "vessel"),
    ("survey", "vessel_id", "vessel"),
    ("log_line", "voyage_id", "voyage"),
    ("duty", "voyage_id", "voyage"),
    ("duty", "sailor_id", "sailor"),
    ("cargo", "voyage_id", "voyage"),
    ("cargo", "vessel_id", "vessel"),
    ("manifest", "voyage_id", "voyage"),
    ("manifest", "vessel_id", "vessel"),
    ("beacon", "beside_id", "beacon"),
]


class Analysed:
    def __init__(self, spark, tables, keys, keyless=("sensor",)):
        catalog = [
            ("fleet", name, 1, "day" if name == "tide" else "id", "integer", False, name not in keyless)
            for name in tables
        ]
        catalog += [
            ("fleet", table, 2 + n, column, "integer", True, False) for n, (table, column, _) in enumerate(keys)
        ]
        fks = [
            ("fleet", table, column, target, "id", f"{table}_{column}_fkey") for table, column, target in keys
        ]
        self.catalog = spark.createDataFrame(catalog, CATALOG)
        self.fks = spark.createDataFrame(fks, FOREIGN_KEYS)
        tables = self.catalog.select("schema_name", "table_name").distinct()
        self.degrees = entities.fk_degrees(tables, self.fks)
        self.classes = entities.classify_tables(self.degrees)
        self.map = entities.resolve_entities(self.fks, self.classes, self.catalog)

    def of_class(self, name):
        found = self.classes.filter(F.col("class") == name)
        return [t for (t,) in rows(found, "table_name")]

    def children(self, entity_map=None):
        found = {}
        for r in (entity_map or self.map).filter("NOT is_root").collect():
            found.setdefault(r.entity_type, {})[r.table_name] = r.entity_key_col
        return found


@pytest.fixture(scope="module")
def shipping(spark):
    return Analysed(spark, TABLES, KEYS)


def test_classes(shipping):
    assert shipping.of_class("lookup") == ["flag", "port", "sailor"]
    assert shipping.of_class("isolated") == ["beacon", "sensor", "tide"]
    assert shipping.of_class("root") == ["vessel", "voyage"]


def test_degrees_leave_out_self_references(shipping):
    degrees = {t: (o, i) for t, o, i in rows(shipping.degrees, "table_name", "out_degree", "in_degree")}
    assert degrees["beacon"] == (0, 0)
    assert degrees["port"] == (0, 2)
    assert degrees["vessel"] == (2, 6)
    assert degrees["cargo"] == (2, 0)


def test_entities_and_conflicts(shipping):
    counts = entities.entity_child_counts(shipping.map).collect()
    assert [(r.entity_type, r.children) for r in counts] == [("vessel", 5), ("voyage", 4)]
    # A root is no child of another root, though it refers to it.
    assert shipping.children()["vessel"] == dict.fromkeys(
        ["cabin", "cargo", "engine", "manifest", "survey"], "vessel_id"
    )
    conflicts = entities.entity_conflicts(shipping.map)
    assert rows(conflicts, "table_name", "claimed_by") == [
        ("cargo", ["vessel", "voyage"]),
        ("manifest", ["vessel", "voyage"]),
    ]
    assert entities.unassigned_tables(shipping.classes, shipping.map).count() == 0
    assert entities.entity_warnings(shipping.fks, shipping.classes, shipping.catalog).count() == 0


def test_default_policy(shipping):
    conflicts = entities.entity_conflicts(shipping.map)
    default = entities.default_entity_map(shipping.map, conflicts)
    assert {e: len(c) for e, c in shipping.children(default).items()} == {"vessel": 3, "voyage": 2}
    ignored = rows(entities.ignored_tables(shipping.classes, conflicts), "table_name")
    assert [t for (t,) in ignored] == [
        "beacon", "cargo", "flag", "manifest", "port", "sailor", "sensor", "tide",
    ]
    assert entities.validate_entity_map(default).count() == 0
    for limit in (100, 0):
        errors = rows(entities.validate_entity_map(shipping.map, heavy_rows=limit), "error")
        assert errors == [
            ("Table 'cargo' is assigned to both 'vessel' and 'voyage'",),
            ("Table 'manifest' is assigned to both 'vessel' and 'voyage'",),
        ]


def overrides(spark, analysed, exclude=(), reassign=()):
    excluded = spark.createDataFrame(
        [("fleet", t) for t in exclude], "schema_name string, table_name string"
    )
    moves = spark.createDataFrame(
        [("fleet", t, e, n) for n, (t, e) in enumerate(reassign)],
        "schema_name string, table_name string, to_entity string, position int",
    )
    return analysed.children(entities.apply_overrides(analysed.map, excluded, moves))


def test_overrides(spark, shipping):
    changed = overrides(
        spark, shipping,
        exclude=["duty", "engine"],
        reassign=[
            ("cargo", "vessel"),
            ("log_line", "vessel"),
            ("cabin", "nobody"),
            ("engine", "vessel"),
            ("survey", "nobody"),
            ("survey", "vessel"),
        ],
    )
    assert changed["vessel"]["cargo"] == "vessel_id" and "cargo" not in changed["voyage"]
    # No key to the target: the first key to any entity is taken.
    assert changed["vessel"]["log_line"] == "voyage_id" and "log_line" not in changed["voyage"]
    assert all("cabin" not in children and "duty" not in children for children in changed.values())
    # Excluded, then handed back; moved twice, the last counts.
    assert changed["vessel"]["engine"] == "vessel_id"
    assert changed["vessel"]["survey"] == "vessel_id"


def test_repeated_moves_need_an_order(spark, shipping):
    excluded = spark.createDataFrame([], "schema_name string, table_name string")
    moves = spark.createDataFrame(
        [("fleet", "survey", "voyage"), ("fleet", "survey", "vessel")],
        "schema_name string, table_name string, to_entity string",
    )
    with pytest.raises(ValueError, match="position"):
        entities.apply_overrides(shipping.map, excluded, moves)
    assert entities.apply_overrides(shipping.map, excluded, moves.limit(1)).count() == shipping.map.count()


def test_tables_without_key(spark):
    found = Analysed(
        spark,
        ["grade", "mine", "pit", "shaft", "lamp"],
        [("mine", "grade_id", "grade"), ("pit", "grade_id", "grade"), ("shaft", "mine_id", "mine"),
         ("shaft", "pit_id", "pit"), ("lamp", "mine_id", "mine")],
        keyless=("pit", "lamp"),
    )
    assert found.children() == {"mine": {"shaft": "mine_id"}}
    warnings = entities.entity_warnings(found.fks, found.classes, found.catalog)
    assert rows(warnings, "message") == [
        ("Table 'lamp' has no primary key, skipping as child of 'mine'",),
        ("Table 'pit' has no primary key, skipping as entity root",),
    ]
    assert rows(entities.unassigned_tables(found.classes, found.map), "table_name") == [("lamp",), ("pit",)]


def test_two_keys_to_one_root_make_one_child(spark):
    found = Analysed(
        spark, ["zone", "depot", "transfer"],
        [("depot", "zone_id", "zone"), ("transfer", "to_depot", "depot"), ("transfer", "from_depot", "depot")],
    )
    assert found.children() == {"depot": {"transfer": "from_depot"}}
    assert entities.entity_conflicts(found.map).count() == 0


def test_no_tables(spark):
    found = Analysed(spark, [], [])
    assert found.classes.count() == 0 and found.map.count() == 0
    empty = spark.createDataFrame([("fleet",)], "schema_name string")
    assert rows(entities.validate_entity_map(found.map, empty), "error") == [
        ("At least one entity is required",)
    ]
