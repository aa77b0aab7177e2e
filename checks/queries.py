"""Every operator as a query over the test tables: (spark, folder) -> frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import testdata as td
from tidemark.functions.images import format_value, image_map, row_image
from tidemark.operators import capture, changesets, diff, drift, entities, query, render
from tidemark.schemas import CHANGELOG_COLUMNS, ENTITY_MAP
from tidemark.session import new_path
from tidemark.sources import catalog, changelog, profile, snapshots
from tidemark.streaming.capture import capture_stream, captured_rows, late_rows
from tidemark.streaming.changesets import (
    changesets_of,
    late_entries,
    stream_changesets,
    streamed_entries,
    streamed_versions,
)
from tidemark.streaming.late import corrected
from tidemark.streaming.sessions import collect_sessions, stream_sessions, streamed_rows, streamed_sessions

WINDOW = td.DERIVED_WINDOW_MS
CAPTURED_AT = "2024-03-01 12:00:00"
SINCE, UNTIL = "2024-01-10 00:00:00", "2024-01-20 12:00:00"
ENTITY = ("voyage", "7")

CANDIDATE_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
    # These two do not hold: orphans, and a target that is not unique.
    ("lineitem", "l_partkey", "supplier", "s_suppkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]
FEED_MAP = [
    ("vessel", "root", True, "id", ["id"]),
    ("vessel", "child0", False, "k", ["id"]),
    ("vessel", "child1", False, "k", ["id"]),
    ("voyage", "child2", False, "kind", ["k", "id"]),
]
COVERAGE_MAP = [
    (entity, name, name == "root", "id", ["id"])
    for entity in ("voyage", "crew", "vessel")
    for name in ("root", "child0", "child1", "child2", "child3")
]

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def registered(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def text_list(column: str | Column) -> Column:
    return F.array_join(column, ",")


def columns_text(columns: str = "columns") -> Column:
    return F.array_join(
        F.transform(
            columns,
            lambda c: F.concat_ws(
                ":", c["name"], c["dataType"], c["nullable"].cast("string"),
                c["isPrimaryKey"].cast("string"),
            ),
        ),
        ",",
    )


# --- catalogs, keys, the stored changelog ---------------------------------------------------


@registered
def catalog_columns(spark, sf):
    return td.fleet_catalog(spark, sf, ordered=True)


@registered
def foreign_keys(spark, sf):
    return td.fleet_foreign_keys(spark, sf, ordered=True)


@registered
def profile_keys(spark, sf):
    def one(name):
        found = profile.profile_keys(td.table(spark, sf, name))
        return found.withColumn("table_name", F.lit(name))

    return one("orders").unionByName(one("lineitem"))


@registered
def check_foreign_keys(spark, sf):
    names = {n for c in CANDIDATE_KEYS for n in (c[0], c[2])}
    return profile.check_foreign_keys({n: td.table(spark, sf, n) for n in names}, CANDIDATE_KEYS)


KEY_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "documents": ["doc_id"],
    "labels": ["doc_id"], "events": ["event_id", "user_id"],
}


@registered
def discover_foreign_keys(spark, sf):
    """Every reference among the whole-number columns of ten tables, found from their values alone."""
    return profile.discover_foreign_keys({n: td.table(spark, sf, n) for n in KEY_COLUMNS}, KEY_COLUMNS)


@registered
def find_keys(spark, sf):
    """The unique columns of each table; only likely ones are counted exactly."""
    found = [
        profile.find_keys(td.table(spark, sf, name)).withColumn("table_name", F.lit(name))
        for name in ("orders", "customer", "supplier", "part")
    ]
    return reduce(DataFrame.unionByName, found).filter("is_unique").select("table_name", "column_name", "n_rows")


@registered
def refresh_roundtrip(spark, sf):
    """Both stores after two refreshes in a row: every drifted table is recorded once."""
    stores = [new_path(spark, name) for name in ("snapshots", "changelog")]
    snapshots.write_snapshots(td.stored(spark, sf, td.fleet_snapshots), stores[0])
    for _ in range(2):
        snapshots.refresh(
            td.stored(spark, sf, td.fleet_live_catalog), *stores, CAPTURED_AT, td.stored(spark, sf, td.fleet_watched)
        )
    kept = snapshots.read_snapshots(spark, stores[0]).filter(F.col("captured_at") == F.lit(CAPTURED_AT).cast("timestamp"))
    logged = changelog.read_changelog(spark, stores[1]).select("id", "schema_name", "table_name", "new_values", "transaction_id")
    return logged.join(kept.select("id", "schema_name", "table_name", columns_text().alias("columns")), ["id", "schema_name", "table_name"], "full_outer")


@registered
def schema_snapshot(spark, sf):
    columns = td.stored(spark, sf, td.fleet_catalog)
    snapshot = catalog.schema_snapshot(columns, CAPTURED_AT)
    return snapshot.withColumn("columns", columns_text())


@registered
def changelog_roundtrip(spark, sf):
    path = new_path(spark, "changelog")
    changelog.write_changelog(td.changelog(spark, sf), path)
    return changelog.read_changelog(spark, path).select(*CHANGELOG_COLUMNS)


# --- capture --------------------------------------------------------------------------------


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    orders = td.table(spark, sf, "orders").select(
        key.alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"),
        cents.alias("p"),
    )
    before = orders.filter(F.col("k") % 10 != 0)
    after = orders.filter(F.col("k") % 10 != 1).withColumns(
        {
            "st": F.when(F.col("k") % 10 == 2, "X").otherwise(F.col("st")),
            "p": F.col("p") + F.when(F.col("k") % 10 == 3, 100).otherwise(0),
        }
    )
    return before, after


@registered
def capture_snapshot_diff(spark, sf):
    before, after = _snapshots(spark, sf)
    return capture.capture_snapshot_diff(
        before, after, ["k"], table_name="orders", entity_type="customer", entity_key_col="c",
        captured_at=CAPTURED_AT, transaction_id="snapshot-1",
    )


def _feed(spark, sf) -> DataFrame:
    """The changelog as a feed without entity columns; odd rows carry no native transaction."""
    native = F.when(F.col("id") % 2 == 0, F.col("transaction_id"))
    return td.log(spark, sf).select(
        F.col("id").alias("seq"), "table_name", F.lower("operation").alias("operation"),
        "old_values", "new_values", native.alias("transaction_id"), "created_at",
    )


def _entity_map(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, ENTITY_MAP)


@registered
def capture_change_feed(spark, sf):
    return capture.capture_change_feed(_feed(spark, sf), _entity_map(spark, FEED_MAP))


@registered
def resolve_entity_ids(spark, sf):
    changes = td.log(spark, sf)
    return capture.resolve_entity_ids(changes, _entity_map(spark, FEED_MAP)).select(
        "id", "table_name", "operation", "entity_type", "entity_id", "row_id"
    )


@registered
def capture_stream_rows(spark, sf):
    return _captured(spark, td.log(spark, sf), "capture")


@registered
def capture_stream_hot(spark, sf):
    """A third of all rows belong to one row key, which is cut into range pieces."""
    hot = F.col("id") % 3 == 0
    rows = td.log(spark, sf).withColumns(
        {c: F.when(hot, "hot").otherwise(F.col(c)) for c in ("table_name", "row_id")}
    )
    return _captured(spark, rows, "capture-hot", heavy_rows=1_000)


def _captured(spark, log, name, **options):
    source = log.select(
        "table_name", "row_id", F.col("id").alias("seq"), F.col("new_values").alias("image"),
        "transaction_id", "created_at",
    )
    key = ["table_name", "row_id"]
    folder = td.feed_slices(spark, source, lambda s, *to: capture_stream(s, *to, key, **options), name)
    applied, _ = late_rows(captured_rows(spark, folder))
    return applied.filter(F.col("table_name") != "sentinel")


@registered
def row_images(spark, sf):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", urgent.alias("urgent")]
    return td.table(spark, sf, "orders").select("o_orderkey", row_image(columns).alias("image"))


@registered
def assign_transaction_id(spark, sf):
    native = F.when(F.col("id") % 2 == 0, F.col("transaction_id"))
    rows = td.log_keys(spark, sf).withColumn("transaction_id", native)
    return capture.assign_transaction_id(rows.withColumnRenamed("id", "seq")).select(
        "seq", "transaction_id"
    )


# --- changelog queries ----------------------------------------------------------------------


@registered
def query_changelog(spark, sf):
    return query.query_changelog(td.stored_changelog(spark, sf), entity_type="vessel")


@registered
def query_changelog_range(spark, sf):
    return query.query_changelog(td.stored_changelog(spark, sf), since=SINCE, until=UNTIL)


@registered
def query_changelog_topk(spark, sf):
    return query.query_changelog(td.stored_changelog(spark, sf), entity_type="voyage", limit=100)


@registered
def transaction_groups(spark, sf):
    return query.transaction_groups(td.log_keys(spark, sf))


@registered
def changelog_stats(spark, sf):
    return query.changelog_stats(td.log_keys(spark, sf))


@registered
def entity_stats(spark, sf):
    return query.entity_stats(td.log_keys(spark, sf))


# --- changesets -----------------------------------------------------------------------------


@registered
def classify_transactions(spark, sf):
    return changesets.classify_transactions(td.log_keys(spark, sf)).select(
        "id", "entity_type", "entity_id", "transaction_id", "transaction_rows", "is_explicit"
    )


@registered
def sessionize_autocommit(spark, sf):
    return changesets.sessionize_autocommit(td.log_keys(spark, sf), WINDOW)


@registered
def build_changesets(spark, sf):
    return changesets.build_changesets(td.log_keys(spark, sf), WINDOW)


@registered
def changesets_all_entities(spark, sf):
    return changesets.assign_versions(td.log(spark, sf), WINDOW)


@registered
def changesets_unscoped(spark, sf):
    log = td.log_keys(spark, sf)
    return changesets.build_changesets(log, WINDOW, scope=[], heavy_rows=5_000)


@registered
def changesets_hot_entity(spark, sf):
    """A third of all rows in one entity, above the limit for one task."""
    log = td.skewed_changelog(spark, sf)
    return changesets.build_changesets(log, WINDOW, heavy_rows=1_000)


@registered
def versions_hot_entity(spark, sf):
    log = td.skewed_changelog(spark, sf)
    return changesets.assign_versions(log, WINDOW, heavy_rows=1_000)


@registered
def entity_history(spark, sf):
    """On the stored changelog, so that type and dates prune folders."""
    return changesets.entity_history(
        td.stored_changelog(spark, sf), *ENTITY, since=SINCE, until=UNTIL, window_ms=WINDOW
    ).drop("created_date", "schema_name")


@registered
def entity_history_full(spark, sf):
    return changesets.entity_history(
        td.stored_changelog(spark, sf), *ENTITY, since=SINCE, until=UNTIL, window_ms=WINDOW,
        versions="full",
    ).drop("created_date", "schema_name")


def _fleet_log(spark, sf, log) -> DataFrame:
    """The changelog as that of two databases whose entities share their names."""
    return log.withColumn("schema_name", F.concat(F.lit("db"), (F.col("id") % 2).cast("string")))


@registered
def entity_history_fleet(spark, sf):
    """Each database's history of an entity of the same name, numbered by itself."""
    log = _fleet_log(spark, sf, td.log(spark, sf))
    return changesets.entity_history(log, *ENTITY, since=SINCE, until=UNTIL, window_ms=WINDOW, versions="full")


@registered
def changesets_without_zone(spark, sf):
    """Times without a zone count as UTC."""
    keys = td.log_keys(spark, sf)
    return changesets.build_changesets(keys.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), WINDOW)


@registered
def capture_coverage_fleet(spark, sf):
    """A table that one database captures and another does not."""
    log = _fleet_log(spark, sf, td.log_keys(spark, sf)).filter("schema_name = 'db0' OR table_name = 'root'")
    expected = _entity_map(spark, COVERAGE_MAP)
    both = [expected.withColumn("schema_name", F.lit(name)) for name in ("db0", "db1")]
    return drift.capture_coverage(reduce(DataFrame.unionByName, both), log)


@registered
def entity_history_version(spark, sf):
    return changesets.entity_history(td.log(spark, sf), *ENTITY, version=3, window_ms=WINDOW)


@registered
def changeset_tables(spark, sf):
    entries = changesets.assign_versions(td.log_keys(spark, sf), WINDOW)
    return changesets.changeset_tables(entries).withColumn("tables", text_list("tables"))


@registered
def nested_changesets(spark, sf):
    """Nested operations in parts of three, shown by their ids."""
    nested = changesets.nest_operations(
        td.log_keys(spark, sf), WINDOW, rows_per_part=3
    )
    ids = text_list(F.transform("operations", lambda o: o["id"].cast("string")))
    return nested.select("entity_type", "entity_id", "version", "part", ids.alias("ids"))


@registered
def stream_sessions_closed(spark, sf):
    log = td.log_keys(spark, sf)
    rows = log.withColumn("transaction_id", F.col("id").cast("string"))
    return td.run_in_slices(
        spark, rows, lambda s: stream_sessions(s, WINDOW, "1 hour"), "sessions"
    ).filter(F.col("entity_type") != "sentinel")


def _own_transactions(spark, sf):
    return td.log_keys(spark, sf).withColumn("transaction_id", F.col("id").cast("string"))


# Every fiftieth entry comes one slice later than its time, far behind the watermark.
POSTPONED = "id % 50 = 7"
OPEN_FOR = {"tx_timeout_ms": 86_400_000, "delay_ms": 3_600_000}


@registered
def stream_sessions_corrected(spark, sf):
    """Time groups of a stream with late rows; entities that these touch are grouped anew."""
    log = _own_transactions(spark, sf)
    folder = td.feed_slices(
        spark, log, lambda s, *to: collect_sessions(s, *to, WINDOW, 3_600_000), "sessions-late", 3, POSTPONED
    )
    late = streamed_rows(spark, folder).filter("is_late")

    def grouped(entries):
        sessions = changesets.build_changesets(entries, WINDOW)
        return sessions.withColumn("first_id", F.col("transaction_id").cast("long"))

    found = corrected(log, late, streamed_sessions(spark, folder), grouped)
    return found.filter(F.col("entity_type") != "sentinel")


def _numbered(spark, log, name, postponed=None, **options):
    def start(stream, *to):
        return stream_changesets(stream, *to, WINDOW, **OPEN_FOR, **options)

    return td.feed_slices(spark, log, start, name, 2 if postponed is None else 3, postponed)


@registered
def stream_changesets_closed(spark, sf):
    versions = streamed_versions(spark, _numbered(spark, td.log_keys(spark, sf), "changesets"))
    return changesets_of(versions).filter(F.col("entity_type") != "sentinel")


@registered
def stream_changesets_hot(spark, sf):
    """A third of all rows belong to one entity, which is cut into range pieces."""
    log = td.skewed_changelog(spark, sf).select(*td.log_keys(spark, sf).columns)
    versions = streamed_versions(spark, _numbered(spark, log, "changesets-hot", heavy_rows=1_000))
    return changesets_of(versions).filter(F.col("entity_type") != "sentinel")


@registered
def stream_late_rows(spark, sf):
    """Every entry of a stream with late rows, and whether it came behind the watermark."""
    folder = _numbered(spark, td.log_keys(spark, sf), "changesets-late", POSTPONED)
    entries = streamed_entries(spark, folder).filter(F.col("entity_type") != "sentinel")
    return entries.select("id", "entity_type", "entity_id", "is_late")


@registered
def stream_changesets_corrected(spark, sf):
    """Changesets of a stream with late rows; entities that these touch are numbered anew."""
    log = td.log_keys(spark, sf)
    folder = _numbered(spark, log, "changesets-corrected", POSTPONED)
    streamed = changesets_of(streamed_versions(spark, folder)).filter(F.col("entity_type") != "sentinel")
    return corrected(
        log, late_entries(spark, folder), streamed, lambda entries: changesets.build_changesets(entries, WINDOW)
    )


# --- diffs and rendering --------------------------------------------------------------------


@registered
def field_diff(spark, sf):
    return diff.field_diff(td.log(spark, sf))


def _number_texts(spark, sf):
    """Each order's price as one entry whose images spell the same numbers differently; every fourth
    changes in fact."""
    k = F.col("o_orderkey").cast("string")
    # Eight digits that begin and end with 1.
    m = F.concat(F.lit("1"), F.lpad(F.pmod("o_orderkey", F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("1"))
    changed = F.col("o_orderkey") % 4 == 3
    old = F.format_string(
        '{"a":[1%s00,{"b":%s.50}],"c":%s0000000000000000000000000,"d":0.00000000%s,"e":%s}', k, k, m, m, k)
    new = F.format_string(
        '{"a":[1%se2,{"b":%s.5e0}],"c":%se25,"d":%se-16,"e":%s}', k, k, m, m,
        F.when(changed, F.concat(k, F.lit("25e-2"))).otherwise(F.concat(k, F.lit(".0"))))
    return td.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("order").alias("entity_type"), k.alias("entity_id"),
        F.lit("orders").alias("table_name"), k.alias("row_id"), F.lit("UPDATE").alias("operation"),
        old.alias("old_values"), new.alias("new_values"), k.alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


@registered
def field_diff_numbers(spark, sf):
    """Only what is another number is a change, however it is written."""
    return diff.field_diff(_number_texts(spark, sf)).select("id", "field", "old_value", "new_value", "was_missing")


@registered
def format_numbers(spark, sf):
    """Numbers at any depth as text, in full, short and scientific form."""
    fields = diff.with_parsed(_number_texts(spark, sf))
    listed = fields.select("id", F.inline(diff.listed_fields("_after", hide_id=False)))
    return listed.filter(F.col("field") != "e")


@registered
def unmapped_changes(spark, sf):
    changes = td.log(spark, sf).drop("entity_type", "entity_id", "row_id")
    return capture.unmapped_changes(changes, _entity_map(spark, FEED_MAP[:2]))


@registered
def field_change_counts(spark, sf):
    return diff.field_change_counts(td.log(spark, sf))


@registered
def insert_fields(spark, sf):
    return diff.image_fields(td.log(spark, sf), "INSERT")


@registered
def delete_fields(spark, sf):
    return diff.image_fields(td.log(spark, sf), "DELETE", verbose=True)


@registered
def schema_change_diff(spark, sf):
    entries = drift.schema_timeline(td.stored(spark, sf, td.fleet_snapshots))
    return diff.schema_change_diff(entries).drop("created_at")


@registered
def format_values(spark, sf):
    log = td.log(spark, sf).filter(F.col("new_values").isNotNull())
    return log.select("id", F.explode(image_map("new_values")).alias("field", "v")).select(
        "id", "field", format_value(F.col("v")).alias("text")
    )


@registered
def render_text(spark, sf):
    return render.whole_text(render.render_text(td.log(spark, sf), WINDOW))


@registered
def render_text_verbose(spark, sf):
    """Line by line, in printing order."""
    return render.newest_first(render.render_text(td.log(spark, sf), WINDOW, verbose=True))


@registered
def render_schema_text(spark, sf):
    """Schema changes as text, one database as one history."""
    entries = drift.schema_timeline(td.stored(spark, sf, td.fleet_snapshots))
    scope = ["schema_name", "entity_type", "entity_id"]
    return render.whole_text(render.render_text(entries, 0, scope=scope), scope)


@registered
def changesets_json(spark, sf):
    """The documents, parsed again."""
    parsed = F.from_json(
        "json",
        "version long, transactionId string, timestamp string, isAutocommitGrouped boolean, "
        "operations array<struct<id:string, operation:string, createdAt:string, "
        "newValues:struct<kind:string>>>",
    )
    documents = render.whole_documents(render.changesets_json(td.log(spark, sf), WINDOW))
    return documents.select("entity_type", "entity_id", parsed.alias("d")).select(
        "entity_type",
        "entity_id",
        F.col("d.version").alias("version"),
        F.col("d.transactionId").alias("transaction_id"),
        F.col("d.timestamp").alias("timestamp_text"),
        F.col("d.isAutocommitGrouped").alias("is_autocommit_grouped"),
        text_list("d.operations.id").alias("ids"),
        text_list("d.operations.createdAt").alias("times"),
        F.array_join("d.operations.newValues.kind", ",", "NULL").alias("kinds"),
    )


# --- entities -------------------------------------------------------------------------------


def _classes(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, foreign keys, classes) of the fleet"""
    columns = td.stored(spark, sf, td.fleet_catalog)
    fks = td.stored(spark, sf, td.fleet_foreign_keys)
    degrees = entities.fk_degrees(columns.select("schema_name", "table_name").distinct(), fks)
    return columns, fks, entities.classify_tables(degrees)


def _resolved(spark, sf) -> tuple[DataFrame, DataFrame]:
    columns, fks, classes = _classes(spark, sf)
    return entities.resolve_entities(fks, classes, columns), classes


def _map_text(entity_map: DataFrame) -> DataFrame:
    return entity_map.withColumn("row_key_cols", text_list("row_key_cols"))


@registered
def fk_degrees(spark, sf):
    tables = td.stored(spark, sf, td.fleet_catalog).select("schema_name", "table_name").distinct()
    return entities.fk_degrees(tables, td.stored(spark, sf, td.fleet_foreign_keys))


@registered
def classify_tables(spark, sf):
    return _classes(spark, sf)[2]


@registered
def resolve_entities(spark, sf):
    return _map_text(_resolved(spark, sf)[0])


@registered
def entity_child_counts(spark, sf):
    return entities.entity_child_counts(_resolved(spark, sf)[0])


@registered
def entity_conflicts(spark, sf):
    conflicts = entities.entity_conflicts(_resolved(spark, sf)[0])
    return conflicts.withColumn("claimed_by", text_list("claimed_by"))


@registered
def unassigned_tables(spark, sf):
    entity_map, classes = _resolved(spark, sf)
    return entities.unassigned_tables(classes, entity_map)


@registered
def entity_warnings(spark, sf):
    columns, fks, classes = _classes(spark, sf)
    return entities.entity_warnings(fks, classes, columns)


@registered
def apply_overrides(spark, sf):
    """In every database: leave out t12, give t13 to t05, t14 to an unknown entity."""
    entity_map, classes = _resolved(spark, sf)
    schemas = classes.select("schema_name").distinct()
    exclude = schemas.select("schema_name", F.lit("t12").alias("table_name"))
    moves = F.inline(
        F.array(
            F.struct(F.lit("t13").alias("table_name"), F.lit("t05").alias("to_entity")),
            F.struct(F.lit("t14").alias("table_name"), F.lit("nobody").alias("to_entity")),
        )
    )
    reassign = schemas.select("schema_name", moves)
    return _map_text(entities.apply_overrides(entity_map, exclude, reassign))


@registered
def default_entity_map(spark, sf):
    entity_map, _ = _resolved(spark, sf)
    conflicts = entities.entity_conflicts(entity_map)
    return _map_text(entities.default_entity_map(entity_map, conflicts))


@registered
def ignored_tables(spark, sf):
    entity_map, classes = _resolved(spark, sf)
    return entities.ignored_tables(classes, entities.entity_conflicts(entity_map))


@registered
def validate_entity_map(spark, sf):
    entity_map, classes = _resolved(spark, sf)
    return entities.validate_entity_map(entity_map, classes)


# --- drift and audit ------------------------------------------------------------------------


@registered
def latest_snapshot(spark, sf):
    return drift.latest_snapshot(td.stored(spark, sf, td.fleet_snapshots)).withColumn(
        "columns", columns_text()
    )


def _drift(spark, sf) -> DataFrame:
    return drift.schema_drift(
        td.stored(spark, sf, td.fleet_live_catalog), td.stored(spark, sf, td.fleet_snapshots),
        td.stored(spark, sf, td.fleet_watched),
    )


@registered
def schema_drift(spark, sf):
    names = ["added_columns", "removed_columns", "modified_columns"]
    return _drift(spark, sf).withColumns({n: text_list(n) for n in names})


@registered
def record_schema_changes(spark, sf):
    entries, _ = drift.record_schema_changes(
        _drift(spark, sf), td.stored(spark, sf, td.fleet_live_catalog), td.stored(spark, sf, td.fleet_snapshots),
        CAPTURED_AT,
    )
    return entries


@registered
def recorded_snapshots(spark, sf):
    _, recorded = drift.record_schema_changes(
        _drift(spark, sf), td.stored(spark, sf, td.fleet_live_catalog), td.stored(spark, sf, td.fleet_snapshots),
        CAPTURED_AT,
    )
    return recorded.withColumn("columns", columns_text())


@registered
def schema_timeline(spark, sf):
    return drift.schema_timeline(td.stored(spark, sf, td.fleet_snapshots), td.stored(spark, sf, td.fleet_watched))


@registered
def capture_coverage(spark, sf):
    log = td.log_keys(spark, sf)
    return drift.capture_coverage(_entity_map(spark, COVERAGE_MAP), log)


@registered
def capture_health(spark, sf):
    log = td.log_keys(spark, sf)
    coverage = drift.capture_coverage(_entity_map(spark, COVERAGE_MAP), log)
    return drift.capture_health(coverage, _drift(spark, sf))


# The inventory's names for queries whose function name would hide an imported operator.
for _short, _function in {
    "capture_stream": "capture_stream_rows",
    "row_image": "row_images",
    "stream_sessions": "stream_sessions_closed",
    "stream_changesets": "stream_changesets_closed",
    "format_value": "format_values",
}.items():
    REGISTERED[_short] = REGISTERED.pop(_function)
