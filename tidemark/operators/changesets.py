"""Changesets: transactions and bursts of autocommit rows, numbered per entity.

Rules, for the entries of one scope (by default one entity) in the order (created_at, id):

* A transaction with more than one entry is a changeset; adjacency does not matter.
* The other entries are autocommit entries. One joins the group of the autocommit entry before it
  if the gap in whole milliseconds is at most the window; transactions in between do not matter.
* Versions count the changesets from 1 in the order of their first entry's millisecond, with
  transactions before autocommit groups, then in entry order.

A changeset is known by its first entry (start_at, start_id, start_tx). The work is done on one
row per (scope, transaction) and never carries row images. Scopes with more than ``heavy_rows``
entries leave the one-task-per-scope windows and take the range-partitioned way, with equal results.

Scope columns and transaction ids are never null in a stored changelog, for its sinks see to it. In other
frames a null is a value like any other here: such entries form a scope or transaction of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.heavy import (
    HEAVY_ROWS,
    PART,
    both,
    by_key,
    join_weighted,
    number_heavy,
    number_light,
    ordered_pieces,
    split_heavy,
    window_over,
    with_carried,
)
from ..schemas import DEFAULT_WINDOW_MS, ENTITY_SCOPE
from ..session import materialise

START = ["start_at", "start_id", "start_tx"]
FIRST = ["first_at", "first_id", "transaction_id"]
# Explicit transactions sort before autocommit groups of the same millisecond.
CHANGESET_ORDER = ["start_ms", "is_autocommit", *START]
# Behind the id only for logs whose ids are not unique: the order stays the same on every run.
ENTRY_ORDER = ["created_at", "id", "transaction_id", "table_name", "row_id", "operation"]
# What the flat form adds to an entry.
VERSION_COLUMNS = [
    "version",
    "changeset_transaction_id",
    "timestamp",
    "n_operations",
    "is_autocommit_grouped",
]
# Entries that one nested row may hold.
ROWS_PER_PART = 10_000


def _timed(log: DataFrame) -> DataFrame:
    """``log`` with times of the zoned type; times without a zone are UTC, whatever the session's zone."""
    if isinstance(log.schema["created_at"].dataType, T.TimestampNTZType):
        since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', created_at)")
        return log.withColumn("created_at", F.timestamp_micros(since))
    return log


def scope_of(log: DataFrame) -> list[str]:
    """What tells entities apart: their type and id, and their database if the log has it."""
    return ["schema_name", *ENTITY_SCOPE] if "schema_name" in log.columns else ENTITY_SCOPE


def _transactions(log: DataFrame, scope: list[str]) -> DataFrame:
    log = _timed(log)
    first = F.min(F.struct("created_at", "id"))
    return (
        log.groupBy(*scope, "transaction_id")
        .agg(F.count(F.lit(1)).alias("rows"), first.alias("first"))
        .select(
            *scope,
            "transaction_id",
            "rows",
            F.col("first.created_at").alias("first_at"),
            F.col("first.id").alias("first_id"),
            F.unix_millis("first.created_at").alias("first_ms"),
            (F.col("rows") == 1).alias("is_autocommit"),
        )
    )


def _opens_group(before: Column, window_ms: int) -> Column:
    return before.isNull() | (F.col("first_ms") - before > window_ms)


def _members_light(log: DataFrame, scope: list[str], window_ms: int) -> DataFrame:
    """One row per (scope, transaction) with the start of its changeset; a single exchange."""
    return grouped_light(_transactions(by_key(log, scope), scope), scope, window_ms)


def grouped_light(
    transactions: DataFrame, scope: list[str], window_ms: int, keep: list[str] = []
) -> DataFrame:
    """The start of its changeset on each of the given transactions: one row per (scope, transaction)
    with rows, first_at, first_id, first_ms, is_autocommit and the columns ``keep``, light scopes only."""
    ordered = window_over([*scope, "is_autocommit"], FIRST)
    opens = ~F.col("is_autocommit") | _opens_group(F.lag("first_ms").over(ordered), window_ms)
    first = F.struct(F.col("first_ms").alias("start_ms"), *_as_start())
    start = F.last(F.when(F.col("opens"), first), ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        transactions.withColumn("opens", opens)
        .withColumn("start", start)
        .select(*scope, "transaction_id", "rows", "is_autocommit", *keep, "start.*")
    )


def _members_heavy(log: DataFrame, scope: list[str], window_ms: int) -> DataFrame:
    """The same for heavy scopes: map-side combined transactions, then pieces of a scope."""
    return grouped_heavy(materialise(_transactions(log, scope), "transactions"), scope, window_ms)


def grouped_heavy(
    transactions: DataFrame, scope: list[str], window_ms: int, keep: list[str] = []
) -> DataFrame:
    """The same for heavy scopes; ``transactions`` is a stored table."""
    explicit = transactions.filter(~F.col("is_autocommit")).withColumns(
        {"start_ms": F.col("first_ms"), **dict(zip(START, map(F.col, FIRST)))}
    )
    pieces = ordered_pieces(transactions.filter("is_autocommit"), scope, FIRST)
    inside = window_over([*scope, PART], FIRST)
    # Order and milliseconds agree, so the last value of the earlier pieces is their maximum.
    gaps = with_carried(pieces, scope, _before_ms=(F.max("first_ms"), "max"))
    first = F.struct(F.col("first_ms").alias("start_ms"), *_as_start())
    opened = gaps.withColumn(
        "opened",
        F.when(
            _opens_group(F.coalesce(F.lag("first_ms").over(inside), "_before_ms"), window_ms), first
        ),
    )
    carried = with_carried(opened, scope, _open=(F.max("opened"), "max"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.last("opened", ignorenulls=True).over(running), "_open")
    columns = [*scope, "transaction_id", "rows", "is_autocommit", *keep]
    auto = carried.withColumn("start", start).select(*columns, "start.*")
    return explicit.select(*columns, "start_ms", *START).unionByName(auto)


def _as_start() -> list[Column]:
    return [F.col(f).alias(s) for f, s in zip(FIRST, START)]


def _summaries(members: DataFrame, scope: list[str]) -> DataFrame:
    return members.groupBy(*scope, "start_ms", "is_autocommit", *START).agg(
        F.sum("rows").alias("n_operations"), F.count(F.lit(1)).alias("n_members")
    )


def _split(log: DataFrame, scope: list[str], heavy_rows: int):
    keys = log.select(*scope, "transaction_id", "created_at", "id")
    return split_heavy(keys, scope, heavy_rows)


def _finish(numbered: DataFrame, scope: list[str], *more: str) -> DataFrame:
    return numbered.select(
        *scope,
        F.col("version").cast("long").alias("version"),
        F.col("start_tx").alias("transaction_id"),
        F.timestamp_millis("start_ms").alias("timestamp"),
        "n_operations",
        (F.col("is_autocommit") & (F.col("n_operations") > 1)).alias("is_autocommit_grouped"),
        *more,
    )


def build_changesets(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per changeset: version, first transaction id and millisecond, size, flag.

    ``scope=[]`` takes the whole log as one sequence.
    """
    light, heavy = _split(log, scope, heavy_rows)
    if light is not None:
        summaries = _summaries(_members_light(light, scope, window_ms), scope)
        light = number_light(summaries, scope, CHANGESET_ORDER, "version")
    if heavy is not None:
        summaries = _summaries(_members_heavy(heavy, scope, window_ms), scope)
        heavy = number_heavy(summaries, scope, CHANGESET_ORDER, "version")
    return _finish(both(light, heavy), scope)


def _versions_light(log: DataFrame, scope: list[str], window_ms: int) -> DataFrame:
    members = _members_light(log, scope, window_ms)
    rank = F.dense_rank().over(window_over(scope, CHANGESET_ORDER))
    whole = window_over([*scope, "version"])
    return _as_versions(
        members.withColumn("version", rank).withColumn("n_operations", F.sum("rows").over(whole)),
        scope,
    )


def _versions_heavy(
    log: DataFrame, scope: list[str], window_ms: int, heavy_rows: int
) -> DataFrame:
    members = _members_heavy(log, scope, window_ms)
    changesets = number_heavy(_summaries(members, scope), scope, CHANGESET_ORDER, "version")
    on = [*scope, "start_ms", "is_autocommit", *START]
    joined = join_weighted(members, changesets, on, "n_members", ["transaction_id"], heavy_rows)
    # Written once: the joins to it count, broadcast and read it.
    return materialise(_as_versions(joined, scope), "versions")


def _as_versions(members: DataFrame, scope: list[str]) -> DataFrame:
    member = members.withColumn("member_tx", F.col("transaction_id"))
    return _finish(member, scope, "member_tx", "rows").withColumnsRenamed(
        {"transaction_id": "changeset_transaction_id", "member_tx": "transaction_id"}
    )


def transaction_versions(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per (scope, transaction): the changeset it belongs to and its number of ``rows``."""
    light, heavy = _split(log, scope, heavy_rows)
    return both(
        None if light is None else _versions_light(light, scope, window_ms),
        None if heavy is None else _versions_heavy(heavy, scope, window_ms, heavy_rows),
    )


def _join_versions(log: DataFrame, scope: list[str], window_ms: int) -> DataFrame:
    """Entries of light scopes with their versions.

    Joined on copies of the keys that are never null: a null-safe join would not see that both sides
    are already dealt out by the scope.
    """
    sealed = {c: f"_on_{c}" for c in [*scope, "transaction_id"]}
    filled = {
        k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c, k in sealed.items()
    }
    entries = log.withColumns(filled)
    on = [sealed[c] for c in scope]
    keys = entries.select(*on, F.col(sealed["transaction_id"]).alias("transaction_id"), "created_at", "id")
    first_tx = F.col("changeset_transaction_id")
    versions = (
        _versions_light(keys, on, window_ms)
        .withColumn("changeset_transaction_id", F.when(first_tx != "-", F.substring(first_tx, 2, 1 << 30)))
        .withColumnRenamed("transaction_id", sealed["transaction_id"])
        .drop("rows")
    )
    return by_key(entries, on).join(versions, list(sealed.values()))


def _versioned(
    log: DataFrame, window_ms: int, scope: list[str], heavy_rows: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Entries with versions, those of light scopes and those of heavy scopes apart."""
    on = [*scope, "transaction_id"]
    light, heavy = split_heavy(log, scope, heavy_rows)
    if light is not None:
        light = _join_versions(light, scope, window_ms)
    if heavy is not None:
        keys = heavy.select(*on, "created_at", "id")
        versions = _versions_heavy(keys, scope, window_ms, heavy_rows)
        heavy = join_weighted(heavy, versions, on, "rows", ["id"], heavy_rows)
    columns = [*log.columns, *VERSION_COLUMNS]
    return (
        None if light is None else light.select(*columns),
        None if heavy is None else heavy.select(*columns),
    )


def assign_versions(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """The flat form: every entry of ``log`` with its changeset's version and attributes. A
    ``created_at`` without time zone counts, and comes back, as UTC."""
    log = _timed(log)
    return both(*_versioned(log, window_ms, scope, heavy_rows))


def place_operations(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """The flat form with each entry's ``position`` in its changeset, from 1, and the changeset's
    ``tables`` in order of first appearance."""
    keys, log = [*scope, "version"], _timed(log)
    light, heavy = _versioned(log, window_ms, scope, heavy_rows)
    if light is not None:
        in_table = F.row_number().over(window_over([*keys, "table_name"], ["position"]))
        whole = window_over(keys, ["position"]).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        # collect_list leaves nulls out: one name per table remains.
        tables = F.collect_list(F.when(F.col("in_table") == 1, F.col("table_name"))).over(whole)
        light = (
            number_light(light, keys, ENTRY_ORDER, "position")
            .withColumn("in_table", in_table)
            .withColumn("tables", tables)
            .drop("in_table")
        )
    if heavy is not None:
        placed = number_heavy(heavy, keys, ENTRY_ORDER, "position")
        tables = materialise(changeset_tables(placed, scope, with_size=True), "tables")
        heavy = join_weighted(placed, tables, keys, "table_rows", ["id"], heavy_rows)
        heavy = heavy.drop("table_rows")
    return both(light, heavy)


def nest_operations(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    rows_per_part: int = ROWS_PER_PART,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Changesets with their ``operations`` (whole entries) in order.

    Arrays are an explicit request; text and JSON come one row per operation. A changeset with more
    than ``rows_per_part`` entries takes several rows, ``part`` 0, 1, …, so that no row grows with
    the changeset. The parts in order are the whole.
    """
    part = F.floor((F.col("position") - 1) / F.lit(rows_per_part)).cast("long")
    placed = place_operations(log, window_ms, scope, heavy_rows).withColumn("part", part)
    return gather_parts(placed, scope, F.struct(*log.columns), "operations")


def gather_parts(placed: DataFrame, scope: list[str], item: Column, out: str) -> DataFrame:
    """One row per part of a changeset with ``item`` of its entries, in order, in array ``out``."""
    listed = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))
    header = ["n_operations", "is_autocommit_grouped", "tables"]
    return (
        placed.groupBy(*scope, "version", "part", "changeset_transaction_id", "timestamp", *header)
        .agg(listed.alias("listed"))
        .select(
            *scope,
            "version",
            F.col("changeset_transaction_id").alias("transaction_id"),
            "timestamp",
            *header,
            "part",
            F.col("listed.item").alias(out),
        )
    )


def classify_transactions(
    log: DataFrame, scope: list[str] = ENTITY_SCOPE, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Every entry with ``transaction_rows`` and ``is_explicit`` (more than one row in scope)."""
    on = [*scope, "transaction_id"]
    light, heavy = split_heavy(log, scope, heavy_rows)
    if light is not None:
        light = light.withColumn("transaction_rows", F.count(F.lit(1)).over(window_over(on)))
    if heavy is not None:
        counts = heavy.groupBy(*on).agg(F.count(F.lit(1)).alias("transaction_rows"))
        heavy = join_weighted(heavy, counts, on, "transaction_rows", ["id"], heavy_rows)
    return both(light, heavy).withColumn("is_explicit", F.col("transaction_rows") > 1)


def sessionize_autocommit(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Autocommit transactions (of one row each) with the first entry of their time group."""
    light, heavy = _split(log, scope, heavy_rows)
    members = both(
        None if light is None else _members_light(light, scope, window_ms),
        None if heavy is None else _members_heavy(heavy, scope, window_ms),
    )
    return members.filter("is_autocommit").select(
        *scope,
        "transaction_id",
        F.timestamp_millis("start_ms").alias("session_start"),
        F.col("start_id").alias("session_first_id"),
    )


def entity_history(
    log: DataFrame,
    entity_type: str,
    entity_id: str,
    since=None,
    until=None,
    version: int | None = None,
    window_ms: int = DEFAULT_WINDOW_MS,
    versions: str = "filtered",
    heavy_rows: int = HEAVY_ROWS,
    schema_name: str | None = None,
) -> DataFrame:
    """Versioned entries of one entity.

    If the log tells the databases of its entries (``schema_name``), the entity of each database has a
    history of its own, numbered by itself; ``schema_name`` picks one of them.

    ``versions="filtered"``: the time range is applied before grouping, so versions count from the
    start of the range and a transaction cut by it may fall apart into autocommit rows.
    ``versions="full"``: changesets are built from the whole history, then entries outside the
    range are left out.
    """
    from .query import matching

    if versions not in ("filtered", "full"):
        raise ValueError("versions must be 'filtered' or 'full'")
    inside = {"since": since, "until": until}
    entries = log.filter(
        matching(log, entity_type, entity_id, **(inside if versions == "filtered" else {}))
    )
    if schema_name is not None:
        entries = entries.filter(F.col("schema_name") == schema_name)
    history = assign_versions(entries, window_ms, scope_of(log), heavy_rows)
    if versions == "full":
        history = history.filter(matching(history, **inside))
    return history if version is None else history.filter(F.col("version") == version)


def changeset_tables(
    entries: DataFrame, scope: list[str] = ENTITY_SCOPE, with_size: bool = False
) -> DataFrame:
    """Per changeset of versioned entries the distinct tables in the order of first appearance.

    Reduced to one row per (changeset, table) first, so the list is as long as an entity has
    tables, however many entries there are.
    """
    first = F.min(F.struct(*ENTRY_ORDER)).alias("first")
    listed = (
        entries.groupBy(*scope, "version", "table_name")
        .agg(first, F.count(F.lit(1)).alias("rows"))
        .groupBy(*scope, "version")
        .agg(
            F.array_sort(F.collect_list(F.struct("first", "table_name"))).alias("t"),
            F.sum("rows").alias("table_rows"),
        )
    )
    size = ["table_rows"] if with_size else []
    return listed.select(*scope, "version", F.col("t.table_name").alias("tables"), *size)
