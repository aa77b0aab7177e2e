"""Change capture in batch: snapshot pairs, change feeds and keyed upserts become changelog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entries import valid_entry
from ..functions.ids import content_hash, content_id
from ..functions.images import image_text, row_image
from ..plans.heavy import HEAVY_ROWS, broadcast_checked, match, with_previous
from ..schemas import CHANGELOG_COLUMNS, DELETE, INSERT, UPDATE


def quoted(*path: str) -> Column:
    """The column of exactly these names, whatever characters they have."""
    return F.col(".".join("`" + name.replace("`", "``") + "`" for name in path))


def _key_text(texts: list[Column]) -> Column:
    """Key values as text, several as a JSON array of texts; null if any is null."""
    missing = F.lit(False)
    for text in texts:
        missing = missing | text.isNull()
    return F.when(~missing, texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)))


def _text_key(columns: list[str], side: str) -> Column:
    return _key_text([quoted(side, c).cast("string") for c in columns])


def capture_snapshot_diff(
    before: DataFrame,
    after: DataFrame,
    key_cols: list[str],
    *,
    table_name: str,
    entity_type: str,
    entity_key_col: str,
    captured_at,
    transaction_id: str,
    row_key_cols: list[str] | None = None,
    capture_old_values: bool = True,
    capture_new_values: bool = True,
) -> DataFrame:
    """Entries that lead from one snapshot of a table to the next; equal rows give none.

    ``key_cols`` must be the table's key. One join on it; typed columns are compared null-safe and
    JSON is made of changed rows only. Both images hold the columns of their own snapshot, so an
    added column shows up as a change.
    """
    # A marker tells an absent side from a row of nulls.
    keys = {c: f"_key_{n}" for n, c in enumerate(key_cols)}
    sided = lambda df, side: df.select(
        F.struct(*map(quoted, df.columns)).alias(side), *[quoted(c).alias(k) for c, k in keys.items()]
    )
    pairs = sided(before, "old").join(sided(after, "new"), list(keys.values()), "full_outer")
    common = [c for c in after.columns if c in before.columns and c not in key_cols]
    differs = F.lit(set(before.columns) != set(after.columns))
    for column in common:
        differs = differs | ~quoted("old", column).eqNullSafe(quoted("new", column))
    operation = (
        F.when(F.col("old").isNull(), INSERT)
        .when(F.col("new").isNull(), DELETE)
        .when(differs, UPDATE)
    )
    changes = pairs.select("old", "new", operation.alias("operation")).filter("operation IS NOT NULL")

    def current(columns: list[str]) -> Column:
        return F.when(F.col("operation") == DELETE, _text_key(columns, "old")).otherwise(
            _text_key(columns, "new")
        )

    row_id = current(row_key_cols or key_cols)
    entries = changes.select(
        current(key_cols).alias("_table_key"),
        F.lit(entity_type).alias("entity_type"),
        current([entity_key_col]).alias("entity_id"),
        F.lit(table_name).alias("table_name"),
        row_id.alias("row_id"),
        "operation",
        _image("old", before.columns, INSERT, capture_old_values).alias("old_values"),
        _image("new", after.columns, DELETE, capture_new_values).alias("new_values"),
        F.lit(transaction_id).alias("transaction_id"),
        F.lit(captured_at).cast("timestamp").alias("created_at"),
    )
    # The table's key tells its rows apart, which a configured row key need not do.
    identity = ("entity_type", "table_name", "_table_key", "operation", "transaction_id")
    when = F.unix_micros("created_at")
    return entries.withColumn("id", content_id(*map(F.col, identity), when)).select(*CHANGELOG_COLUMNS)


def _image(side: str, columns: list[str], absent_for: str, keep: bool) -> Column:
    if not keep:
        return F.lit(None).cast("string")
    image = row_image([quoted(side, c).alias(c) for c in columns])
    return F.when(F.col("operation") != absent_for, image)


def assign_transaction_id(
    df: DataFrame,
    native: str = "transaction_id",
    row_parts: list[str] = ("table_name", "row_id", "operation", "created_at", "seq"),
) -> DataFrame:
    """Keep the native id; a row without one becomes its own transaction, named by a hash of what
    identifies the row, so that a repeated task gives the same name."""
    parts = [
        F.unix_micros(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
        for c in row_parts
    ]
    own = content_hash(*parts)
    known = F.col(native) if native in df.columns else F.lit(None).cast("string")
    return df.withColumn("transaction_id", F.coalesce(known, own))


def resolve_entity_ids(changes: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Owning entity and row id of changes to many tables, from their images.

    ``changes`` has table_name, operation, old_values and new_values. The new image decides, for
    deletes the old one. Changes of tables outside the map are left out (``unmapped_changes`` counts
    them). If both have a
    ``schema_name``, a table is known by it and its name, so that one map serves many databases.
    ``entity_map`` is configuration with one row per table, which is checked; so is its size before
    it is broadcast.
    """
    both_named = "schema_name" in changes.columns and "schema_name" in entity_map.columns
    table = ["schema_name", "table_name"] if both_named else ["table_name"]
    twice = entity_map.groupBy(*table).count().filter("count > 1").first()
    if twice:
        name = ".".join(twice[c] for c in table)
        raise ValueError(f"table {name!r} has {twice['count']} owners in the entity map; see validate_entity_map")
    image = F.when(F.col("operation") == DELETE, F.col("old_values")).otherwise(
        F.col("new_values")
    )
    mapped = changes.drop("entity_type", "entity_id", "row_id").join(
        broadcast_checked(
            entity_map.select(*table, "entity_type", "entity_key_col", "row_key_cols")
        ),
        table,
    )
    keys = F.transform("row_key_cols", lambda c: F.col("image")[c])
    several = F.when(F.size(keys) > 1, F.to_json(keys)).otherwise(F.get(keys, F.lit(0)))
    row_id = F.when(~F.exists(keys, F.isnull), several)
    return (
        mapped.withColumn("image", image_text(image))
        .withColumn("entity_id", F.col("image")[F.col("entity_key_col")])
        .withColumn("row_id", row_id)
        .drop("image", "entity_key_col", "row_key_cols")
    )


def unmapped_changes(changes: DataFrame, entity_map: DataFrame) -> DataFrame:
    """(table, changes, first and last time): what ``resolve_entity_ids`` leaves out because no entity
    owns the table, counted per table; tables are told apart by database if both frames name it."""
    both_named = "schema_name" in changes.columns and "schema_name" in entity_map.columns
    table = ["schema_name", "table_name"] if both_named else ["table_name"]
    counted = changes.groupBy(*table).agg(
        F.count(F.lit(1)).alias("changes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
    return match(counted, entity_map.select(*table).distinct(), table, "left_anti")


def split_rejects(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries fit for the changelog, and the rest (no entity id, unknown operation, …)."""
    return entries.filter(valid_entry()), entries.filter(~valid_entry())


def capture_change_feed(
    feed: DataFrame,
    entity_map: DataFrame,
    capture_old_values: bool = True,
    capture_new_values: bool = True,
) -> DataFrame:
    """Change-feed rows (seq, table_name, operation, old_values, new_values, transaction_id,
    created_at) -> entries, one per row; updates that change nothing are kept.

    A projection and one map lookup, on a batch or on a stream. A row without entity id or with an
    unknown operation is an entry, too, which ``split_rejects`` and the changelog's sinks tell apart. A
    ``schema_name`` of the feed is kept as a last column.
    """
    operation = F.upper("operation")
    sided = feed.withColumns(
        {
            "operation": operation,
            "old_values": F.when(operation != INSERT, F.col("old_values")),
            "new_values": F.when(operation != DELETE, F.col("new_values")),
        }
    )
    entries = assign_transaction_id(
        resolve_entity_ids(sided, entity_map).withColumnRenamed("seq", "id"),
        row_parts=["table_name", "row_id", "operation", "created_at", "id"],
    )
    nothing = F.lit(None).cast("string")
    if not capture_old_values:
        entries = entries.withColumn("old_values", nothing)
    if not capture_new_values:
        entries = entries.withColumn("new_values", nothing)
    database = ["schema_name"] if "schema_name" in feed.columns else []
    return entries.select(*CHANGELOG_COLUMNS, *database)


def capture_keyed_changes(
    changes: DataFrame, key: list[str], seq: str, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Upserts and deletes without before-images -> operation, old_values, new_values.

    ``changes`` has ``image``, null for a delete. The batch form of the stream capture: the row
    before of the same key supplies the old image. A key's first row is an insert; so is one after
    a delete. A delete of a key that does not exist keeps a null old image.
    """
    known = with_previous(changes, key, [seq], ["image"], heavy_rows)
    before = F.col("previous.image")
    operation = (
        F.when(F.col("image").isNull(), DELETE).when(before.isNull(), INSERT).otherwise(UPDATE)
    )
    return (
        known.withColumn("operation", operation)
        .withColumn("old_values", before)
        .withColumnRenamed("image", "new_values")
        .drop("previous")
    )
