"""Keys of tables that declare none: profile columns, verify references."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

# Sketches of 2^12 entries: distinct counts come out within 1.6 % (one standard error), and exactly if
# there are no more values than entries.
SKETCH_SIZE, SKETCH_ERROR = 12, 0.016
# Kinds of columns whose values may refer to each other, by type.
KINDS = {
    T.ByteType: "whole", T.ShortType: "whole", T.IntegerType: "whole", T.LongType: "whole",
    T.StringType: "text", T.DateType: "date", T.BinaryType: "binary",
}


def profile_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, exact number of distinct values, nullable, unique.

    A column is reduced to (value, count) before its groups are counted: map-side combining takes
    care of frequent values, and each column is shuffled alone, as narrow as it is.
    """
    return reduce(DataFrame.unionByName, [_profile(df, c) for c in columns or df.columns])


def _named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def _profile(df: DataFrame, column: str) -> DataFrame:
    values = df.groupBy(_named(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    absent = F.col("value").isNull()
    return values.agg(
        F.lit(column).alias("column_name"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(absent, F.col("rows"))), F.lit(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"),
    ).select(
        "*",
        (F.col("n_nulls") > 0).alias("nullable"),
        ((F.col("n_nulls") == 0) & (F.col("n_distinct") == F.col("n_rows"))).alias("is_unique"),
    )


def check_foreign_keys(
    tables: dict[str, DataFrame], candidates: Iterable[tuple[str, str, str, str]]
) -> DataFrame:
    """Per candidate (from table, from column, to table, to column): orphan rows, whether the
    target is unique, and whether it holds as a foreign key. Null references are no orphans.

    References are counted per value before the anti join, so a frequent value is one row of it.
    """
    return reduce(DataFrame.unionByName, [_check(tables, *c) for c in candidates])


def _check(
    tables: dict[str, DataFrame], from_table: str, from_column: str, to_table: str, to_column: str
) -> DataFrame:
    used = (
        tables[from_table]
        .filter(_named(from_column).isNotNull())
        .groupBy(_named(from_column).alias("key"))
        .agg(F.count(F.lit(1)).alias("from_rows"))
    )
    known = (
        tables[to_table]
        .filter(_named(to_column).isNotNull())
        .groupBy(_named(to_column).alias("key"))
        .agg(F.count(F.lit(1)).alias("to_rows"))
    )
    joined = used.join(known, "key", "full_outer")
    orphans = F.sum(F.when(F.col("to_rows").isNull(), F.col("from_rows")))
    return joined.agg(
        F.lit(from_table).alias("from_table"),
        F.lit(from_column).alias("from_column"),
        F.lit(to_table).alias("to_table"),
        F.lit(to_column).alias("to_column"),
        F.coalesce(orphans, F.lit(0)).alias("orphan_rows"),
        F.coalesce(F.max("to_rows") <= 1, F.lit(True)).alias("target_unique"),
    ).withColumn("holds", (F.col("orphan_rows") == 0) & F.col("target_unique"))


def _kind(field: T.StructField) -> str | None:
    return next((kind for type_, kind in KINDS.items() if isinstance(field.dataType, type_)), None)


def sketch_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column its kind, rows, nulls and a sketch of its distinct values, all in one scan.

    One aggregate of fixed size per column, merged map-side; the result has as many rows as columns.
    Columns that cannot hold keys (fractions, times, nested values) have no kind and no sketch.
    """
    kinds = {f.name: _kind(f) for f in df.schema.fields}
    columns = columns or df.columns
    described = []
    for column in columns:
        value = F.when(_named(column).isNotNull(), F.xxhash64(_named(column).cast("string")))
        sketch = F.theta_sketch_agg(value, SKETCH_SIZE) if kinds[column] else F.lit(None).cast("binary")
        described.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(kinds[column]).cast("string").alias("kind"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(_named(column).isNull()).alias("n_nulls"),
                sketch.alias("sketch"),
            )
        )
    return df.agg(F.array(*described).alias("c")).select(F.inline("c"))


def _may_be_unique() -> Column:
    """Without nulls, and as many values as rows within six standard errors of the estimate."""
    distinct = F.theta_sketch_estimate("sketch")
    return (F.col("n_nulls") == 0) & F.coalesce(distinct >= F.col("n_rows") * (1 - 6 * SKETCH_ERROR), F.lit(False))


def find_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Which columns are unique and never null: (column_name, n_rows, n_nulls, is_unique).

    One scan sketches all columns; only those whose estimate comes near the number of rows are counted
    exactly, so a wide table costs one scan and one narrow shuffle for each likely key. Columns that
    cannot hold keys are not unique. ``profile_keys`` counts all distinct values of all columns.
    """
    found = sketch_columns(df, columns).select("column_name", "n_rows", "n_nulls", _may_be_unique().alias("likely"))
    rows = found.collect()  # one per column
    likely = [r["column_name"] for r in rows if r["likely"]]
    settled = df.sparkSession.createDataFrame(
        [(r["column_name"], r["n_rows"], r["n_nulls"], False) for r in rows if not r["likely"]],
        "column_name string, n_rows long, n_nulls long, is_unique boolean",
    )
    if not likely:
        return settled
    counted = profile_keys(df, likely).select("column_name", "n_rows", "n_nulls", "is_unique")
    return settled.unionByName(counted)


def discover_foreign_keys(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """References between tables that declare none: every pair of columns that holds as a foreign key,
    as ``check_foreign_keys`` describes it. ``columns`` narrows down which columns of a table count.

    One scan of each table sketches its columns. A pair of one kind can hold only if the target may be
    unique and the sketch of the source has nothing that the target's lacks; of a true reference
    a sketch never shows anything missing, so none is lost. Survivors are checked exactly. Columns
    without a value refer to nothing.
    """
    sketched = [
        sketch_columns(df, (columns or {}).get(name)).select(F.lit(name).alias("table_name"), "*", _may_be_unique().alias("likely"))
        for name, df in tables.items()
    ]
    # One small row per column of all tables, written once: the scans happen here.
    every = materialise(reduce(DataFrame.unionByName, sketched).filter("kind IS NOT NULL"), "sketches")
    source = every.filter("n_nulls < n_rows").select(
        "kind", F.col("table_name").alias("a"), F.col("column_name").alias("a_column"), F.col("sketch").alias("a_sketch")
    )
    target = every.filter("likely").select(
        "kind", F.col("table_name").alias("b"), F.col("column_name").alias("b_column"), F.col("sketch").alias("b_sketch")
    )
    pairs = source.join(target, "kind").filter((F.col("a") != F.col("b")) | (F.col("a_column") != F.col("b_column")))
    nothing_missing = F.theta_sketch_estimate(F.theta_difference("a_sketch", "b_sketch")) == 0
    candidates = [tuple(r) for r in pairs.filter(nothing_missing).select("a", "a_column", "b", "b_column").collect()]
    empty = "from_table string, from_column string, to_table string, to_column string, orphan_rows long, target_unique boolean, holds boolean"
    if not candidates:
        return next(iter(tables.values())).sparkSession.createDataFrame([], empty)
    return check_foreign_keys(tables, sorted(candidates)).filter("holds")
