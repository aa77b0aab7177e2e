"""Changelogs, feeds and catalogs derived from the test tables, so that work grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.heavy import with_previous
from .schemas import CHANGELOG_COLUMNS
from .session import new_path, streaming_session
from .sources.catalog import catalog_columns, column_list, foreign_keys
from .sources.changelog import read_changelog, write_changelog
from .streaming.run import run_available

# The gap that groups autocommit rows of the derived changelog: half a day.
DERIVED_WINDOW_MS = 43_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as changes: entity by user, image by event, transaction by user and day."""
    user, event = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    # Fifty rows for every 5,000 events, so that the number of row keys grows with the data.
    row = (event % 50 + F.floor(event / 5000) * 50).cast("string")
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        F.when(user % 3 == 0, "vessel")
        .when(user % 3 == 1, "voyage")
        .otherwise("crew")
        .alias("entity_type"),
        user.cast("string").alias("entity_id"),
        F.when(event % 4 == 0, "root")
        .otherwise(F.concat(F.lit("child"), (event % 3).cast("string")))
        .alias("table_name"),
        row.alias("row_id"),
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
        .alias("operation"),
        F.concat(
            F.lit('{"id":'),
            row,
            F.lit(',"k":'),
            (k % 5).cast("string"),
            F.lit(',"kind":"'),
            F.col("event_type"),
            F.lit('"}'),
        ).alias("image"),
        F.concat(user.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias(
            "transaction_id"
        ),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    entries = with_previous(entries, ["entity_type", "entity_id"], ["created_at", "id"], ["image"])
    operation, image = F.col("operation"), F.col("image")
    none = F.lit('{"id":-1,"k":-1,"kind":"none"}')
    return entries.select(
        "id",
        "entity_type",
        "entity_id",
        "table_name",
        "row_id",
        "operation",
        F.when(operation == "DELETE", image)
        .when(operation == "UPDATE", F.coalesce("previous.image", none))
        .alias("old_values"),
        F.when(operation != "DELETE", image).alias("new_values"),
        "transaction_id",
        "created_at",
    )


# Tables derived once per application and data folder: (application, folder, name) -> path.
_STORED: dict[tuple[str, str, str], str] = {}


def _path(spark: SparkSession, sf_dir: str, derive, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, derive.__name__)
    if key not in _STORED:
        path = new_path(spark, derive.__name__)
        write(derive(spark, sf_dir), path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, derive) -> DataFrame:
    """What ``derive(spark, sf_dir)`` gives, as a table in the shared folder.

    Catalogs, snapshots and changelogs are stored tables in real use; deriving them again for every
    operator would time the derivation instead.
    """
    path = _path(spark, sf_dir, derive, lambda df, path: df.write.parquet(path))
    return spark.read.parquet(path)


def stored_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived changelog as ``write_changelog`` lays it out, with its ``created_date``."""
    return read_changelog(spark, _path(spark, sf_dir, changelog, write_changelog))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_changelog(spark, sf_dir).select(*CHANGELOG_COLUMNS)


def log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).drop("old_values", "new_values")


def run_in_slices(spark: SparkSession, source: DataFrame, build, name: str, slices: int = 2):
    """Feed ``source`` to a stream in time slices and return the table that ``build`` produces.

    ``build(stream)`` makes the streaming frame. Each slice is written, then the query is started
    on its checkpoint again. A row far in the future closes what is open; callers filter
    ``entity_type`` or ``table_name`` 'sentinel' out.
    """
    session = streaming_session(spark)
    inputs, output, state = (new_path(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    first, last = source.agg(F.min("created_at"), F.max("created_at")).first()
    step = (last - first) / slices
    sentinel = _sentinel(source)
    for number in range(slices):
        begin = F.lit(True) if number == 0 else F.col("created_at") > first + step * number
        final = number == slices - 1
        end = F.lit(True) if final else F.col("created_at") <= first + step * (number + 1)
        slice_ = source.filter(begin & end)
        (slice_.unionByName(sentinel) if final else slice_).write.parquet(f"{inputs}/{number}")
        stream = (
            session.readStream.schema(source.schema)
            .option("recursiveFileLookup", "true")
            .parquet(inputs)
        )
        result = run_available(build(stream), output, state)
    return spark.read.schema(result.schema).parquet(output)


def feed_slices(
    spark: SparkSession, source: DataFrame, start, name: str, slices: int = 2, postponed: str | None = None
) -> str:
    """Feed ``source`` to a query in time slices and return the folder of its tables.

    ``start(stream, folder, checkpoint)`` starts the query; it is started on its checkpoint again for
    each slice. Rows that the condition ``postponed`` holds for come one slice after their own. A row far in the future ends
    the last slice, so that all that is open closes; callers filter 'sentinel' out.
    """
    session = streaming_session(spark)
    inputs, folder, state = (new_path(spark, f"{name}-{part}") for part in ("in", "tables", "state"))
    us = F.unix_micros("created_at")
    first, last = source.agg(F.min(us), F.max(us)).first()
    number = F.floor((us - first) * slices / F.lit(last - first + 1))
    if postponed is not None:
        number, slices = number + F.expr(postponed).cast("int"), slices + 1
    for turn in range(slices):
        part = source.filter(number == turn)
        (part.unionByName(_sentinel(source)) if turn == slices - 1 else part).write.parquet(f"{inputs}/{turn}")
        stream = (
            session.readStream.schema(source.schema)
            .option("recursiveFileLookup", "true")
            .parquet(inputs)
        )
        start(stream, folder, state).awaitTermination()
    return folder


def _sentinel(source: DataFrame) -> DataFrame:
    values = {"timestamp": F.lit("2100-01-01 00:00:00").cast("timestamp"), "string": F.lit("sentinel")}
    values["bigint"] = F.lit(-1).cast("long")
    return source.sparkSession.range(1).select(*[values[t].alias(c) for c, t in source.dtypes])


def skewed_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived changelog with a third of all rows in one entity, without images."""
    hot = F.col("id") % 3 == 0
    return log_keys(spark, sf_dir).withColumns(
        {
            "entity_type": F.when(hot, "vessel").otherwise(F.col("entity_type")),
            "entity_id": F.when(hot, "hot").otherwise(F.col("entity_id")),
        }
    )


# ---------------------------------------------------------------------------------------------
# A fleet of databases out of `lineitem`: one database per supplier, forty tables in each, with
# columns and references by line number and order. Tables 0-3 are referred to by others, 4-11
# refer to those and are referred to by 12-33, the rest stands alone.
# ---------------------------------------------------------------------------------------------


TABLE = ["schema_name", "table_name"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s"),
        (F.col("l_partkey") % 40).alias("t"),
        F.col("l_linenumber").cast("long").alias("n"),
        F.col("l_orderkey").alias("o"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Names for the numbers of databases and tables; made after reducing to what is needed."""
    schema = F.concat(F.lit("db"), F.col("s").cast("string"))
    return df.withColumns({"schema_name": schema, "table_name": _table_name(F.col("t"))})


def _table_name(number: Column) -> Column:
    prefix = F.when(number == 38, "__tidemark_t").otherwise("t")
    return F.concat(prefix, F.lpad(number.cast("string"), 2, "0"))


def fleet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(database, table, line number) with the earliest order class."""
    lines = _lines(spark, sf_dir)
    return lines.groupBy("s", "t", "n").agg(F.min(F.col("o") % 3).alias("since"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, so that all frames of the fleet share one pass over the lines."""
    return stored(spark, sf_dir, fleet_numbers)


def fleet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(database, table, line number, number of the table referred to)"""
    t, n, o = F.col("t"), F.col("n"), F.col("o")
    child = t.between(12, 33)
    target = (
        F.when(t.between(4, 11) & (n <= 2), o % 4)
        .when(child & n.isin(1, 7) & (o % 3 == 0), o % 8 + 4)
        .when(child & (n == 2), o % 4)
        .when(child & (n == 3) & (t % 5 == 0), t)
    )
    edges = _lines(spark, sf_dir).select("s", "t", "n", target.alias("u"))
    return edges.filter("u IS NOT NULL").distinct()


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = F.concat(F.lit("r"), F.col("u").cast("string"), F.lit("_"), F.col("n").cast("string"))
    return _named(stored(spark, sf_dir, fleet_edges)).select(
        *TABLE,
        column.alias("column_name"),
        "u",
        "n",
        F.concat("table_name", F.lit("_"), column, F.lit("_fkey")).alias("constraint_name"),
    )


def _type(n: Column) -> Column:
    return F.when(n % 3 == 0, "integer").when(n % 3 == 1, "varchar").otherwise("timestamptz")


def fleet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("t") == 39, "VIEW").otherwise("BASE TABLE")
    tables = _named(_numbers(spark, sf_dir).select("s", "t").distinct())
    return tables.select(*TABLE, kind.alias("table_type"))


def fleet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = _numbers(spark, sf_dir)
    n = F.col("n")
    keyless = F.col("t") % 13 == 7
    first = _named(numbers.select("s", "t").distinct()).select(
        *TABLE,
        F.when(keyless, "payload").otherwise("id").alias("column_name"),
        F.lit(1).cast("long").alias("ordinal"),
        F.when(keyless, "jsonb").otherwise("integer").alias("data_type"),
        F.when(keyless, "YES").otherwise("NO").alias("is_nullable"),
    )
    attributes = _named(numbers).select(
        *TABLE,
        F.concat(F.lit("c"), n.cast("string")),
        n + 1,
        _type(n),
        F.when(n % 2 == 0, "YES").otherwise("NO"),
    )
    references = _references(spark, sf_dir).select(
        *TABLE, "column_name", F.col("u") * 8 + n + 10, F.lit("integer"), F.lit("YES")
    )
    return first.union(attributes).union(references)


def fleet_pk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = _numbers(spark, sf_dir)
    single = numbers.select("s", "t").distinct().filter(F.col("t") % 13 != 7)
    second = numbers.filter((F.col("t") % 11 == 3) & (F.col("n") == 1)).select("s", "t")
    keys = single.withColumn("column_name", F.lit("id")).union(
        second.withColumn("column_name", F.lit("c1"))
    )
    return _named(keys).select(*TABLE, "column_name")


def fleet_constraints(
    spark: SparkSession, sf_dir: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(constraints, key usage, referenced usage)"""
    name = ["schema_name", "constraint_name"]
    references = _references(spark, sf_dir)
    keys = fleet_pk_columns(spark, sf_dir).withColumn(
        "constraint_name", F.concat("table_name", F.lit("_pkey"))
    )
    constraints = references.select(
        *name, F.lit("FOREIGN KEY").alias("constraint_type")
    ).unionByName(keys.select(*name, F.lit("PRIMARY KEY").alias("constraint_type")).distinct())
    usage = references.select(*name, "table_name", "column_name").unionByName(
        keys.select(*name, "table_name", "column_name")
    )
    referenced = references.select(
        *name, _table_name(F.col("u")).alias("table_name"), F.lit("id").alias("column_name")
    )
    return constraints, usage, referenced


def fleet_catalog(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    return catalog_columns(
        fleet_tables(spark, sf_dir),
        fleet_columns(spark, sf_dir),
        fleet_pk_columns(spark, sf_dir),
        ordered=ordered,
    )


def fleet_foreign_keys(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    return foreign_keys(*fleet_constraints(spark, sf_dir), ordered=ordered)


# Four states of each table's columns. The first three are snapshots, the last is the live schema.
_STATES = [0, 1, 2]
_LIVE = 3


def _stated_columns(spark: SparkSession, sf_dir: str, states: list[int]) -> DataFrame:
    """Columns of every table in the given states: columns come in over time, number 6 goes and
    comes back, number 5 gets wider, 4 becomes nullable, 7 at last does too."""
    k, n = F.col("k"), F.col("n")
    seen = _numbers(spark, sf_dir)
    state = F.explode(F.array(*map(F.lit, states))).alias("k")
    attributes = (
        seen.select("*", state)
        .filter((F.col("since") <= k) & ~((n == 6) & (k == 2)))
        .select(
            "s",
            "t",
            "k",
            (n + 1).cast("int").alias("ordinal"),
            F.concat(F.lit("c"), n.cast("string")).alias("name"),
            F.when((n == 5) & (k >= 2), "bigint").otherwise(_type(n)).alias("data_type"),
            F.when(n == 4, k >= 1)
            .when(n == 7, k >= 3)
            .otherwise(n % 2 == 0)
            .alias("nullable"),
            F.lit(False).alias("is_pk"),
        )
    )
    ids = (
        seen.select("s", "t")
        .distinct()
        .select("*", state)
        .selectExpr("*", "1 ordinal", "'id' name", "'integer' data_type", "false nullable", "true is_pk")
    )
    return ids.unionByName(attributes)


def fleet_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _named(
            _stated_columns(spark, sf_dir, _STATES)
            .groupBy("s", "t", "k")
            .agg(column_list().alias("columns"))
        )
        .select(
            ((F.col("s") * 40 + F.col("t")) * 4 + F.col("k")).alias("id"),
            "schema_name",
            "table_name",
            "columns",
            F.timestamp_seconds(F.col("k") * 86_400 + 1_704_067_200).alias("captured_at"),
        )
    )


def fleet_live_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live schema; tables with number 5, 22 and 39 have been dropped."""
    return (
        _named(_stated_columns(spark, sf_dir, [_LIVE]).filter(F.col("t") % 17 != 5))
        .select("schema_name", "table_name", "ordinal", "name", "data_type", "nullable", "is_pk")
    )


def fleet_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _numbers(spark, sf_dir).select("s", "t").distinct()
    return _named(tables.filter(F.col("t") < 34)).select(*TABLE)
