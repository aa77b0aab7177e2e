"""Entities from foreign keys: classification of tables, roots and children, conflicts, overrides.

Every frame is keyed by ``schema_name``, so a whole fleet of databases is analysed in one job. All
reductions are associative aggregates; no database and no table is ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    CHILD_WITHOUT_KEY,
    NO_ENTITY,
    OWNED_TWICE,
    ROOT_WITHOUT_KEY,
    filled,
)
from ..plans.heavy import HEAVY_ROWS, with_previous
from ..session import materialise

TABLE = ["schema_name", "table_name"]
LOOKUP, ROOT, ISOLATED, OTHER = "lookup", "root", "isolated", "other"


def fk_degrees(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """Distinct other tables each table refers to (out) and is referred to by (in).

    Tables without edges are kept, as are edge ends missing from ``tables``. Each edge counts once
    at both ends; a table's reference to itself does not count.
    """
    edges = (
        fks.filter(F.col("from_table") != F.col("to_table"))
        .select("schema_name", "from_table", "to_table")
        .distinct()
    )
    end = F.explode(
        F.array(
            F.struct(F.col("from_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("to_table").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    ends = edges.select("schema_name", end.alias("e")).select("schema_name", "e.*")
    nodes = tables.select(*TABLE, F.lit(0).alias("o"), F.lit(0).alias("i"))
    return (
        nodes.unionByName(ends)
        .groupBy(*TABLE)
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    )


def classify_tables(degrees: DataFrame) -> DataFrame:
    out, into = F.col("out_degree"), F.col("in_degree")
    kind = (
        F.when((out == 0) & (into == 0), ISOLATED)
        .when(out == 0, LOOKUP)
        .when(into > 0, ROOT)
        .otherwise(OTHER)
    )
    return degrees.select(*TABLE, kind.alias("class"))


def _facts(classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per table its class, whether the catalog knows it, and its (first) key column.

    Written once: roots and children are picked from it several times.
    """
    keys = catalog.groupBy(*TABLE).agg(
        F.min(F.when(F.col("is_pk"), F.struct("ordinal", "name"))).alias("pk"),
        F.lit(True).alias("in_catalog"),
    )
    facts = classes.join(keys, TABLE, "left").select(
        *TABLE, "class", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"),
        F.col("pk.name").alias("pk_column"),
    )
    return materialise(facts, "facts")


def _claims(fks: DataFrame, facts: DataFrame) -> DataFrame:
    """Foreign keys from possible children to usable roots."""
    roots = facts.filter((F.col("class") == ROOT) & F.col("pk_column").isNotNull()).select(
        "schema_name", F.col("table_name").alias("to_table")
    )
    children = facts.filter(~F.col("class").isin(LOOKUP, ROOT)).select(
        "schema_name",
        F.col("table_name").alias("from_table"),
        (F.col("pk_column").isNotNull() | ~F.col("in_catalog")).alias("eligible"),
    )
    return (
        fks.filter(F.col("from_table") != F.col("to_table"))
        .join(roots, ["schema_name", "to_table"], "left_semi")
        .join(children, ["schema_name", "from_table"])
    )


def resolve_entities(fks: DataFrame, classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The entity map: per root one row for itself and one per direct child table.

    A root is never a child. A child with several keys to one root is listed once, by the first
    constraint name. Children may still be claimed by several roots, see ``entity_conflicts``.
    """
    facts = _facts(classes, catalog)
    roots = facts.filter(
        (F.col("class") == ROOT) & F.col("in_catalog") & F.col("pk_column").isNotNull()
    ).select(
        "schema_name",
        F.col("table_name").alias("entity_type"),
        "table_name",
        F.lit(True).alias("is_root"),
        F.col("pk_column").alias("entity_key_col"),
        F.array("pk_column").alias("row_key_cols"),
    )
    first = F.min(F.struct("constraint_name", "from_column"))
    children = (
        _claims(fks, facts)
        .filter("eligible")
        .groupBy("schema_name", "to_table", "from_table")
        .agg(first.alias("first"))
        .select(
            "schema_name",
            F.col("to_table").alias("entity_type"),
            F.col("from_table").alias("table_name"),
            F.lit(False).alias("is_root"),
            F.col("first.from_column").alias("entity_key_col"),
            # The row id of a child is its column named id.
            F.array(F.lit("id")).alias("row_key_cols"),
        )
    )
    return roots.unionByName(children)


def entity_child_counts(entity_map: DataFrame) -> DataFrame:
    """Entities by number of children, largest first, then by name."""
    return (
        entity_map.groupBy("schema_name", "entity_type")
        .agg(F.count_if(~F.col("is_root")).alias("children"))
        .orderBy("schema_name", F.desc("children"), "entity_type")
    )


def entity_conflicts(entity_map: DataFrame) -> DataFrame:
    """Child tables claimed by more than one entity, with the claimants by name.

    The list is no longer than the child has foreign keys.
    """
    return (
        entity_map.filter(~F.col("is_root"))
        .groupBy(*TABLE)
        .agg(F.array_sort(F.collect_set("entity_type")).alias("claimed_by"))
        .filter(F.size("claimed_by") > 1)
    )


def unassigned_tables(classes: DataFrame, entity_map: DataFrame) -> DataFrame:
    return (
        classes.filter(~F.col("class").isin(LOOKUP, ISOLATED))
        .select(*TABLE)
        .join(entity_map.select(*TABLE).distinct(), TABLE, "left_anti")
    )


def entity_warnings(fks: DataFrame, classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables skipped for want of a primary key: as a root once, as a child once per foreign key."""
    facts = _facts(classes, catalog)
    roots = facts.filter(
        (F.col("class") == ROOT) & F.col("in_catalog") & F.col("pk_column").isNull()
    ).select(
        *TABLE,
        F.lit("").alias("root_table"),
        F.lit("").alias("constraint_name"),
        filled(ROOT_WITHOUT_KEY, "table_name").alias("message"),
    )
    children = (
        _claims(fks, facts)
        .filter("NOT eligible")
        .select(
            "schema_name",
            F.col("from_table").alias("table_name"),
            F.col("to_table").alias("root_table"),
            "constraint_name",
            filled(CHILD_WITHOUT_KEY, "from_table", "to_table").alias("message"),
        )
    )
    return roots.unionByName(children)


def apply_overrides(entity_map: DataFrame, exclude: DataFrame, reassign: DataFrame) -> DataFrame:
    """Manual changes to the map: leave out child tables, then hand tables to other entities.

    ``exclude(schema_name, table_name)``; ``reassign(schema_name, table_name, to_entity)``. A table
    may occur several times only if there is a ``position``; the last counts. A reassigned table leaves
    all owners and joins the target by its key to it or, if it has none, by the first key it has
    to any entity (entities by number of children). It is gone if the target is no entity.
    """
    if "position" in reassign.columns:
        target = F.max_by("to_entity", "position")
    else:
        target = F.max("to_entity")
        repeated = reassign.groupBy(*TABLE).count().filter("count > 1").first()
        if repeated:
            raise ValueError(f"table {repeated['table_name']!r} is moved twice: give the moves a position")
    by_table = reassign.groupBy(*TABLE).agg(target.alias("to_entity"))
    entity_map = materialise(entity_map, "entity-map")  # read six times below
    children = entity_map.filter(~F.col("is_root"))
    kept = (
        children.join(exclude.select(*TABLE).distinct(), TABLE, "left_anti")
        .join(by_table, TABLE, "left_anti")
    )
    sizes = entity_child_counts(entity_map)
    rank = F.struct(
        (F.col("entity_type") != F.col("to_entity")).alias("elsewhere"),
        (-F.col("children")).alias("size"),
        "entity_type",
    )
    # The columns of each table's best known key, out of the map before any exclusion.
    best = (
        children.join(by_table, TABLE)
        .join(sizes, ["schema_name", "entity_type"])
        .groupBy(*TABLE)
        .agg(
            F.min_by(F.struct("to_entity", "entity_key_col", "row_key_cols"), rank).alias("b")
        )
        .select(*TABLE, F.col("b.to_entity").alias("entity_type"), "b.entity_key_col", "b.row_key_cols")
        .join(sizes.select("schema_name", "entity_type"), ["schema_name", "entity_type"], "left_semi")
        .withColumn("is_root", F.lit(False))
    )
    return entity_map.filter("is_root").unionByName(kept).unionByName(best)


def default_entity_map(entity_map: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The map without children claimed by several entities."""
    contested = conflicts.select(*TABLE)
    return entity_map.filter("is_root").unionByName(
        entity_map.filter(~F.col("is_root")).join(contested, TABLE, "left_anti")
    )


def ignored_tables(classes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Tables the default map leaves alone, with the reason."""
    apart = classes.filter(F.col("class").isin(ISOLATED, LOOKUP))
    return apart.select(*TABLE, F.col("class").alias("reason")).unionByName(
        conflicts.select(*TABLE, F.lit("conflict").alias("reason"))
    )


def validate_entity_map(
    entity_map: DataFrame, schemas: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Errors: a table with two owners (one error per further owner), a schema without entities.

    Owners of a table are told in map order: by ``position`` if there is one, else by entity name.
    """
    entity_map = materialise(entity_map, "entity-map")  # counted, put in order, searched for schemas
    order = ["position"] if "position" in entity_map.columns else []
    owned = with_previous(
        entity_map, TABLE, [*order, "entity_type", "is_root"], ["entity_type"], heavy_rows
    )
    errors = owned.filter(F.col("previous").isNotNull()).select(
        *TABLE,
        filled(OWNED_TWICE, "table_name", "previous.entity_type", "entity_type").alias("error"),
    )
    if schemas is None:
        return errors
    empty = (
        schemas.select("schema_name")
        .distinct()
        .join(entity_map.select("schema_name"), "schema_name", "left_anti")
        .select(
            "schema_name",
            F.lit("").alias("table_name"),
            F.lit(NO_ENTITY).alias("error"),
        )
    )
    return errors.unionByName(empty)
