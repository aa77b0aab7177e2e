"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _stars(links: DataFrame, upward: bool) -> DataFrame:
    """Links every node's neighbours to the smallest of them and the node itself: the larger
    neighbours if ``upward``, else the smaller ones and the node."""
    both = links.union(links.select("v", "u")).toDF("u", "v") if upward else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if upward:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Here every v is below u: the node itself and its neighbours hang from the smallest.
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is named by its least node.

    Large-star and small-star steps in turn until the links no longer change: rounds grow with the
    logarithm of the longest path. A node with very many links is reduced map-side; each round is
    written to the shared folder.
    """
    links = links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links = materialise(links.distinct(), "links")
    before = None
    while True:
        large = _stars(links, upward=True).distinct()
        small = _stars(large, upward=False).filter("u <> v").distinct()
        links = materialise(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
