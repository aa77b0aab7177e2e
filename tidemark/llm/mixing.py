"""Bring sources to target weights by repeating documents a Poisson number of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import broadcast_if_small, free_name, quoted

CHUNK = 16.0  # a larger mean is split into equal parts; Poisson numbers add up
STEPS = 96  # beyond this many, the upper tail of a mean of 16 is below 2^-53
SALTS = 32


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) out of 52 bits of the hash of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def _distribution(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    first = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(first.alias("p"), F.array(first).alias("all")),
        lambda sofar, k: F.struct(
            (sofar["p"] * mean / k).alias("p"),
            F.array_append(
                sofar["all"], F.element_at(sofar["all"], -1) + sofar["p"] * mean / k
            ).alias("all"),
        ),
        lambda sofar: sofar["all"],
    )


def source_rates(docs: DataFrame, weights: DataFrame | None, source: str, power: float) -> DataFrame:
    """(source, n_docs, rate): how often each document of a source is to be repeated on average.

    ``weights`` has (source, weight); sources that it lacks weigh nothing. Without it, a source's
    weight is its number of documents to the ``power``. Rates keep the expected number of documents.
    """
    counts = docs.groupBy(quoted(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        weights = weights.groupBy(F.col("source").alias("weighed")).agg(
            F.sum(F.col("weight").cast("double")).alias("weight")
        )
        counts = counts.join(weights, F.expr("source <=> weighed"), "left").select(
            "source", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    counts = materialise(counts, "source-counts")
    total = counts.agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("weight").cast("decimal(38,6)")).alias("weight")
    ).first()
    docs_total, weight_total = float(total["docs"] or 0), float(total["weight"] or 0)
    if docs_total and not weight_total:
        raise ValueError("no source of the documents has a weight above zero")
    rate = F.col("weight") * F.lit(docs_total) / (F.lit(weight_total or 1.0) * F.col("n_docs"))
    return counts.select("source", "n_docs", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    power: float = 0.5,
    seed: str = "mix-1",
    key: str = "doc_id",
    source: str = "source",
    prefix: str = "mix_",
) -> DataFrame:
    """Documents repeated so that each source has its target weight, in random order.

    Each document of a source with mean rate m comes n times, n being the Poisson distribution of
    mean m inverted at a hash of (seed, key): the same input gives the same copies whatever the
    partitions, and a lost task repeats its draw. All columns stay; added are ``mix_copy`` (from 0)
    and ``mix_order``, the random key by which the rows are dealt out and sorted within partitions:
    files in any order are one uniformly random order of all rows.

    Rows with equal keys (also null keys) share one draw. A null source is a source of its own, no
    documents give no rows, existing columns of the two added names are replaced, all others stay. Rates are broadcast
    only if their measured size is small; else the join is salted, so that a source with a third of
    all rows meets many tasks.
    """
    copy, order = f"{prefix}copy", f"{prefix}order"
    kept = [c for c in docs.columns if c not in (copy, order)]
    # Names for what is joined in that the documents do not have, whatever their columns are called.
    source_, parts_, cdf_, rate_salt, salt_, copies_ = (
        free_name(docs, name) for name in ("__source", "__parts", "__cdf", "__rate_salt", "__salt", "__copies")
    )
    parts = F.ceil(F.col("rate") / CHUNK).cast("int")
    rates = source_rates(docs, weights, source, power).select(
        F.col("source").alias(source_),
        F.greatest(parts, F.lit(1)).alias(parts_),
        _distribution(F.col("rate") / F.greatest(parts, F.lit(1))).alias(cdf_),
    )
    rates = materialise(rates, "source-rates")
    small = broadcast_if_small(rates, F.octet_length(source_) + 8 * STEPS)
    matches = quoted(source).eqNullSafe(F.col(source_))
    if small is rates:
        salted = rates.withColumn(rate_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(quoted(key)), F.lit(SALTS)).cast("int")
        joined = docs.withColumn(salt_, salt).join(
            salted, matches & (F.col(salt_) == F.col(rate_salt))
        )
    else:
        joined = docs.join(small, matches)
    draws = F.transform(
        F.sequence(F.lit(1), F.col(parts_)),
        lambda part: F.size(
            F.filter(cdf_, lambda c: c <= uniform(F.lit(seed), quoted(key), part))
        ),
    )
    copies = F.aggregate(draws, F.lit(0), lambda a, n: a + n)
    n = F.col(copies_)
    repeated = joined.withColumn(copies_, copies).filter(n > 0)
    repeated = repeated.select(
        *map(quoted, kept), F.explode(F.sequence(F.lit(0), n - 1)).alias(copy)
    )
    repeated = repeated.withColumn(
        order, F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), quoted(key).cast("string"), quoted(copy)))
    )
    return repeated.repartition(quoted(order)).sortWithinPartitions(quoted(order))
