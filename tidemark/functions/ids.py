"""Identifiers that come out the same when a task is retried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """A positive 63-bit id from the content of an entry.

    Not guaranteed unique at very large scale: nothing joins on it, and orders that use it go on
    to further columns of the entry.
    """
    bits = F.conv(F.substring(F.md5(joined_parts(*parts)), 1, 16), 16, -10).cast("long")
    return bits.bitwiseAND(F.lit((1 << 63) - 1))


def content_hash(*parts: Column) -> Column:
    return F.sha2(joined_parts(*parts), 256)


def joined_parts(*parts: Column) -> Column:
    """The parts as one text that tells all lists of parts apart: each with its length, null as ``-``."""
    texts = [p.cast("string") for p in parts]
    return F.concat(
        *[
            F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))
            for t in texts
        ]
    )
