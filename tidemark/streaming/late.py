"""Rows that arrive behind the watermark: told apart while streaming, put right afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.heavy import broadcast_checked, match
from ..schemas import ENTITY_SCOPE


def mark_late(rows: DataFrame, watermark_ms: int | None) -> DataFrame:
    """``rows`` with ``is_late``: their time is at or below the watermark, or they have none."""
    at = F.unix_millis("created_at")
    behind = at.isNull() if watermark_ms is None else F.coalesce(at <= watermark_ms, F.lit(True))
    return rows.withColumn("is_late", behind)


def advanced(rows: DataFrame, watermark_ms: int | None, delay_ms: int) -> int | None:
    """The watermark behind a batch: the newest time less the delay; it never goes back."""
    newest = rows.agg(F.max(F.unix_millis("created_at")).alias("newest")).first()["newest"]
    known = [w for w in (watermark_ms, None if newest is None else newest - delay_ms) if w is not None]
    return max(known, default=None)


def corrected(
    log: DataFrame,
    late: DataFrame,
    streamed: DataFrame,
    rebuild: Callable[[DataFrame], DataFrame],
    scope: list[str] = ENTITY_SCOPE,
) -> DataFrame:
    """What a batch run over the whole ``log`` gives, at the price of the entities that ``late`` touches.

    ``streamed`` is what the stream gave from the rows that were on time, ``rebuild`` the batch operator.
    Results of touched entities are replaced by a new run over their entries of ``log``; all others stay.
    """
    touched = broadcast_checked(late.select(*scope).distinct())
    rebuilt = rebuild(match(log, touched, scope, "left_semi"))
    return match(streamed, touched, scope, "left_anti").unionByName(rebuilt.select(*streamed.columns))
