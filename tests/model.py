"""The changeset rules for one scope, one entry at a time; the judge of the distributed operator."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timezone


def millis(at: datetime) -> int:
    whole = int(at.replace(microsecond=0, tzinfo=timezone.utc).timestamp()) * 1000
    return whole + at.microsecond // 1000


def changesets(entries: list[tuple], window_ms: int) -> list[tuple]:
    """entries: (created_at, id, transaction); result: (version, ids, grouped flag)"""
    of_transaction = defaultdict(list)
    for at, number, tx in sorted(entries):
        of_transaction[tx].append((millis(at), at, number))
    found = [(g[0][0], False, g[0][1:], g) for g in of_transaction.values() if len(g) > 1]
    burst = []
    singles = sorted(g[0] for g in of_transaction.values() if len(g) == 1)
    for single in singles:
        if burst and single[0] - burst[-1][0] > window_ms:
            found.append((burst[0][0], True, burst[0][1:], burst))
            burst = []
        burst.append(single)
    if burst:
        found.append((burst[0][0], True, burst[0][1:], burst))
    found.sort(key=lambda f: f[:3])
    return [
        (version, [e[2] for e in group], auto and len(group) > 1)
        for version, (_, auto, _, group) in enumerate(found, start=1)
    ]
