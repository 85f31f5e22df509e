"""Periods such as 6m or 2w, and dates."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Days of a unit (fixed values).
DAYS = {"y": 365, "m": 30, "w": 7, "d": 1}


def parse_period(text: str) -> timedelta | datetime:
    """A length of time (``n`` and y, m, w or d, in either case) or an ISO date; ValueError for anything else."""
    text = text.strip()
    if found := re.fullmatch(r"(\d+)([ymwd])", text.lower()):
        return timedelta(days=int(found[1]) * DAYS[found[2]])
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"neither a period like 6m nor a date: {text!r}") from None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def resolve(period: timedelta | datetime, now: datetime) -> datetime:
    return now - period if isinstance(period, timedelta) else period


def interval_ms(text: str) -> int:
    """A length of time in milliseconds; a date isn't one."""
    period = parse_period(text)
    if not isinstance(period, timedelta):
        raise ValueError(f"an interval is a length of time: {text!r}")
    return int(period.total_seconds() * 1000)
