"""Durations: parsing settings, rendering columns."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {"h": 3_600_000, "m": 60_000, "s": 1_000, "ms": 1}
_TERM = re.compile(r"(\d+(?:\.\d+)?)(ms|h|m|s)")


def parse_duration(text: str) -> int:
    """Milliseconds of a duration such as ``5m``, ``1h30m`` or ``250ms``."""
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    terms = _TERM.findall(body)
    if not terms or "".join(n + u for n, u in terms) != body:
        raise ValueError(f"not a duration: {text!r}")
    return sign * int(sum(Fraction(number) * _UNIT_MS[unit] for number, unit in terms))


def spark_interval(text: str) -> str:
    """The duration as an interval text for windows and watermarks."""
    return f"{parse_duration(text)} milliseconds"


def bucket_start(at: Column, every: str) -> Column:
    """Start of the ``every`` wide bucket, counted from the epoch, that holds a timestamp."""
    width = parse_duration(every) * 1000
    micros = F.unix_micros(at)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def as_time(now: datetime | Column) -> Column:
    """A fixed time (UTC unless it names a zone) or a time column, as a column."""
    if isinstance(now, Column):
        return now
    return F.lit(now if now.tzinfo else now.replace(tzinfo=timezone.utc))


def cutoff_ms(now: datetime | Column, duration: str) -> int | Column:
    """``now - duration`` in epoch ms, cut to the whole second."""
    if isinstance(now, Column):
        micros = F.unix_micros(now) - parse_duration(duration) * 1000
        return F.floor(micros / 1_000_000) * 1000
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    since_epoch = now - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (since_epoch.days * 86_400 + since_epoch.seconds) * 1_000_000
    micros += since_epoch.microseconds - parse_duration(duration) * 1000
    return micros // 1_000_000 * 1000


def pretty_duration(ms: Column) -> Column:
    """``1h 2m 3s`` for whole seconds of ``ms``; null stays null."""
    seconds = F.floor(ms / 1000)
    return F.when(
        ms.isNotNull(),
        F.format_string(
            "%dh %dm %ds",
            F.floor(seconds / 3600),
            F.floor(seconds % 3600 / 60),
            seconds % 60,
        ),
    )


def iso_text(ts: Column) -> Column:
    """UTC ISO text with milliseconds, as in ``2001-08-02T00:00:00.000Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSX")


# The largest epoch ms a date can hold in the source's own scripts.
_LAST_MS = 8_640_000_000_000_000


def positive_ms_to_timestamp(ms: Column) -> Column:
    """Epoch ms as a timestamp; null, zero, negative and impossible values give null."""
    return F.when((ms > 0) & (ms <= _LAST_MS), F.timestamp_millis(ms))
