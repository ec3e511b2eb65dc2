"""Points in time.

Bounds are compared as instants, not as text: a date alone is midnight UTC, an offset is
honoured, and ``...00Z`` equals ``...00.000Z``.
"""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted shape of a date or date-time (shape only, not the calendar).
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"

# Fixed value: the text form of a stored receive time.
ISO_MILLIS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

When = str | date | datetime


def is_iso(value: Column | str) -> Column:
    """True where the text has the accepted shape.  ``\\z`` keeps a trailing newline out."""
    column = F.col(value) if isinstance(value, str) else value
    return column.rlike(ISO_SHAPE[:-1] + r"\z")


def check_iso(value: str) -> str:
    """Return ``value`` or raise if it does not have the accepted shape."""
    if not re.fullmatch(ISO_SHAPE.strip("^$"), value, flags=re.ASCII):
        raise ValueError(f"not an ISO-8601 date or date-time: {value!r}")
    return value


def to_instant(value: When) -> datetime:
    """An aware UTC datetime; values without an offset are taken as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(check_iso(value))
    elif not isinstance(value, datetime):
        value = datetime.combine(value, time())
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def instant(value: When) -> Column:
    """``value`` as a TIMESTAMP literal."""
    return F.lit(to_instant(value))


def back(value: When, **ago: float) -> datetime:
    """``value`` moved back by a duration given as ``timedelta`` keywords."""
    return to_instant(value) - timedelta(**ago)


def iso_millis(column: Column) -> Column:
    """Text form of a timestamp with milliseconds and ``Z``."""
    return F.date_format(column, ISO_MILLIS_FORMAT)


def event_time(parsed: Column) -> Column:
    """Producer's own time from ``ts``, ``time`` or ``timestamp``: ISO text or Unix millis."""
    options = []
    for key in ("ts", "time", "timestamp"):
        leaf = F.try_variant_get(parsed, f"$.{key}", "variant")
        kind = F.schema_of_variant(leaf)
        text = F.try_variant_get(parsed, f"$.{key}", "string")
        options.append(
            F.when((kind == "STRING") & is_iso(text), F.try_to_timestamp(text)).when(
                (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
                F.timestamp_millis(F.try_variant_get(parsed, f"$.{key}", "bigint")),
            )
        )
    return F.coalesce(*options)
