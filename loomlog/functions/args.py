"""Checks and defaults for scalar arguments (they run on the driver, never on data)."""

from __future__ import annotations

import re

_LEADING_INT = re.compile(r"\s*([+-]?\d+)")
_MAX_SAFE = 2**53 - 1


def whole_number(value: int | str | None, fallback: int) -> int:
    """Leading integer of ``value``; anything absent, negative or oversized gives ``fallback``."""
    if value is None or isinstance(value, bool):
        return fallback
    if isinstance(value, int):
        number = value
    else:
        found = _LEADING_INT.match(str(value))
        if not found:
            return fallback
        number = int(found.group(1))
    return number if 0 <= number <= _MAX_SAFE else fallback


def page_limit(value: int | str | None, default: int = 100, cap: int = 500) -> int:
    """Rows of one page: the default where absent or unusable, never above the cap."""
    return min(whole_number(value, default), cap)


def export_limit(value: int | str | None, default: int = 1000, cap: int = 10_000) -> int:
    """Rows of an export: 0 and unreadable values mean the default, negatives mean none."""
    if value is None:
        return default
    found = _LEADING_INT.match(str(value))
    number = int(found.group(1)) if found else 0
    return max(0, min(number or default, cap))
