"""Event payloads from the records of common loggers.

Each function takes columns of a logger's record and returns the JSON payload to ingest.
Columns that are NULL are left out of the payload.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions.jsonbody import json_fields, put_fields

# Console methods and the levels they stand for.
CONSOLE_LEVELS = {"log": "info", "warn": "warn", "error": "error", "debug": "debug"}

# Length kept of an exception text, and the mark set after the cut.
EXCEPTION_CHARS = 8192
EXCEPTION_CUT_MARK = "\n[truncated]"

# Service name of HTTP access records, types of browser errors.
ACCESS_SERVICE = "next"
UNCAUGHT_ERROR = "uncaught_error"
UNHANDLED_REJECTION = "unhandled_rejection"


def mapped(column: Column, table: Mapping[str, str]) -> Column:
    """Value looked up in a small constant table; unknown keys give NULL."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def console_record(method: Column, args: Column) -> Column:
    """``args`` is an array of VARIANT: a leading string is the message, the rest stay ``args``."""
    first = F.get(args, 0)
    leads_with_text = F.coalesce(F.schema_of_variant(first) == "STRING", F.lit(False))
    rest = F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0)))
    return json_fields(
        level=mapped(method, CONSOLE_LEVELS),
        message=F.when(leads_with_text, first.cast("string")),
        args=F.when(~leads_with_text, args).when(F.size(rest) > 0, rest),
    )


def leveled_record(level: Column, message: Column, meta: Column | None = None) -> Column:
    """A record of (level, message, meta object); level and message win over meta."""
    own = json_fields(level=level, message=message)
    if meta is None:
        return own
    return F.coalesce(put_fields(meta, own, ("level", "message")), own)


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment; an absent path is ``/``."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path == "", "/").otherwise(path)


def access_record(
    method: Column,
    url: Column,
    started_at: Column,
    ended_at: Column,
    status: Column,
    error: Column,
    service: str = ACCESS_SERVICE,
) -> Column:
    """An HTTP access record: query strings are dropped, a failure has an error and no status."""
    failed = error.isNotNull()
    return json_fields(
        level=F.when(failed, "error").otherwise("info"),
        service=F.lit(service),
        method=method,
        path=url_path(url),
        status=F.when(~failed, status),
        error=error,
        duration_ms=F.unix_millis(ended_at) - F.unix_millis(started_at),
    )


def browser_error(
    message: Column, file: Column, line: Column, stack: Column, rejection: Column
) -> Column:
    """A browser error; its source is shown only where both file and line are known."""
    known = (file != "") & (line != 0) & ~rejection
    return json_fields(
        level=F.lit("error"),
        type=F.when(rejection, UNHANDLED_REJECTION).otherwise(UNCAUGHT_ERROR),
        message=message,
        _source=F.when(known, F.concat_ws(":", file, line.cast("string"))),
        stack=stack,
    )


def exception_text(text: Column) -> Column:
    """Exception text as the logging handler ships it: cut after a fixed length, with a mark."""
    cut = F.concat(F.substring(text, 1, EXCEPTION_CHARS), F.lit(EXCEPTION_CUT_MARK))
    return F.when(F.length(text) > EXCEPTION_CHARS, cut).otherwise(text)


def python_record(
    level_name: Column,
    message: Column,
    logger: Column,
    module: Column,
    function: Column,
    line: Column,
    exc_text: Column,
) -> Column:
    """A record of Python's ``logging``."""
    return json_fields(
        level=F.lower(level_name),
        message=message,
        logger=logger,
        module=module,
        funcName=function,
        lineno=line,
        exc_text=exception_text(exc_text),
    )


def channel_record(
    level_name: Column,
    message: Column,
    channel: Column,
    at: Column,
    context: Column,
    extra: Column,
) -> Column:
    """A record with channel, context and extra (maps); empty maps are dropped."""
    return json_fields(
        level=F.lower(level_name),
        message=message,
        channel=channel,
        datetime=F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"),
        context=F.when(F.size(context) > 0, context),
        extra=F.when(F.size(extra) > 0, extra),
    )
