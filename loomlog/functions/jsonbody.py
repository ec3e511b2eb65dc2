"""Reading and rewriting JSON event bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from operator import eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names a producer may use for each lifted column, in order of preference.
SERVICE_KEYS = ("service", "app", "source", "name", "application", "svc", "component")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl", "logLevel")
TRACE_KEYS = (
    "trace_id",
    "traceId",
    "trace.id",
    "x-trace-id",
    "requestId",
    "request_id",
    "correlationId",
    "correlation_id",
)

# Fixed value: the accepted shape of a dotted field path.
FIELD_SHAPE = r"[a-zA-Z_][a-zA-Z0-9_.]*"

# The accepted comparison operators.
FIELD_OPS = ("=", "!=", ">", ">=", "<", "<=")


def parsed(body: Column) -> Column:
    """The body as VARIANT; NULL where it is not JSON.  Bind once per row and reuse."""
    return F.try_parse_json(body)


def variant_of(df: DataFrame) -> Column:
    """The body as VARIANT: the stored column ``fields`` where rows have it, else parsed from the text."""
    return F.col("fields") if "fields" in df.columns else parsed(F.col("body"))


def _leaf(variant: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(variant, path, as_type)


def lifted_members(text: Column) -> Column:
    """The members with a name of interest as a struct of VARIANTs, read in one pass."""
    schema = T.StructType(
        [T.StructField(key, T.VariantType()) for key in SERVICE_KEYS + LEVEL_KEYS + TRACE_KEYS]
    )
    return F.from_json(text, schema)


def first_text(members: Column, keys: tuple[str, ...]) -> Column:
    """First non-empty JSON string among ``keys``; other JSON types do not count."""
    values = [members.getField(key) for key in keys]

    def text_of(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    # Nearly always the first member that is there decides; tests of each were code too long to be compiled.
    first = F.coalesce(*values)
    texts = F.transform(F.array(*values), text_of)
    later = F.get(F.filter(texts, lambda text: text != ""), 0)
    return F.when(text_of(first) != "", text_of(first)).when(first.isNotNull(), later)


def opens_with(text: Column, sign: str) -> Column:
    """True where the JSON text starts with ``{``, ``[`` or ``"``, i.e. what kind of value it is."""
    return text.rlike(rf"\A[ \t\r\n]*\{sign}")


def is_object(text: Column) -> Column:
    """True for a valid JSON object (an empty one included)."""
    return F.coalesce(opens_with(text, "{") & parsed(text).isNotNull(), F.lit(False))


def minified(text: Column) -> Column:
    """The JSON text without insignificant white space, key order kept."""
    return F.get_json_object(text, "$")


def array_elements(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; a string keeps its quotes."""
    typed = F.from_json(text, "array<variant>")

    def element(plain: Column, at: Column) -> Column:
        variant = F.get(typed, at)
        return F.when(F.schema_of_variant(variant) == "STRING", F.to_json(variant)).otherwise(plain)

    return F.transform(F.from_json(text, "array<string>"), element)


def json_fields(**fields: Column) -> Column:
    """A JSON object of the given columns; NULL columns are left out."""
    return F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]))


def without_members(flat: Column, names: tuple[str, ...]) -> Column:
    """A minified object without the members called one of ``names``.

    Bodies that do not hold such a name (nearly all) stay as sent, nested order and numbers
    included; only the others go through a map.
    """
    holds_name = reduce(or_, [flat.contains(json.dumps(name)) for name in names])
    as_map = F.from_json(flat, "map<string,variant>")
    reduced = F.to_json(F.map_filter(as_map, lambda key, _value: ~key.isin(*names)))
    return F.when(holds_name, reduced).otherwise(flat)


def splice(flat: Column, members: Column) -> Column:
    """Append ``members`` (``"name":value,...`` without braces) to a minified object."""
    opened = F.when(flat == "{}", F.lit("{")).otherwise(
        F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(","))
    )
    return F.concat(opened, members, F.lit("}"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def put_fields(text: Column, fields: Column, names: tuple[str, ...]) -> Column:
    """Append the members of the JSON object ``fields``; they replace those called ``names``.

    NULL where ``text`` is not an object.
    """
    members = F.substring(fields, F.lit(2), F.length(fields) - 2)
    flat = F.when(minified(text).startswith("{"), minified(text))
    return _bound(_bound(flat, lambda f: without_members(f, names)), lambda f: splice(f, members))


def with_defaults(text: Column, defaults: Mapping[str, object]) -> Column:
    """Add ``defaults`` (plain values) to the JSON object; fields of the event win."""

    def add(flat: Column) -> Column:
        present = F.json_object_keys(flat)
        missing = [
            F.when(~F.array_contains(present, key), F.lit(_member(key, value)))
            for key, value in defaults.items()
        ]
        own = F.nullif(F.substring(flat, F.lit(2), F.length(flat) - 2), F.lit(""))
        merged = F.concat(F.lit("{"), F.concat_ws(",", *missing, own), F.lit("}"))
        return F.when(flat.startswith("{"), merged)

    return _bound(minified(text), add)


def _member(key: str, value: object) -> str:
    return f"{json.dumps(key)}:{json.dumps(value, separators=(',', ':'), ensure_ascii=False)}"


def nested_defaults(*scopes: Mapping[str, object]) -> dict[str, object]:
    """Defaults of nested scopes, outermost first; inner scopes win."""
    merged: dict[str, object] = {}
    for scope in scopes:
        merged.update(scope)
    return merged


def field_path(field: str) -> str:
    """JSON path of a dotted field name; a dot always descends."""
    if not re.fullmatch(FIELD_SHAPE, field, flags=re.ASCII):
        raise ValueError(f"invalid field name: {field!r}")
    steps = field.split(".")
    if "" in steps:
        raise ValueError(f"invalid field path: {field!r}")
    return "$." + ".".join(steps)


def compare_field(
    body: Column, variant: Column, field: str, op: str, value: str | int | float, types: str = "ranked"
) -> Column:
    """Compare one JSON field with a constant.

    ``types="ranked"`` orders across types: numbers and booleans (as 1 and 0) come before all
    text, and objects and arrays compare as their JSON text.  ``types="strict"`` compares
    numbers with numbers and strings with strings only.  JSON null and absent fields never match.
    """
    if op not in FIELD_OPS:
        raise ValueError(f"invalid operator: {op!r}")
    if types not in ("ranked", "strict"):
        raise ValueError(f"unknown type rule: {types!r}")
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise ValueError("the value must be a string or a number")
    path = field_path(field)
    kind = F.schema_of_variant(_leaf(variant, path))
    is_string = kind == "STRING"
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    number_kind = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")

    if isinstance(value, str):
        text = F.when(is_string, _leaf(variant, path, "string"))
        if types == "strict":
            return F.coalesce(_apply(op, text, F.lit(value)), F.lit(False))
        number_below = number_kind | (kind == "BOOLEAN")
        decided = F.when(number_below, F.lit(op in ("!=", "<", "<=")))
        if value[:1] in ("{", "["):
            text = F.coalesce(text, F.when(nested, F.get_json_object(body, path)))
        else:
            # The first character decides, so the body's text is not needed.
            for name, sign in (("OBJECT", "{"), ("ARRAY", "[")):
                decided = decided.when(kind.startswith(name), F.lit(_apply(op, sign, value[:1])))
        return F.coalesce(decided.otherwise(_apply(op, text, F.lit(value))), F.lit(False))

    if isinstance(value, int) and abs(value) < 2**63:
        # Whole numbers compare exactly; a detour over DOUBLE would blur large ids.
        number = F.when(
            kind == "BIGINT", _apply(op, _leaf(variant, path, "bigint"), F.lit(value).cast("bigint"))
        )
    else:
        number = F.lit(None).cast("boolean")
    by_double = _apply(op, _leaf(variant, path, "double"), F.lit(float(value)))
    if types == "strict":
        return F.coalesce(number, F.when(number_kind, by_double), F.lit(False))
    text_above = is_string | nested
    return F.coalesce(
        number,
        F.when(number_kind | (kind == "BOOLEAN"), by_double),
        F.when(text_above, F.lit(op in ("!=", ">", ">="))),
        F.lit(False),
    )


_COMPARE = {"=": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}


def _apply(op: str, left, right):
    return _COMPARE[op](left, right)
