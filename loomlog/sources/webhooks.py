"""Landed webhook deliveries: signature check, then conversion to events.

A delivery is (provider, headers, raw bytes, received_at).  Header names are lower case.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.hashing import hmac_hex
from loomlog.functions.jsonbody import array_elements, json_fields, opens_with, parsed, put_fields
from loomlog.functions.text import wide_trim

# Providers, their signature headers, and the replay window in seconds.
SIGNATURE_HEADERS = {
    "vercel": "x-vercel-signature",
    "github": "x-hub-signature-256",
    "render": "render-signature",
}
REPLAY_SECONDS = 300
_MAX_SAFE = 2**53 - 1


def signature_valid(secrets: Mapping[str, str | None]) -> Column:
    """True for deliveries whose signature matches.

    ``secrets`` maps a provider to its secret.  A known provider without a secret is accepted
    unchecked, an unknown provider is refused.  The padded secrets become plan literals, so
    plans of this query deserve the same care as the secrets.
    """
    provider, raw = F.col("provider"), F.col("raw")

    def header(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(""))

    checks = []
    for name, header_name in SIGNATURE_HEADERS.items():
        secret = secrets.get(name)
        given = header(header_name)
        if not secret:
            check = F.lit(True)
        elif name == "vercel":
            check = given == hmac_hex(secret, raw, "sha1")
        elif name == "github":
            check = given == F.concat(F.lit("sha256="), hmac_hex(secret, raw))
        else:
            stamp = F.regexp_extract(given, r"t=(\d+)", 1)
            signature = F.regexp_extract(given, r"v1=([0-9a-f]+)", 1)
            seconds = stamp.try_cast("bigint")
            age = F.abs(F.unix_seconds("received_at") - seconds)
            fresh = F.coalesce((seconds <= _MAX_SAFE) & (age <= REPLAY_SECONDS), F.lit(False))
            check = fresh & (signature == hmac_hex(secret, raw))
        checks.append((provider == name) & check)
    return F.coalesce(reduce(or_, checks), F.lit(False))


def verify_webhooks(deliveries: DataFrame, secrets: Mapping[str, str | None]) -> DataFrame:
    """Only the deliveries whose signature matches."""
    return deliveries.filter(signature_valid(secrets))


def delivery_events(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the deliveries, and the deliveries set aside with their reason.

    Arrays give one event per element.  Objects get ``_provider``; other values, and an empty
    delivery as null, are wrapped as ``payload`` next to ``_provider``.
    """
    text = F.decode(F.col("raw"), "UTF-8")
    kept = [name for name in deliveries.columns if name not in ("raw", "headers")]
    looked_at = deliveries.select(
        *kept,
        F.when(F.octet_length("raw") == 0, "null").otherwise(text).alias("_text"),
    ).select(
        "*",
        parsed(F.col("_text")).isNotNull().alias("_valid"),
        opens_with(F.col("_text"), "[").alias("_is_array"),
    )
    known = F.col("provider").isin(*SIGNATURE_HEADERS)
    is_array = F.col("_is_array")
    elements = array_elements(F.col("_text"))
    own = json_fields(_provider=F.col("provider"))
    wrapped = F.concat(
        F.lit('{"payload":'), wide_trim(F.col("_text")), F.lit(","), F.substring(own, F.lit(2), F.length(own))
    )
    single = F.when(
        opens_with(F.col("_text"), "{"), put_fields(F.col("_text"), own, ("_provider",))
    ).otherwise(wrapped)
    reason = (
        F.when(~known, "unknown provider")
        .when(~F.col("_valid"), "invalid json")
        .when(is_array & (F.size(elements) == 0), "empty body")
    )
    staged = looked_at.select(
        *kept,
        F.col("_text"),
        reason.alias("reason"),
        F.when(is_array, elements).otherwise(F.array(single)).alias("_items"),
    )
    events = staged.filter(F.col("reason").isNull()).select(
        *kept, F.explode("_items").alias("payload")
    )
    refused = staged.filter(F.col("reason").isNotNull()).select(
        F.lit(None).cast("bigint").alias("index"),
        F.octet_length("_text").cast("bigint").alias("bytes"),
        F.col("_text").alias("payload"),
        "reason",
    )
    return events, refused
