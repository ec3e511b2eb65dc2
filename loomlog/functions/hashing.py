"""Digests and keyed digests as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK_BYTES = 64


def body_hash(body: Column) -> Column:
    """SHA-256 of the body text, lower-case hex."""
    return F.sha2(body, 256)


def hmac_hex(secret: str, message: Column, algorithm: str = "sha256") -> Column:
    """HMAC of a BINARY column, lower-case hex.

    HMAC is ``H((k ^ opad) || H((k ^ ipad) || message))``; both padded keys are constants of
    the plan, so an executor only hashes.
    """
    if algorithm not in ("sha1", "sha256"):
        raise ValueError(f"unsupported digest: {algorithm}")
    key = secret.encode()
    if len(key) > _BLOCK_BYTES:
        key = hashlib.new(algorithm, key).digest()
    key = key.ljust(_BLOCK_BYTES, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))

    def digest(column: Column) -> Column:
        return F.sha1(column) if algorithm == "sha1" else F.sha2(column, 256)

    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, message)))))
