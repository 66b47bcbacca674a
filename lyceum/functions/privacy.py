"""Keyed pseudonyms and addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def email(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from two SHA-256; only the padded keys' literals enter the plan."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def pseudonym(secret: bytes, day: Column, who: Column) -> Column:
    """A sender's name for one day: sixteen hex digits that don't link across days."""
    return F.substring(hmac_sha256(secret, F.concat_ws(":", day.cast("string"), who)), 1, 16)


def token(secret: bytes, email_: Column, expires: Column) -> Column:
    """A signed token: address, end of validity (seconds) and their HMAC, parted by bars."""
    body = F.concat_ws("|", email_, expires.cast("string"))
    return F.concat_ws("|", body, hmac_sha256(secret, body))


def token_owner(secret: bytes, token_: Column, now: Column) -> Column:
    """The address of a token whose signature holds and that is valid at ``now`` (seconds); else null."""
    body, signature = F.regexp_extract(token_, r"^(.*)\|([0-9a-f]{64})$", 1), F.regexp_extract(token_, r"^(.*)\|([0-9a-f]{64})$", 2)
    until = F.regexp_extract(body, r"\|(\d+)$", 1).try_cast("long")
    return F.when((signature == hmac_sha256(secret, body)) & (now < until), F.regexp_extract(body, r"^(.*)\|\d+$", 1))
