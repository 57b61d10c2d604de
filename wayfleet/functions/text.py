"""Text expressions: announcement links and payload signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on this pattern and these block constants.
LINK_PATTERN = r"\[([^\]]+)\]\(([^)]+)\)"
HMAC_BLOCK = 64
HMAC_OUTER = 0x5C
HMAC_INNER = 0x36


def links(message: Column) -> Column:
    """Every ``[text](url)`` of a message, in order; ``is_link`` is false unless the URL is https."""
    texts = F.regexp_extract_all(message, F.lit(LINK_PATTERN), 1)
    urls = F.regexp_extract_all(message, F.lit(LINK_PATTERN), 2)
    return F.transform(
        F.arrays_zip(texts.alias("text"), urls.alias("url")),
        lambda p: F.struct(p["text"].alias("text"), p["url"].alias("url"),
                           p["url"].startswith("https://").alias("is_link")))


def plain_message(message: Column) -> Column:
    """The message as shown: links become their text, refused ones ``text (url)``."""
    safe = F.regexp_replace(message, r"\[([^\]]+)\]\((https://[^)]*)\)", "$1")
    return F.regexp_replace(safe, LINK_PATTERN, "$1 ($2)")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a string or binary column under a fixed key."""
    if len(key) > HMAC_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(k ^ byte for k in key).hex()))
    inner = F.sha2(F.concat(pad(HMAC_INNER), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(HMAC_OUTER), F.unhex(inner)), 256)


def signature_ok(key: bytes, ts: Column, body: Column, signature: Column) -> Column:
    expected = F.concat(F.lit("v1="), hmac_sha256(key, F.concat(F.lit("v1:"), ts, F.lit(":"), body)))
    return F.coalesce(signature == expected, F.lit(False))
