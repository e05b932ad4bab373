"""Keyed pseudonyms and derived tickets."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.schemas import PSEUDONYM_LENGTH

KEY_BYTES = 32
HASH_BLOCK_BYTES = 64


def decode_key(hex_key: str) -> bytes:
    key = bytes.fromhex(hex_key)
    if len(key) != KEY_BYTES:
        raise ValueError(f"a pseudonym key is {KEY_BYTES} bytes in hex, got {len(key)} bytes")
    return key


def pseudonymize(user_name: Column, hex_key: str) -> Column:
    """The first eight bytes, in hex, of HMAC-SHA256 over the UTF-8 name.

    The keyed hash is two nested SHA-256 calls over the padded key, all built
    in. The padded key is a literal of the plan: set
    ``spark.redaction.string.regex`` where plans or event logs are kept.
    """
    key = decode_key(hex_key).ljust(HASH_BLOCK_BYTES, b"\0")
    inner_pad = F.lit(bytearray(byte ^ 0x36 for byte in key))
    outer_pad = F.lit(bytearray(byte ^ 0x5C for byte in key))
    inner = F.sha2(F.concat(inner_pad, F.encode(user_name, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(outer_pad, F.unhex(inner)), 256), 1, PSEUDONYM_LENGTH)


def _ticket_source(pseudonym: Column, time_text: Column, query_text: Column) -> Column:
    return F.concat_ws("|", pseudonym, time_text, query_text)


@F.pandas_udf(T.LongType())
def _blake2b_ticket(source: pd.Series) -> pd.Series:
    def ticket(text: str | None) -> int | None:
        if text is None:
            return None
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")

    return source.map(ticket, na_action="ignore").astype("Int64")


def derived_ticket(pseudonym: Column, time_text: Column, query_text: Column) -> Column:
    """A stable 32-bit stand-in for the ticket an archive line does not record.

    Spark has no BLAKE2b, so this is the one Arrow UDF of the package; it keeps
    tickets equal to those of archives imported elsewhere.
    """
    return _blake2b_ticket(_ticket_source(pseudonym, time_text, query_text))


def derived_ticket_sha256(pseudonym: Column, time_text: Column, query_text: Column) -> Column:
    """The same idea from built-in SHA-256, for stores that only ever use this."""
    digest = F.sha2(_ticket_source(pseudonym, time_text, query_text), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
