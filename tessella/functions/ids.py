"""Cell ids: hexadecimal, unsigned or decimal text to a signed long, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_id(text: Column) -> Column:
    """Decimal text (20 digits at most, folded by two's complement) or hexadecimal text as a signed long; else null.

    Fifteen hexadecimal digits of which the first is 8 are a cell id, even if all of them are decimal.
    """
    t = F.lower(F.trim(text.cast("string")))
    fold = F.lit("18446744073709551616").cast("decimal(20,0)")
    decimal = t.cast("decimal(20,0)")
    folded = F.when(decimal > F.lit(2**63 - 1), decimal - fold).otherwise(decimal)
    bare = F.regexp_replace(t, "^0x", "")
    unsigned = F.conv(bare, 16, 10).cast("decimal(20,0)")
    from_hex = F.when(unsigned > F.lit(2**63 - 1), unsigned - fold).otherwise(unsigned)
    return F.when(t.rlike("^8[0-9a-f]{14}$"), from_hex.cast("long")).when(t.rlike("^-?[0-9]{1,19}$") | t.rlike("^[0-9]{20}$"), folded.cast("long")).when(t.rlike("^(0x)?[0-9a-f]{1,16}$"), from_hex.cast("long"))


def hex_text(cell: Column) -> Column:
    """The id's 64 bits in lower-case hexadecimal, without leading zeros."""
    return F.lower(F.hex(cell))


def is_hex_cell(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^8[0-9a-f]{14}$"), F.lit(False))


def synthetic_key(date: Column, actor: Column, place: Column, *rest: Column) -> Column:
    """date_actor_place with names cut to 20 characters, and a digest of what tells repeated ones apart."""
    return F.concat_ws("_", F.date_format(date, "yyyyMMdd"), F.substring(actor, 1, 20), F.substring(place, 1, 20), F.hex(F.xxhash64(date, actor, place, *rest)))
