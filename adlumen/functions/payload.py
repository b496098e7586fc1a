"""JSON payloads of log events, both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlumen.schemas import PAYLOAD

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ISO_PLAIN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def parsed(payload: str = "payload") -> Column:
    """The payload as a struct; fields that are absent or malformed are NULL."""
    return F.from_json(payload, PAYLOAD)


def money(field: Column) -> Column:
    """Money travels as text; missing or unreadable amounts count as zero."""
    return F.coalesce(field.try_cast("decimal(14,4)"), F.lit(0).cast("decimal(14,4)"))


def known_user(user: Column) -> Column:
    """The user, or NULL where it is missing, empty or 0."""
    return F.when((user != "") & (user != "0"), user)


def iso(moment: Column, plain: bool = False) -> Column:
    """Timestamp as ISO text in UTC."""
    return F.date_format(moment, ISO_PLAIN if plain else ISO)


def encoded(*fields: Column) -> Column:
    """Fields as JSON text, absent ones as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
