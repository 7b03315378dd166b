"""Stable keys and dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(section: Column, key: Column) -> Column:
    return F.concat(section, F.lit(" :: "), key)


def change_id(source_id: Column, row_identity: Column) -> Column:
    """Join key of a change, the same in every cycle."""
    return F.substring(F.sha1(F.concat_ws("|", source_id, row_identity).cast("binary")), 1, 12)


def cycle(date: Column, first_month: int = 7) -> Column:
    """Year in which a hiring cycle ends: next year's from ``first_month`` on."""
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def change_key(source_id: Column, key: Column, date: Column) -> Column:
    """Mute key: falls out of use when the cycle turns."""
    return F.substring(F.sha1(F.concat_ws("|", source_id, key, cycle(date).cast("string")).cast("binary")), 1, 10)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def days_until(text: Column, as_of: Column) -> Column:
    """Days to an ISO date; null for anything that is no date, negative when it has passed."""
    iso = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text))
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), as_of)
