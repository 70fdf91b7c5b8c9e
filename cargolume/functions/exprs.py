"""Column helpers shared by the models. All stay in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Timestamp floored to a multiple of `seconds` since the epoch.

    Works on the instant itself, so the bucket is UTC in every session time zone.
    """
    epoch = F.unix_seconds(col(ts))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def utc_hour(ts: Column | str) -> Column:
    return floor_to(ts, 3600)


def utc_minute(ts: Column | str) -> Column:
    return floor_to(ts, 60)


def utc_date(ts: Column | str) -> Column:
    epoch = F.unix_seconds(col(ts))
    return F.date_from_unix_date(
        ((epoch - F.pmod(epoch, F.lit(86400))) / F.lit(86400)).cast("int")
    )


def utc_hour_of_day(ts: Column | str) -> Column:
    epoch = F.unix_seconds(col(ts))
    since_midnight = F.pmod(epoch, F.lit(86400))
    return ((since_midnight - F.pmod(since_midnight, F.lit(3600))) / F.lit(3600)).cast("int")


def utc_text(ts: Column | str) -> Column:
    """ISO-8601 text with a +00:00 offset for a whole-second instant, in any session zone."""
    naive = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), col(ts).cast("timestamp_ntz")
    )
    return F.concat(F.date_format(naive, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1_000_000.0)


def key_of(c: Column | str) -> Column:
    """Surrogate key of a natural key."""
    return F.md5(col(c))


def packed_id(c: Column | str) -> Column:
    """An id as bytes: 17 for a UUID in lower case, a byte more than its text for any other; no two alike.

    Hex digits do not compress, so a UUID's text costs a shuffle twice its value.
    """
    text = col(c)
    uuid = text.rlike("\\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z")
    value = F.unhex(F.replace(text, F.lit("-"), F.lit("")))
    return F.when(uuid, F.concat(F.lit(b"\x00"), value)).otherwise(F.concat(F.lit(b"\x01"), text.cast("binary")))


def unpacked_id(c: Column | str) -> Column:
    """The text of an id that `packed_id` made."""
    packed = col(c)
    digits = F.lower(F.hex(packed))
    parts = [F.substring(digits, at, n) for at, n in ((3, 8), (11, 4), (15, 4), (19, 4), (23, 12))]
    other = F.decode(F.substring(packed, F.lit(2), F.octet_length(packed)), "UTF-8")
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x00"), F.concat_ws("-", *parts)).when(packed.isNotNull(), other)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)))


def money(c: Column) -> Column:
    return c.cast("decimal(24,2)")


def rate(numerator: Column, denominator: Column) -> Column:
    """Six-decimal rate; NULL when nothing was counted."""
    top = numerator.cast("decimal(18,0)")
    bottom = F.nullif(denominator.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return (top / bottom).cast("decimal(12,6)")


def computed_once(c: Column) -> Column:
    """The same value, marked so that the optimizer neither duplicates nor relocates it.

    A filter on a costly derived column is otherwise pushed below the projection and its
    whole expression tree is evaluated again, once per reference. A projection holding a
    non-deterministic expression stays where it is.
    """
    return F.when(F.spark_partition_id() >= 0, c)
