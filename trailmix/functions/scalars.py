"""Scalar expressions: dates, buckets, clipping and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: slots reserved for a bucketed side feature.
BUCKET_SLOTS = 12
# The range of a rating prediction.
RATING_RANGE = (0.0, 5.0)


def parse_date(text: Column) -> Column:
    """A date or timestamp text as a timestamp without time zone; unreadable text is null."""
    return text.try_cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def count_bucket(n: Column, slots: int = BUCKET_SLOTS) -> Column:
    """Bit length of a count, capped: 0, 1, 2-3, 4-7, ... -> 0, 1, 2, 3, ..."""
    bits = F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n.cast("bigint"))))
    return F.least(bits, F.lit(slots - 1)).cast("int")


def star_bucket(mean: Column, fallback: Column, slots: int = BUCKET_SLOTS) -> Column:
    """Half-star bucket of a mean rating (half-even rounding), clipped to 1..slots-1."""
    half_stars = F.rint(F.coalesce(mean, fallback) * 2) - 1
    return F.greatest(F.lit(1.0), F.least(F.lit(float(slots - 1)), half_stars)).cast("int")


def clip(value: Column, low: float = RATING_RANGE[0], high: float = RATING_RANGE[1]) -> Column:
    """Limit a value to a closed range."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def key_digest(*keys: Column | int | str) -> Column:
    """Hex digest of the given row keys: the same on every retry and in every engine."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def draw(*keys: Column | int | str) -> Column:
    """Uniform integer in [0, 2^32) made from row keys, so retried tasks draw the same."""
    return F.conv(F.substring(key_digest(*keys), 1, 8), 16, 10).cast("bigint")


def coarse(value: Column, data_type: T.DataType, width: int = 4096) -> Column:
    """A bucket that is monotone in ``value``: splits a long group without losing its order."""
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.to_date(value)
    if isinstance(data_type, T.NumericType):
        return F.floor(value / F.lit(width))
    raise TypeError(f"no coarse bucket for {data_type}")
