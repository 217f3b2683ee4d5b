"""Display classes and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackloom import constants as C


def fixed(value: Column, digits: int) -> Column:
    """A number with fixed decimals, rounded by its exact binary value (ties to even)."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def rounded(value: Column | str, digits: int = 0) -> Column:
    """Round half to even by the exact binary value, as stored numbers are rounded."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value) if digits == 0 else fixed(value, digits).cast("double")


def speed_bucket(kmh: Column) -> Column:
    """Label of the speed bucket, ``unknown`` without a speed."""
    out = F.when(kmh.isNull(), F.lit("unknown"))
    for upper, label in zip(C.SPEED_BUCKET_UPPER_KMH, C.SPEED_BUCKET_LABELS):
        out = out.when(kmh < upper, F.lit(label))
    return out.otherwise(F.lit(C.SPEED_BUCKET_LABELS[-1]))


def _scale(value: Column, labels: tuple[str, str, str], high: float, middle: float) -> Column:
    return F.when(value >= high, F.lit(labels[0])).when(value >= middle, F.lit(labels[1])).otherwise(
        F.lit(labels[2])
    )


def coverage_badge(coverage: Column) -> Column:
    """Map view: share of samples with a position."""
    share = F.coalesce(coverage, F.lit(0.0))
    return _scale(share, ("good", "partial", "poor"), C.GOOD_COVERAGE, C.PARTIAL_COVERAGE)


def coverage_style(percent: Column) -> Column:
    """Status listing: color of the coverage in percent."""
    return _scale(
        percent, ("green", "yellow", "red"), C.STATUS_GOOD_PERCENT, C.STATUS_FAIR_PERCENT
    )


def _two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def status_duration(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds, ``-`` when unknown."""
    total = seconds.cast("long")
    return F.when(seconds.isNull(), F.lit("-")).otherwise(F.concat_ws(
        ":", F.floor(total / 3600).cast("string"),
        _two_digits(F.floor(total % 3600 / 60)), _two_digits(total % 60),
    ))


def duration(seconds: Column) -> Column:
    """Rounded ``H:MM:SS``, or ``M:SS`` below an hour, ``-`` when unknown."""
    total = F.floor(seconds + 0.5).cast("long")
    hours, minutes = F.floor(total / 3600), F.floor(total % 3600 / 60)
    rest = _two_digits(total % 60)
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(hours > 0, F.concat_ws(":", hours.cast("string"), _two_digits(minutes), rest))
        .otherwise(F.concat_ws(":", minutes.cast("string"), rest))
    )


def distance(km: Column) -> Column:
    """Kilometers with one decimal, none from 100 km."""
    whole = F.format_string("%d km", F.floor(km + 0.5).cast("long"))
    return F.when(km.isNull(), F.lit("-")).when(km >= 100, whole).otherwise(
        F.concat(fixed(km, 1), F.lit(" km"))
    )


def speed(kmh: Column) -> Column:
    return F.when(kmh.isNull(), F.lit("-")).otherwise(
        F.format_string("%d km/h", F.floor(kmh + 0.5).cast("long"))
    )


def coordinates(lat: Column, lon: Column) -> Column:
    return F.concat(fixed(lat, 5), F.lit(", "), fixed(lon, 5))


def clock_time(time: Column, timezone: Column, with_seconds: bool = False) -> Column:
    """Local time of day, ``?`` when unknown."""
    local = F.from_utc_timestamp(time, timezone)
    return F.coalesce(F.date_format(local, "HH:mm:ss" if with_seconds else "HH:mm"), F.lit("?"))


def date(day: Column) -> Column:
    """Such as ``Fri, Sep 25, 2026``."""
    return F.coalesce(F.date_format(day, "EEE, MMM d, yyyy"), F.lit("No date"))


def route(start: Column, end: Column, arrow: str = " -> ") -> Column:
    """Start and end locality, one name when equal, null when both are unknown."""
    return (
        F.when(start.isNull() & end.isNull(), F.lit(None))
        .when(start == end, start)
        .otherwise(F.concat(F.coalesce(start, F.lit("?")), F.lit(arrow), F.coalesce(end, F.lit("?"))))
    )


def log_route(start: Column, end: Column) -> Column:
    """Start and end locality for log lines, always both."""
    return F.concat(F.coalesce(start, F.lit("?")), F.lit(" -> "), F.coalesce(end, F.lit("?")))
