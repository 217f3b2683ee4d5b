"""Search, date filters and summaries over the trip index."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom import constants as C
from trackloom.session import durable


def has_gps(status: str = "extraction_status") -> Column:
    return F.col(status) == C.EXTRACTION_OK


def query_terms(query: str) -> list[str]:
    """The comma-separated terms of a search text, lowercase and without blanks."""
    return [term for part in query.split(",") if (term := part.strip().lower())]


def matches_query(query: str) -> Column:
    """Whether every term is part of the name, a street, or the start or end locality."""
    texts = F.concat(
        F.array("name"), F.coalesce("streets", F.array().cast("array<string>")),
        F.array("start_locality", "end_locality"),
    )
    lowered = F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.lower(t))
    def has(term: str) -> Column:
        return F.exists(lowered, lambda t: F.contains(t, F.lit(term)))

    out = F.lit(True)
    for term in query_terms(query):
        out = out & has(term)
    return out


def search_trips(index: DataFrame, start: str = "", end: str = "", query: str = "") -> DataFrame:
    """Trips within a date range whose texts contain all terms. A bound drops undated trips."""
    found = index.where(matches_query(query))
    if start:
        found = found.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        found = found.where(F.col("date") <= F.lit(end).cast("date"))
    return found


def preset_start(preset: str, today: Column) -> Column:
    """First day of a preset: a week, a month or a year back (clamped to the month's end)."""
    if preset == "week":
        return F.date_sub(today, 7)
    return F.add_months(today, -12 if preset == "year" else -1)


def normalize_date_filter(start: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Open the bounds (null or empty) at or beyond the data, and swap bounds in the wrong order."""
    start = F.when(start > first, start).otherwise(F.lit(""))
    end = F.when(end < last, end).otherwise(F.lit(""))
    swapped = (start != "") & (end != "") & (start > end)
    return F.when(swapped, end).otherwise(start), F.when(swapped, start).otherwise(end)


def date_bounds(index: DataFrame) -> DataFrame:
    """Number of trips, first and last date, the years between, and the days with trips."""
    return index.agg(
        F.count(F.lit(1)).alias("trips"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("date").alias("trip_days"),
    ).withColumn("years", F.when(
        F.year("first_date") == F.year("last_date"), F.year("first_date").cast("string")
    ).otherwise(F.concat_ws("-", F.year("first_date"), F.year("last_date"))))


def trip_days(index: DataFrame) -> DataFrame:
    return index.where("date is not null").select("date").distinct()


def street_names(index: DataFrame) -> DataFrame:
    """All street names for lookup, each once, sorted."""
    return index.select(F.explode("streets").alias("name")).distinct().orderBy("name")


def _fleet_aggregates() -> list[Column]:
    hours = F.when(F.col("avg_kmh") > 0, F.coalesce("distance_km", F.lit(0.0)) / F.col("avg_kmh"))
    return [
        F.count(F.lit(1)).alias("trips"),
        F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("distance_km"),
        F.coalesce(F.sum("duration_s"), F.lit(0)).alias("duration_s"),
        F.try_divide(F.sum("distance_km"), F.sum(hours)).alias("avg_kmh"),
        F.max("max_kmh").alias("max_kmh"),
    ]


def fleet_stats(index: DataFrame, *by: str) -> DataFrame:
    """Totals over trips, optionally rolled up over grouping columns."""
    grouped = index.rollup(*by) if by else index.groupBy()
    return grouped.agg(*_fleet_aggregates())


def trip_bounds(index: DataFrame) -> DataFrame:
    """The box around a set of trips."""
    return index.where("bbox is not null").agg(
        F.min("bbox.min_lat").alias("min_lat"), F.min("bbox.min_lon").alias("min_lon"),
        F.max("bbox.max_lat").alias("max_lat"), F.max("bbox.max_lon").alias("max_lon"),
    )


def list_key() -> Column:
    """Sort key of the trip list: the start time, else the date, else nothing."""
    return F.coalesce(
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("date", "yyyy-MM-dd"),
        F.lit(""),
    )


def _by_ranges(listed: DataFrame):
    """Rows ``(id, _key, ...)`` dealt to ranges of the one global order, newest first, and the order in a range."""
    # stored, so that rows keep their range
    ranged = durable(
        listed.repartitionByRange(F.col("_key").desc(), F.col("id")).withColumn("_range", F.spark_partition_id())
    )
    return ranged, Window.partitionBy("_range").orderBy(F.col("_key").desc(), "id")


def ranked_newest_first(index: DataFrame) -> DataFrame:
    """The trips with their ``place`` in the list, newest first, then by id.

    Each range counts its own trips; one row per range tells how many lie before it.
    """
    ranged, within = _by_ranges(index.withColumn("_key", list_key()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn("place", F.row_number().over(within).cast("long")).join(offsets, "_range")
    return placed.withColumn("place", F.col("place") + F.col("_offset")).drop("_range", "_key", "_offset")


def neighbor_trips(index: DataFrame, start: str = "", end: str = "", query: str = "") -> DataFrame:
    """The previous and next listed trip with GPS of each trip.

    The list is one global order. Spark cuts it into ranges of (key, id), so trips of one hour, or
    without any time, are cut like all others; each range is windowed by itself, and the first and
    last trip of a range, one row per range, tell the ranges beside it.
    """
    listed = search_trips(index, start, end, query).where(has_gps()).select("id", list_key().alias("_key"))
    ranged, within = _by_ranges(listed)
    place = F.struct((-F.row_number().over(within)).alias("n"), "id")
    edges = ranged.select("_range", place.alias("_place")).groupBy("_range").agg(
        F.max("_place")["id"].alias("_first"), F.min("_place")["id"].alias("_last")
    )
    over_ranges = Window.orderBy("_range")
    beside = edges.select(
        "_range", F.lag("_last").over(over_ranges).alias("_before"), F.lead("_first").over(over_ranges).alias("_after")
    )
    return ranged.withColumns({
        "_prev": F.lag("id").over(within), "_next": F.lead("id").over(within)
    }).join(beside, "_range").select(
        "id", F.coalesce("_prev", "_before").alias("previous_id"),
        F.coalesce("_next", "_after").alias("next_id"),
    )


def drawn_trips(visible: DataFrame, selected: DataFrame, focused: str | None = None) -> DataFrame:
    """Selected trips that are visible, and the focused trip in any case."""
    drawn = selected.select("id").join(visible.select("id"), "id", "left_semi")
    if focused is None:
        return drawn.distinct()
    extra = drawn.sparkSession.range(1).select(F.lit(focused).alias("id"))
    return drawn.unionByName(extra).distinct()
