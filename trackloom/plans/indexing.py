"""The trip index, its geometry, and the library status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom import constants as C
from trackloom.functions import report, text
from trackloom.operators import geometry, library, stats


def street_lists(streets: DataFrame) -> DataFrame:
    """Distinct street names of each trip in travel order."""
    first = streets.where("name is not null and name <> ''").groupBy("trip_id", "name").agg(
        F.min("pos").alias("pos")
    )
    return first.groupBy("trip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("streets")
    )


def build_index(
    tracks: DataFrame, samples: DataFrame, streets: DataFrame | None = None,
    trips: DataFrame | None = None, previews: DataFrame | None = None, hot=None,
) -> DataFrame:
    """One entry per track, with statistics for extracted ones.

    ``tracks``: ``trip_id, video_filename, extraction_status``; misnamed tracks (whose id is not
    the stem they declare) are left out when ``trip_id`` is a file name stem.
    """
    entries = tracks.select(
        "trip_id", text.stem(F.col("video_filename")).alias("id"), "video_filename",
        text.trip_date(F.col("video_filename")).alias("date"),
        text.trip_name(F.col("video_filename")).alias("name"), "extraction_status",
    )
    if dict(tracks.dtypes)["trip_id"] == "string":
        entries = entries.where(F.col("trip_id") == F.col("id"))
    names = "array<string>"
    if streets is None:
        entries = entries.withColumn("streets", F.array().cast(names))
    else:
        entries = entries.join(street_lists(streets), "trip_id", "left").withColumn(
            "streets", F.coalesce("streets", F.array().cast(names))
        )
    if trips is None:
        entries = entries.withColumns({
            f"{side}_locality": F.lit(None).cast("string") for side in ("start", "end")
        })
    else:
        sides = trips.select("trip_id", *[
            F.col("localities")[side]["name"].alias(f"{side}_locality") for side in ("start", "end")
        ])
        entries = entries.join(sides, "trip_id", "left")
    has_preview = F.lit(False)
    if previews is not None:
        found = previews.select(text.stem(F.col("name")).alias("id"), F.lit(True).alias("_p")).distinct()
        entries = entries.join(found, "id", "left")
        has_preview = F.col("_p").isNotNull()
    entries = entries.withColumn("has_preview", has_preview).drop("_p")
    extracted = tracks.where(F.col("extraction_status") == C.EXTRACTION_OK).select("trip_id")
    numbers = stats.trip_stats(samples.join(extracted, "trip_id", "left_semi"), hot=hot)
    return entries.join(numbers, "trip_id", "left")


def build_geometry(index: DataFrame, samples: DataFrame, hot=None) -> DataFrame:
    """Simplified routes of the trips with a position."""
    located = index.where("bbox is not null").select("trip_id")
    return geometry.simplify_routes(samples.join(located, "trip_id", "left_semi"), hot=hot)


def update_index(index: DataFrame, old_id: str, entry: DataFrame) -> DataFrame:
    """Replace the entry of one renamed trip; the order is that of a full rebuild."""
    kept = index.where(F.col("id") != old_id)
    return kept.unionByName(entry.select(*index.columns)).orderBy(F.concat("id", F.lit(".json")))


def library_status(
    videos: DataFrame, tracks: DataFrame, unreadable: DataFrame, numbers: DataFrame
) -> DataFrame:
    """The status listing: trips with statistics, and videos or tracks that need attention.

    ``tracks``: ``trip_id, stem, video_filename, extraction_status``; ``numbers``: trip statistics.
    """
    named = library.with_stems(videos)
    no_overlay = F.col("extraction_status") == C.EXTRACTION_NO_OVERLAY
    percent = F.col("coverage") * 100
    def texts(**values):
        return [F.coalesce(values.get(n, F.lit(None)), F.lit(None)).cast("string").alias(n)
                for n in ("duration", "distance", "coverage_percent", "coverage_color")]

    trips = tracks.where(~no_overlay).join(numbers, "trip_id", "left").select(
        F.lit("trip").alias("section"), F.col("stem").alias("name"),
        *texts(
            duration=report.status_duration(F.coalesce("duration_s", F.lit(0))),
            distance=F.concat(report.fixed(F.coalesce("distance_km", F.lit(0.0)), 1), F.lit(" km")),
            coverage_percent=F.rint(F.coalesce(percent, F.lit(0.0))).cast("int"),
            coverage_color=report.coverage_style(F.coalesce(percent, F.lit(0.0))),
        ),
    )
    def listed(df, section, name):
        return df.select(F.lit(section).alias("section"), F.col(name).alias("name"), *texts())

    not_extracted = named.join(tracks.select("stem"), "stem", "left_anti").join(
        unreadable.select("stem"), "stem", "left_anti"
    )
    return (
        trips.unionByName(listed(not_extracted, "not extracted", "name"))
        .unionByName(listed(tracks.where(no_overlay), "no overlay", "video_filename"))
        .unionByName(listed(
            tracks.join(named.select("stem").distinct(), "stem", "left_anti"), "unreachable", "video_filename"
        ))
        .unionByName(listed(unreadable, "unreadable", "stem"))
    )
