"""The steps of an import, composed: group clips, clean, enrich, suggest names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom import constants as C
from trackloom.functions import text
from trackloom.operators import blocks, cleaning, library, naming, roads, stats
from trackloom.plans import enriching, indexing
from trackloom.session import durable


def plan_trips(
    clips: DataFrame, encoded: DataFrame, videos: DataFrame,
    gap_hours: float = C.TRIP_GAP_HOURS, scope: tuple[str, ...] = ("camera_id",),
) -> DataFrame:
    """Trips to encode from new clips, with their planned names and actions."""
    # Counted on the listing itself: what is left of a camera's clips is never more.
    hot = blocks.find_hot_keys(clips, scope)
    parsed = library.parse_clips(library.one_per_name(clips, *scope))
    grouped = library.group_trips(library.new_clips(parsed, encoded, *scope), gap_hours, scope, hot)
    scoped = [c for c in scope if c in videos.columns]
    return library.plan_outputs(library.describe_trips(grouped, scope), videos, *scoped)


def plan_range(
    clips: DataFrame, start: int, end: int, name: str | None, videos: DataFrame,
    scope: tuple[str, ...] = ("camera_id",),
) -> DataFrame:
    """One planned output per camera for the clips of an index range, encoded or not."""
    chosen = library.select_index_range(
        library.parse_clips(library.one_per_name(clips, *scope)), start, end
    )
    trips = library.describe_trips(chosen.withColumn("trip_seq", F.lit(1)), scope)
    given = F.lit(name).cast("string")
    trips = trips.withColumn("output_name", library.dated_output_name(given, F.col("start_time")))
    trips = trips.withColumn("problem", library.output_name_problem(F.col("output_name")))
    scoped = [c for c in scope if c in videos.columns]
    return library.plan_outputs(trips, videos, *scoped)


def reclean(
    tracks: DataFrame, samples: DataFrame, include: list[str] = (), exclude: list[str] = (),
    overrides: DataFrame | None = None, areas=(), timezone: str = "UTC",
) -> tuple[DataFrame, DataFrame]:
    """Clean the stored readings of the matching extracted tracks again.

    Returns their new samples and all track headers with the cleaning version raised.
    """
    chosen = tracks.where(
        (F.col("extraction_status") == C.EXTRACTION_OK)
        & text.matches_globs(F.col("video_filename"), list(include), list(exclude))
    ).select("trip_id", text.trip_date(F.col("video_filename")).alias("trip_date"))
    raw = samples.select(
        "trip_id", "seq", "t", "gps_text", "clock_text", "gps_score", "clock_score"
    ).join(chosen, "trip_id").withColumn("timezone", F.lit(timezone))
    headers = tracks.join(chosen.select("trip_id", F.lit(True).alias("_done")), "trip_id", "left").withColumn(
        "cleaning_version",
        F.when(F.col("_done"), F.lit(C.CLEANING_VERSION)).otherwise(F.col("cleaning_version")),
    ).drop("_done")
    return cleaning.clean_tracks(raw, overrides, areas), headers


def rename_inputs(
    tracks: DataFrame, samples: DataFrame, digests: DataFrame, timezone: str = "UTC"
) -> DataFrame:
    """What the rename plan needs to know about each track."""
    located = samples.groupBy("trip_id").agg(
        F.max(stats.is_located()).alias("has_located"), F.min("time").alias("start_time")
    )
    checked = roads.enrichment_status(tracks, digests)
    return checked.join(located, "trip_id", "left").select(
        "trip_id", F.col("video_filename").alias("filename"), "start_time",
        F.lit(timezone).alias("timezone"), "extraction_status",
        F.coalesce("has_located", F.lit(False)).alias("has_located"), "enrichment_status",
    )


def import_all(
    readings: DataFrame, tracks: DataFrame, videos: DataFrame, map_tables=None,
    overrides: DataFrame | None = None, car_model: str = "", timezone: str = "UTC",
) -> dict[str, DataFrame]:
    """Clean, index, enrich and suggest names. Without map tables it stops after the index.

    Each stage is written to the shared folder before the next, so that a lost executor never
    repeats earlier stages.
    """
    hot = blocks.find_hot_keys(readings, ("trip_id",))
    samples = durable(cleaning.clean_tracks(readings, overrides, hot=hot))
    if map_tables is None:
        return {"samples": samples, "index": indexing.build_index(tracks, samples, hot=hot)}
    streets, trips = enriching.enrich(samples, map_tables, hot=hot)
    trips = durable(trips)
    enriched = tracks.drop("enrichment").join(trips.select("trip_id", "enrichment"), "trip_id", "left")
    # The digests are those just written with the trips; the plan reads its inputs several times.
    digests = trips.select("trip_id", F.col("enrichment.samples_digest").alias("samples_digest"))
    names = naming.plan_renames(
        durable(rename_inputs(enriched, samples, digests, timezone)), streets,
        naming.taken_stems(videos, enriched.select(text.stem(F.col("video_filename")).alias("stem"))),
        car_model, hot=hot,
    )
    index = indexing.build_index(enriched, samples, streets, trips, hot=hot)
    return {"samples": samples, "streets": streets, "trips": trips, "index": index, "renames": names}
