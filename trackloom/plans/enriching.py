"""Street lists and localities of cleaned tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom import constants as C
from trackloom.operators import blocks, roads
from trackloom.session import durable


def match_tracks(samples: DataFrame, map_roads: DataFrame, chunks: DataFrame, hot=None) -> DataFrame:
    """Samples of runs with their matched street and road: ``trip_id, run, seq, t, step_m, street, road_id``."""
    hot = hot or blocks.find_hot_keys(samples, ("trip_id",))
    runs = durable(roads.match_runs(samples, hot=hot))
    cells = durable(roads.road_cells(chunks, map_roads))
    candidates = roads.candidate_costs(runs, cells)
    return roads.match_streets(runs, candidates, blocks.narrower(hot))


def enrich(
    samples: DataFrame, map_tables: tuple[DataFrame, DataFrame, DataFrame],
    map_timestamp: str = "", map_source: str = "", hot=None,
) -> tuple[DataFrame, DataFrame]:
    """Streets ``(trip_id, pos, name, ...)`` and, per trip, localities and provenance."""
    map_roads, chunks, places = map_tables
    hot = hot or blocks.find_hot_keys(samples, ("trip_id",))
    matched = durable(match_tracks(samples, map_roads, chunks, hot))
    parts = roads.merge_stretches(durable(roads.build_stretches(matched, hot=hot)), hot)
    streets = roads.describe_stretches(parts, map_roads)
    provenance = F.struct(
        F.lit(C.ENRICHER_VERSION).alias("enricher_version"), F.lit(map_timestamp).alias("osm_timestamp"),
        F.lit(map_source).alias("osm_source"), F.col("samples_digest"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("enriched_at"),
    )
    trips = roads.trip_localities(samples, places).join(roads.samples_digest(samples), "trip_id").select(
        "trip_id", "localities", provenance.alias("enrichment")
    )
    return durable(streets), trips


def enrich_stale(
    tracks: DataFrame, samples: DataFrame, map_tables, map_timestamp: str = "", map_source: str = "",
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Enrich only extracted tracks whose street list is missing or outdated (all by force)."""
    wanted = tracks.where(F.col("extraction_status") == C.EXTRACTION_OK)
    if not force:
        status = roads.enrichment_status(
            wanted, roads.samples_digest(samples), map_timestamp, map_source
        )
        wanted = status.where(F.col("enrichment_status") != "current")
    stale = samples.join(wanted.select("trip_id"), "trip_id", "left_semi")
    return enrich(durable(stale), map_tables, map_timestamp, map_source)
