"""Time the headline pipelines and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. The readings are
derived from the given tables first (not timed): they are the input of the engine. Each stage is
then run from stored input of the stage before, and its whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackloom.operators import blocks, cleaning, geometry, library  # noqa: E402
from trackloom.plans import enriching, importing, indexing  # noqa: E402
from trackloom.catalog import queries as catalog  # noqa: E402
from trackloom.session import build_session, durable  # noqa: E402
from trackloom.sources import derived  # noqa: E402


def run(df) -> None:
    """Compute a whole result without moving it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", cpus)

    readings = durable(derived.readings(spark, folder))
    map_tables = catalog.map_tables(spark, folder)
    tracks = derived.trip_tracks(spark, folder)
    rows = readings.count()
    state = {}

    def e1_clean():
        state["samples"] = durable(cleaning.clean_tracks(readings, derived.overrides(spark, folder)))

    def e3_enrich():
        state["streets"], state["trips"] = enriching.enrich(state["clean"], map_tables)
        run(state["trips"])

    def e5_index():
        run(indexing.build_index(tracks, state["clean"], state["streets"], state["trips"]))

    def e6_geometry():
        state["routes"] = durable(geometry.simplify_routes(state["clean"]))

    def e16_heatmap():
        lat = geometry.reference_lat(state["routes"])
        run(geometry.heat_points(geometry.heat_cells(state["routes"], lat), 10, lat))

    def e7_trips():
        clips = derived.clips(spark, folder)
        run(importing.plan_trips(clips, derived.encoded_log(spark, folder), derived.library_files(spark, folder)))

    def a5_stats():
        run(indexing.stats.trip_stats(state["clean"]))

    def clean_without_overrides():
        state["clean"] = durable(cleaning.clean_tracks(readings, timezone=derived.TIMEZONE))

    timings = {}
    for name, work in (
        ("e1_clean_tracks", e1_clean), ("e1_clean_tracks_again", clean_without_overrides), ("a5_trip_stats", a5_stats),
        ("e3_enrich", e3_enrich), ("e5_build_index", e5_index), ("e6_geometry", e6_geometry),
        ("e16_heatmap", e16_heatmap), ("e7_plan_trips", e7_trips),
    ):
        start = time.perf_counter()
        work()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline pipelines, total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")), "readings": rows,
    }), flush=True)


if __name__ == "__main__":
    main()
