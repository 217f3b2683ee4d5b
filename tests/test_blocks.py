"""Oversized groups, processed in blocks, give the same rows as plain windows."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from trackloom.operators import blocks, cleaning, geometry, library, quality, roads, stats
from trackloom.operators.blocks import HotKeys, Ordering
from trackloom.plans import enriching
from trackloom.session import durable
from trackloom.sources import derived


@pytest.fixture(scope="module")
def hot(readings):
    """Declare about half of the trips oversized."""
    return HotKeys(readings.select("trip_id").distinct().where("trip_id % 2 = 1"))


SHORT = blocks.trips(span_s=16)


def test_hot_keys_are_found_by_size(readings):
    assert blocks.find_hot_keys(readings, ("trip_id",)).keys is None
    sizes = {r.trip_id: r["count"] for r in readings.groupBy("trip_id").count().collect()}
    found = blocks.find_hot_keys(readings, ("trip_id",), 65)
    assert {r.trip_id for r in found.keys.collect()} == {k for k, n in sizes.items() if n > 65}


def test_every_kind_of_scan(spark, readings, hot):
    def work(df, o):
        value = F.when(F.col("seq") % 5 == 0, F.col("seq"))
        return blocks.scan(
            df, o, total=blocks.RunningSum(F.col("seq")), last=blocks.LastKnown(value),
            last_here=blocks.LastKnown(value, inclusive=True), next=blocks.NextKnown(value),
            before=blocks.Previous(value), after=blocks.Following(value),
            all=blocks.GroupTotal(F.col("seq")), top=blocks.GroupTotal(F.col("seq"), F.max),
        ).select("trip_id", "seq", "total", "last", "last_here", "next", "before", "after", "all", "top",
                 *([blocks.BLOCK] if o.blocked else []))

    plain = rows(blocks.by_group(readings, SHORT, work, blocks.NO_HOT_KEYS))
    assert rows(blocks.by_group(readings, SHORT, work, hot)) == plain and len(plain) == 1000


def test_cleaning_in_blocks(spark, readings, hot):
    overrides = derived.overrides(spark, SMALL)
    plain = rows(cleaning.clean_tracks(readings, overrides, hot=blocks.NO_HOT_KEYS))
    assert rows(cleaning.clean_tracks(readings, overrides, ordering=SHORT, hot=hot)) == plain


def test_runs_and_steps_in_blocks(samples, hot):
    for operator in (stats.route_runs, stats.speed_stretches, roads.match_runs):
        plain = rows(operator(samples, hot=blocks.NO_HOT_KEYS))
        assert rows(operator(samples, ordering=SHORT, hot=hot)) == plain, operator.__name__


def test_positions_in_blocks(samples, hot):
    moments = samples.select("trip_id", (F.col("t") + 0.5).alias("second"))
    plain = rows(stats.position_at(samples, moments, hot=blocks.NO_HOT_KEYS))
    assert rows(stats.position_at(samples, moments, ordering=SHORT, hot=hot)) == plain


def test_frames_and_flags_in_blocks(readings, hot):
    frames = durable(derived.frame_readings(readings))
    for operator in (cleaning.collapse_frames, quality.flagged_readings):
        plain = rows(operator(frames, hot=blocks.NO_HOT_KEYS))
        assert rows(operator(frames, ordering=SHORT, hot=hot)) == plain, operator.__name__


def test_clips_in_blocks(spark):
    clips = library.parse_clips(library.one_per_name(derived.clips(spark, SMALL), "camera_id"))
    every = HotKeys(clips.select("camera_id").distinct())
    assert rows(library.group_trips(clips, hot=every)) == rows(library.group_trips(clips, hot=blocks.NO_HOT_KEYS))


@pytest.fixture(scope="module")
def winding(spark):
    """A slow winding route with stops, so that thinning and simplifying have work to do."""
    df = spark.range(2).withColumnRenamed("id", "trip_id").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(400))))
    slow = F.col("seq") * 0.00003 + F.when(F.col("seq") % 90 < 30, 0.0).otherwise(F.sin(F.col("seq") / 9) * 0.0004)
    return durable(df.select(
        "trip_id", F.lit(1).cast("bigint").alias("run"), F.col("seq").cast("double").alias("t"), F.col("seq").cast("int"),
        F.round(49.8 + slow, 5).alias("lat"), F.round(24 + F.cos(F.col("seq") / 7 + F.col("trip_id")) * 0.0006, 5).alias("lon"),
    ))


def test_thinning_and_simplifying_in_blocks(winding):
    short = geometry.runs_of_points(span_s=16)
    every = HotKeys(winding.select("trip_id", "run").distinct())
    thinned = durable(geometry.thin_points(winding, hot=blocks.NO_HOT_KEYS))
    assert 50 < thinned.count() < winding.count()
    assert rows(geometry.thin_points(winding, short, every)) == rows(thinned)
    simple = geometry.simplify_points(thinned, hot=blocks.NO_HOT_KEYS)
    assert simple.count() < thinned.count()
    assert rows(geometry.simplify_points(thinned, short, every)) == rows(simple)


def test_street_matching_in_blocks(spark, samples):
    roads_table, chunks, _ = roads.load_map(derived.road_nodes(spark, SMALL), derived.road_ways(spark, SMALL))
    runs = durable(roads.match_runs(samples, hot=blocks.NO_HOT_KEYS))
    candidates = durable(roads.candidate_costs(runs, roads.road_cells(chunks, roads_table)))
    plain = rows(roads.match_streets(runs, candidates, blocks.NO_HOT_KEYS))
    every = HotKeys(runs.select("trip_id", "run").distinct())
    assert rows(roads.match_streets(runs, candidates, every, span_s=16)) == plain


def test_rows_do_not_depend_on_the_number_of_partitions(spark, readings):
    many = rows(cleaning.clean_tracks(readings, hot=blocks.NO_HOT_KEYS))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(cleaning.clean_tracks(readings, hot=blocks.NO_HOT_KEYS)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_without_a_position_stay_in_blocks(spark):
    import pyspark.sql.functions as F

    df = spark.range(100).select(
        F.lit(1).alias("trip_id"), F.when(F.col("id") != 3, F.col("id").cast("double")).alias("t"), F.col("id").cast("int").alias("seq")
    )
    def scanned(df, o):
        return blocks.scan(df, o, total=blocks.RunningSum(F.lit(1)), before=blocks.LastKnown(F.col("seq")))

    def nearby(df, o):
        return blocks.neighborhood(df, o, 5, 5, lambda w: {"n": F.count("t").over(w(True).rangeBetween(-5000, 5000))})

    short = blocks.trips(16)
    every = HotKeys(df.select("trip_id").distinct())
    for work in (scanned, nearby):
        plain = rows(blocks.by_group(df, short, work, blocks.NO_HOT_KEYS))
        assert len(plain) == 100 and rows(blocks.by_group(df, short, work, every)) == plain
