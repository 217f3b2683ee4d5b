"""Trip statistics, runs and gaps, and positions along a trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom import constants as C
from trackloom.functions import geo, report
from trackloom.operators import blocks
from trackloom.operators.blocks import (
    Following, LastKnown, NextKnown, Ordering, Previous, RunningSum, by_group, scan,
)


def is_located(status: str = "status", lat: str = "lat", lon: str = "lon") -> Column:
    """Whether a sample has a usable position."""
    return F.coalesce(
        F.col(status).isin(*C.LOCATED_STATUSES) & F.col(lat).isNotNull() & F.col(lon).isNotNull(),
        F.lit(False),
    )


def is_gap(before: Column, after: Column) -> Column:
    """Whether two consecutive times are further apart than gaps are filled (or go back)."""
    step_s = (F.unix_micros(after) - F.unix_micros(before)) / 1e6
    return F.coalesce(~step_s.between(0, C.MAX_INTERPOLATION_GAP_S), F.lit(False))


def with_steps(samples: DataFrame, ordering: Ordering) -> DataFrame:
    """Add the sample before (``_prev``), the gap test and the driven step in meters."""
    df = samples.withColumn("_located", is_located())
    df = scan(df, ordering, _prev=Previous(F.struct(
        "seq", "t", "time", "lat", "lon", "kmh", F.col("_located").alias("located")
    )))
    gap = is_gap(F.col("_prev.time"), F.col("time"))
    joined = F.coalesce(F.col("_prev.located") & F.col("_located") & ~gap, F.lit(False))
    meters = geo.haversine_m(F.col("_prev.lat"), F.col("_prev.lon"), F.col("lat"), F.col("lon"))
    return df.withColumns({
        "_gap": gap, "_joined": joined, "_step_m": F.when(joined, meters).otherwise(F.lit(0.0))
    })


def trip_stats(samples: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Times, distance, speeds, coverage, status counts and bounding box of every trip."""
    steps = by_group(samples, ordering or blocks.trips(), with_steps, hot)
    moving_s = F.when(
        F.col("_joined"), (F.unix_micros("time") - F.unix_micros("_prev.time")) / 1e6
    )
    here = F.col("_located")
    sums = steps.groupBy("trip_id").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"),
        F.sum("_step_m").alias("_distance_m"), F.sum(moving_s).alias("_moving_s"),
        F.max("kmh").alias("max_kmh"),
        F.count(F.lit(1)).alias("_n"), F.count(F.when(here, 1)).alias("_located_n"),
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"_n_{s}") for s in C.ALL_STATUSES],
        *[
            function(F.when(here, F.col(name))).alias(f"_{label}_{name}")
            for label, function in (("min", F.min), ("max", F.max)) for name in ("lat", "lon")
        ],
    )
    counts = F.create_map(*[x for s in C.ALL_STATUSES for x in (F.lit(s), F.col(f"_n_{s}"))])
    duration = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    return sums.select(
        "trip_id", "start_time", "end_time",
        F.coalesce(report.rounded(duration).cast("long"), F.lit(0)).alias("duration_s"),
        report.rounded(F.col("_distance_m") / 1000, 2).alias("distance_km"),
        F.when(
            F.col("_moving_s") > 0, report.rounded(F.col("_distance_m") / F.col("_moving_s") * 3.6, 1)
        ).alias("avg_kmh"),
        "max_kmh",
        report.rounded(F.col("_located_n") / F.col("_n"), 3).alias("coverage"),
        F.map_filter(counts, lambda k, v: v > 0).alias("status_counts"),
        F.when(F.col("_located_n") > 0, F.struct(
            F.col("_min_lat").alias("min_lat"), F.col("_min_lon").alias("min_lon"),
            F.col("_max_lat").alias("max_lat"), F.col("_max_lon").alias("max_lon"),
        )).alias("bbox"),
    )


def trip_ends(samples: DataFrame) -> DataFrame:
    """Start time, and the first and last located sample of every trip."""
    order = F.when(is_located(), F.struct("t", "seq"))
    return samples.groupBy("trip_id").agg(
        F.min("time").alias("start_time"),
        F.min_by(F.struct("lat", "lon"), order).alias("start"),
        F.max_by(F.struct("lat", "lon"), order).alias("end"),
    )


def status_counts(samples: DataFrame) -> DataFrame:
    """Samples per status as columns, per trip."""
    return samples.groupBy("trip_id").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in C.ALL_STATUSES]
    )


# --- runs ------------------------------------------------------------------------------------------


def route_runs(samples: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """The located samples with the number of their drawn run (broken at gaps in time)."""

    def work(df, o):
        df = with_steps(df, o)
        before = F.coalesce(F.col("_prev.located"), F.lit(False))
        df = df.withColumn("_starts", F.when(F.col("_located") & (~before | F.col("_gap")), 1).otherwise(0))
        df = scan(df, o, run=RunningSum(F.col("_starts")))
        return df.where("_located").drop("_located", "_gap", "_joined", "_step_m", "_starts")

    return by_group(samples, ordering or blocks.trips(), work, hot).drop("_prev")


def route_gaps(runs: DataFrame) -> DataFrame:
    """Pairs of samples around each gap: the end of a run and the start of the next."""
    ends = runs.groupBy("trip_id", "run").agg(
        F.min(F.struct("t", "seq")).alias("_first"), F.max(F.struct("t", "seq")).alias("_last")
    )
    following = F.lead("_first").over(Window.partitionBy("trip_id").orderBy("run"))
    return ends.withColumn("_next", following).where(F.col("_next").isNotNull()).select(
        "trip_id", "run", F.col("_last.seq").alias("from_seq"), F.col("_next.seq").alias("to_seq")
    )


def speed_stretches(
    samples: DataFrame, ordering: Ordering | None = None, hot=None
) -> DataFrame:
    """Consecutive steps of a run in one speed bucket. Neighbors share a point."""

    def work(df, o):
        df = scan(df, o, _prev=Previous(F.struct("run", "seq", "kmh")))
        df = df.where(F.col("_prev.run") == F.col("run"))
        df = df.withColumn("bucket", report.speed_bucket(F.coalesce(F.col("_prev.kmh"), F.col("kmh"))))
        df = scan(df, o, _before=Previous(F.struct("run", "bucket")))
        same = F.col("_before").eqNullSafe(F.struct("run", "bucket"))
        df = df.withColumn("_starts", F.when(same, 0).otherwise(1))
        return scan(df, o, stretch=RunningSum(F.col("_starts")))

    order = F.struct("t", "seq")
    hot = hot or blocks.find_hot_keys(samples, ("trip_id",))
    steps = by_group(route_runs(samples, ordering, hot), ordering or blocks.trips(), work, hot)
    return steps.groupBy("trip_id", "run", "stretch", "bucket").agg(
        F.min_by("_prev.seq", order).alias("from_seq"), F.max_by("seq", order).alias("to_seq"),
        (F.count(F.lit(1)) + 1).alias("points"),
    )


# --- positions -------------------------------------------------------------------------------------


def position_at(
    samples: DataFrame, moments: DataFrame, ordering: Ordering | None = None, hot=None
) -> DataFrame:
    """Position at video seconds ``moments(trip_id, second)``.

    An as-of lookup without a range join: moments are merged into the order of the samples and
    take the last sample at or before them, moved towards the next one when that is close.
    """
    base = ordering or blocks.trips()
    hot = hot or blocks.find_hot_keys(samples, base.keys)

    def follow(df, o):
        df = df.withColumn("_located", is_located())
        return scan(df, o, _next=Following(F.struct(
            "t", "time", "lat", "lon", F.col("_located").alias("located")
        )))

    prepared = by_group(samples, base, follow, hot).select(
        "trip_id", "seq", "t", F.lit(0).alias("_kind"),
        F.struct(
            "t", "time", "lat", "lon", F.col("_located").alias("located"), F.col("_next").alias("next")
        ).alias("_sample"),
    )
    asked = moments.distinct().select(
        "trip_id", F.lit(0).alias("seq"), F.col("second").cast("double").alias("t"),
        F.lit(1).alias("_kind"),
    )
    merged = Ordering(base.keys, ("t", "_kind", "seq"), base.position, base.span)

    def look_up(df, o):
        return scan(df, o, _at=LastKnown(F.col("_sample")), _after=NextKnown(F.col("_sample")))

    found = by_group(prepared.unionByName(asked, allowMissingColumns=True), merged, look_up, hot)
    found = found.where("_kind = 1").withColumn("_at", F.coalesce("_at", "_after"))
    at, following = F.col("_at"), F.col("_at.next")
    moves = (
        following["located"] & (F.col("t") > at["t"])
        & (following["t"] - at["t"] <= C.MAX_MARKER_STEP_S)
        & ~is_gap(at["time"], following["time"])
    )
    fraction = (F.col("t") - at["t"]) / (following["t"] - at["t"])

    def place(name: str) -> Column:
        moved = at[name] + (following[name] - at[name]) * fraction
        return F.when(at["located"], F.when(moves, moved).otherwise(at[name])).alias(name)

    return found.select("trip_id", F.col("t").alias("second"), place("lat"), place("lon"))


def nearest_sample(samples: DataFrame, points: DataFrame, block: int = 256) -> DataFrame:
    """The located sample of a trip nearest to points ``(trip_id, point_id, lat, lon)``.

    A point does not meet every sample of its trip: samples are boxed by runs of ``block`` numbers,
    and a box that is farther away than another box's farthest corner is left out. Only the best
    sample per point survives the map-side part of the aggregate.
    """
    located = samples.where(is_located()).withColumn("_box", F.floor(F.col("seq") / block))
    boxes = located.groupBy("trip_id", "_box").agg(*[
        f(c).alias(f"_{name}_{c}") for c in ("lat", "lon") for name, f in (("min", F.min), ("max", F.max))
    ])
    asked = points.select("trip_id", "point_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    narrow = F.cos(F.radians("_lat"))

    def gap(c: str) -> Column:
        return F.greatest(F.col(f"_min_{c}") - F.col(f"_{c}"), F.col(f"_{c}") - F.col(f"_max_{c}"), F.lit(0.0))

    def reach(c: str) -> Column:
        return F.greatest(F.abs(F.col(f"_min_{c}") - F.col(f"_{c}")), F.abs(F.col(f"_max_{c}") - F.col(f"_{c}")))

    def squared(d_lat: Column, d_lon: Column) -> Column:
        return d_lat * d_lat + d_lon * narrow * d_lon * narrow

    met = asked.join(boxes, "trip_id").withColumns({
        "_least": squared(gap("lat"), gap("lon")), "_most": squared(reach("lat"), reach("lon"))
    })
    bound = met.groupBy("trip_id", "point_id").agg(F.min("_most").alias("_bound"))
    # a hair of slack: bounds and distances are rounded differently
    kept = met.join(bound, ["trip_id", "point_id"]).where(F.col("_least") <= F.col("_bound") * (1 + 1e-9))
    pairs = located.join(kept.select("trip_id", "_box", "point_id", "_lat", "_lon"), ["trip_id", "_box"])
    d_lat = F.col("lat") - F.col("_lat")
    d_lon = (F.col("lon") - F.col("_lon")) * narrow
    nearness = F.struct((d_lat * d_lat + d_lon * d_lon).alias("d"), "t", "seq")
    return pairs.groupBy("trip_id", "point_id").agg(F.min_by("seq", nearness).alias("seq"))
