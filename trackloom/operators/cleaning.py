"""From noisy once-per-second readings to clean tracks.

Input rows: ``trip_id, seq, t, gps_text, clock_text, gps_score, clock_score, trip_date,
timezone``. Every step keeps the partitioning by trip, so ordinary trips are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom import constants as C
from trackloom.functions import geo, text
from trackloom.operators import blocks
from trackloom.operators.blocks import (
    BLOCK, Following, GroupTotal, LastKnown, NextKnown, Ordering, Previous, RunningSum, by_group,
    scan,
)
from trackloom.operators.chains import select_chain
from trackloom.session import durable

# Overrides are typed by hand. Up to this many trips have theirs broadcast, else a join is used.
MAX_BROADCAST_TRIPS = 100_000

CLEAN_COLUMNS = ("t", "time", "lat", "lon", "kmh", "status", "time_estimated")


# --- collapsing frames ---------------------------------------------------------------------------


def collapse_frames(frames: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """One reading per clock tick: the place of its first frame, its last reliable GPS text."""
    ordering = ordering or blocks.trips()

    def work(df, o):
        df = scan(df, o, _before=Previous(F.col("clock_text")))
        first = ~F.col("clock_text").eqNullSafe(F.col("_before"))
        df = df.withColumn("_starts", F.when(first | F.col("_before").isNull(), 1).otherwise(0))
        df = scan(df, o, _tick=RunningSum(F.col("_starts")))
        reading = F.struct("gps_text", "clock_text", "gps_score", "clock_score")
        reliable = text.is_reliable(F.col("gps_text"), F.col("gps_score"))
        ticks = df.groupBy("trip_id", "_tick").agg(
            F.min(o.order_key()).alias("_first"),
            F.coalesce(
                F.max_by(reading, F.when(reliable, o.order_key())),
                F.max_by(reading, o.order_key()),
            ).alias("_reading"),
        )
        return ticks.select(
            "trip_id", F.col("_first.seq").alias("seq"), F.col("_first.t").alias("t"), "_reading.*"
        )

    return by_group(frames, ordering, work, hot)


# --- parsing -------------------------------------------------------------------------------------


def is_allowed_position(lat: Column, lon: Column, areas: Sequence[tuple]) -> Column:
    """Whether a position is in any ``(min_lat, min_lon, max_lat, max_lon)`` box (none = anywhere)."""
    inside = F.lit(not areas)
    for min_lat, min_lon, max_lat, max_lon in areas:
        inside = inside | (lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon))
    return inside


def attach_overrides(raw: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Add the ``bad_ranges`` and ``good_ranges`` of each trip as arrays."""
    empty = "cast(array() as array<struct<start_s:double,end_s:double>>)"
    if overrides is None:
        return raw.withColumns({"bad_ranges": F.expr(empty), "good_ranges": F.expr(empty)})
    time_range = F.struct(
        F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")
    )
    per_trip = overrides.groupBy("trip_id").agg(
        F.collect_list(F.when(F.col("kind") == "bad", time_range)).alias("bad_ranges"),
        F.collect_list(F.when(F.col("kind") == "good", time_range)).alias("good_ranges"),
    )
    if per_trip.select("trip_id").limit(MAX_BROADCAST_TRIPS + 1).count() <= MAX_BROADCAST_TRIPS:
        per_trip = F.broadcast(per_trip)
    joined = raw.join(per_trip, "trip_id", "left")
    return joined.withColumns({
        name: F.coalesce(name, F.expr(empty)) for name in ("bad_ranges", "good_ranges")
    })


def in_ranges(t: Column, ranges: str) -> Column:
    """Whether a video second is in any closed range of an array column."""
    return F.exists(ranges, lambda r: t.between(r["start_s"], r["end_s"]))


def initial_status(gps_text: Column, gps: Column, is_bad: Column, is_allowed: Column) -> Column:
    """Status before looking at other samples. The order of the rules matters."""
    return (
        F.when(gps_text == "", F.lit(C.NO_FIX))
        .when(gps.isNull(), F.lit(C.UNREADABLE))
        .when(is_bad | ~is_allowed, F.lit(C.SPOOFED))
        .otherwise(F.lit(C.OK))
    )


def is_clock_plausible(clock: Column, trip_date: Column) -> Column:
    """A readable clock within a day of the trip date (any date when that is unknown)."""
    near = F.abs(F.datediff(F.to_date(clock), trip_date)) <= C.MAX_CLOCK_DATE_DIFF_DAYS
    return clock.isNotNull() & (trip_date.isNull() | near)


def with_clocks(df: DataFrame) -> DataFrame:
    """Add the reliable clock read with the day first and with the month first, and the votes.

    The votes (``_vote_*``) of the readings of a trip decide which order its camera uses.
    """
    reliable = text.is_reliable(F.col("clock_text"), F.col("clock_score"))
    df = df.withColumn("_parts", F.when(reliable, text.clock_parts(F.col("clock_text"))))
    df = df.withColumn("_numbers", text.clock_numbers(F.col("_parts"))).drop("_parts")
    numbers = F.col("_numbers")
    # most clocks have the year first and are the same in both orders
    df = df.withColumn("_year_first", text.clock_year_first(numbers))
    is_year_last = numbers["last_width"] == 4
    df = df.withColumns({
        "_day_first": F.coalesce("_year_first", text.clock_year_last(numbers, True)),
        "_month_first": F.coalesce("_year_first", text.clock_year_last(numbers, False)),
        "_vote_day": F.when(is_year_last & (numbers["first"] > C.MAX_MONTH), 1).otherwise(0),
        "_vote_month": F.when(is_year_last & (numbers["middle"] > C.MAX_MONTH), 1).otherwise(0),
    }).drop("_numbers", "_year_first")

    def on_date(clock: str) -> Column:
        return F.when(F.to_date(clock) == F.col("trip_date"), 1).otherwise(0)

    return df.withColumns({
        "_vote_date_day": on_date("_day_first"), "_vote_date_month": on_date("_month_first")
    })


VOTES = ("day", "month", "date_day", "date_month")


def is_day_first(prefix: str) -> Column:
    """Decide the order from summed votes: numbers above 12, then trip dates, then day first."""
    day, month, date_day, date_month = (F.col(f"{prefix}{name}") for name in VOTES)
    return F.when((day > 0) | (month > 0), day >= month).otherwise(date_day >= date_month)


def infer_day_first(raw: DataFrame) -> DataFrame:
    """Day-first decision per trip, as a map-side combined aggregate."""
    sums = with_clocks(raw).groupBy("trip_id").agg(
        *[F.sum(f"_vote_{name}").alias(f"votes_{name}") for name in VOTES]
    )
    return sums.withColumn("is_day_first", is_day_first("votes_"))


def parse_readings(
    raw: DataFrame, ordering: Ordering, areas: Sequence[tuple] = (), timezone: str | None = None
) -> DataFrame:
    """Parsed GPS, clock, UTC instant, initial status and segment of every reading.

    Candidate fixes (initial status ok) are numbered by ``segment``, a stretch of physically
    reachable fixes, and by ``place``, segments without a teleport between them. Other rows
    carry the numbers of the fixes around them. ``timezone`` is the zone of all cameras; without
    it the column of that name is used.

    The running state of instants and segments is computed side by side: two passes over the
    order of a trip instead of four.
    """
    gps_reliable = text.is_reliable(F.col("gps_text"), F.col("gps_score"))
    df = raw.withColumn("_gps_parts", F.when(gps_reliable, text.gps_parts(F.col("gps_text"))))
    df = df.withColumn("gps", text.gps_from_parts(F.col("_gps_parts"))).drop("_gps_parts")
    df = df.withColumn("initial_status", initial_status(
        F.col("gps_text"), F.col("gps"), in_ranges(F.col("t"), "bad_ranges"),
        is_allowed_position(F.col("gps.lat"), F.col("gps.lon"), areas),
    ))
    df = scan(with_clocks(df), ordering, **{
        f"_sum_{name}": GroupTotal(F.col(f"_vote_{name}")) for name in VOTES
    })
    clock = F.when(is_day_first("_sum_"), F.col("_day_first")).otherwise(F.col("_month_first"))
    df = df.withColumn("clock", clock).drop(
        "_day_first", "_month_first", *[f"{p}{name}" for name in VOTES for p in ("_vote_", "_sum_")]
    )
    is_candidate = F.col("initial_status") == C.OK
    df = df.withColumns({
        "_trusted": F.when(is_clock_plausible(F.col("clock"), F.col("trip_date")), F.col("clock")),
        "_fix": F.when(is_candidate, F.struct("t", "gps.lat", "gps.lon")),
    })
    df = scan(
        df, ordering, _clock_before=LastKnown(F.col("_trusted")), _from=LastKnown(F.col("_fix"))
    )
    zone = F.col("timezone") if timezone is None else F.lit(timezone)
    df = _with_segment_starts(_with_local_instants(df, zone))
    df = scan(
        df, ordering, _repeating=LastKnown(F.col("_event"), inclusive=True),
        segment=RunningSum(F.col("_starts_segment")), place=RunningSum(F.col("_starts_place")),
    )
    use_second = F.col("_two") & (F.col("_repeating") == 1)
    instant = F.when(use_second, F.col("_second")).otherwise(F.col("_first"))
    return df.withColumn("instant", instant).drop(
        "_trusted", "_first", "_second", "_two", "_clock_before", "_event", "_repeating",
        "_fix", "_from", "_starts_segment", "_starts_place",
    )


def _with_local_instants(df: DataFrame, zone: Column) -> DataFrame:
    """Add the UTC instant ``_first`` of a trusted clock, its other reading ``_second``, ``_two``:
    whether these differ, and ``_event``: what the reading says about the hour.

    A repeated hour can be its first or second occurrence; a skipped hour can be taken with the
    offset from before or after the change. The second one is taken once the clock has stepped
    back (event 1), until a clock with a single reading follows (event 0).
    """
    df = df.withColumn("_first", F.to_utc_timestamp("_trusted", zone))
    later = F.col("_first") + F.expr("INTERVAL 1 DAY")
    offset_after_us = F.unix_micros(F.from_utc_timestamp(later, zone)) - F.unix_micros(later)
    df = df.withColumn("_second", F.timestamp_micros(F.unix_micros("_trusted") - offset_after_us))
    # The offset is the same a day later except around a change, so most rows stop here.
    repeated = (F.col("_second") > F.col("_first")) & (
        F.from_utc_timestamp("_second", zone) == F.col("_trusted")
    )
    skipped = (F.col("_second") < F.col("_first")) & (
        F.from_utc_timestamp("_first", zone) != F.col("_trusted")
    )
    df = df.withColumn("_two", F.coalesce(repeated | skipped, F.lit(False)))
    step_back_s = (F.unix_micros("_clock_before") - F.unix_micros("_trusted")) / 1e6
    return df.withColumn("_event", F.when(F.col("_trusted").isNotNull() & ~F.col("_two"), 0).when(
        F.col("_two") & (step_back_s > C.CLOCK_JITTER_S), 1
    ))


# --- rejecting wrong fixes -------------------------------------------------------------------------


def _with_segment_starts(df: DataFrame) -> DataFrame:
    """Mark the candidate fixes that cannot be reached from the fix before, or only by noise."""
    is_candidate = F.col("initial_status") == C.OK
    distance = geo.haversine_m(
        F.col("_from.lat"), F.col("_from.lon"), F.col("gps.lat"), F.col("gps.lon")
    )
    speed = geo.implied_speed_kmh(distance, F.greatest(F.lit(1.0), F.col("t") - F.col("_from.t")))
    df = df.withColumn("_speed", F.when(is_candidate, speed))

    def starts(limit: float) -> Column:
        is_first = is_candidate & F.col("_from").isNull()
        return F.when(is_first | (F.col("_speed") > limit), 1).otherwise(0)

    return df.withColumns({
        "_starts_segment": starts(C.MAX_SPEED_KMH), "_starts_place": starts(C.MAX_PLACE_JUMP_KMH)
    }).drop("_speed")


def speed_pairs(fixes: DataFrame, ordering: Ordering) -> DataFrame:
    """Add ``mismatch_kmh``: displayed against implied speed over at least five seconds.

    Each fix is paired with the first fix of its segment at least five seconds later. That is
    the fix following the last one less than five seconds ahead, so a short sliding frame finds
    it. Mean displayed speeds come from running totals.
    """
    shown = F.col("gps.speed_kmh").cast("long")
    fixes = scan(
        fixes, ordering,
        _speed_sum=RunningSum(F.coalesce(shown, F.lit(0))),
        _speed_count=RunningSum(F.when(shown.isNotNull(), 1).otherwise(0)),
    )
    here = F.struct("segment", "t", "gps.lat", "gps.lon", "_speed_sum", "_speed_count")
    fixes = scan(fixes, ordering, _after=Following(here))
    span_ms = C.SPEED_CHECK_SPAN_S * 1000
    fixes = blocks.neighborhood(
        fixes, ordering, 0, C.SPEED_CHECK_SPAN_S,
        lambda window: {
            "_end": F.max_by("_after", "seq").over(window(ranged=True).rangeBetween(0, span_ms - 1))
        },
    )
    end = F.col("_end")
    total = end["_speed_sum"] - F.col("_speed_sum") + F.coalesce(shown, F.lit(0))
    count = end["_speed_count"] - F.col("_speed_count") + F.when(shown.isNotNull(), 1).otherwise(0)
    implied = geo.implied_speed_kmh(
        geo.haversine_m(F.col("gps.lat"), F.col("gps.lon"), end["lat"], end["lon"]),
        end["t"] - F.col("t"),
    )
    mismatch = F.when(
        (end["segment"] == F.col("segment")) & (count > 0), F.abs(implied - total / count)
    )
    return fixes.withColumn("mismatch_kmh", mismatch)


def is_median_over(values: Column, limit: float) -> dict[str, Column]:
    """Aggregates that decide exactly whether a median exceeds a limit, whatever the group size.

    Only the counts on both sides and the two values next to the limit are needed, so nothing
    is collected.
    """
    return {
        "_n": F.count(values),
        "_over": F.count(F.when(values > limit, 1)),
        "_below": F.max(F.when(values <= limit, values)),
        "_above": F.min(F.when(values > limit, values)),
    }


def median_over(limit: float) -> Column:
    """Combine the aggregates of ``is_median_over``."""
    split_evenly = F.col("_over") * 2 == F.col("_n")
    middle = (F.col("_below") + F.col("_above")) / 2
    return F.when(split_evenly, middle > limit).otherwise(F.col("_over") * 2 > F.col("_n"))


def summarize_segments(fixes: DataFrame) -> DataFrame:
    """One row per segment: weight, end fixes, clock counts and the speed verdict."""
    readable = F.col("clock").isNotNull()
    fix = F.struct("t", "instant", "gps.lat", "gps.lon")
    order = F.struct("t", "seq")
    segments = fixes.groupBy("trip_id", "segment", "place").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min_by(fix, order).alias("first"),
        F.max_by(fix, order).alias("last"),
        F.count(F.when(readable, 1)).alias("readable"),
        F.count(F.when(readable & F.col("instant").isNull(), 1)).alias("implausible"),
        *[
            column.alias(name)
            for name, column in is_median_over(
                F.col("mismatch_kmh"), C.MAX_MEDIAN_SPEED_MISMATCH_KMH
            ).items()
        ],
    )
    return segments.select(
        "trip_id", "segment", "place", "weight", "first", "last", "readable", "implausible",
        F.col("_n").alias("speed_pairs"),
        F.coalesce(
            (F.col("_n") >= C.MIN_SPEED_PAIRS)
            & median_over(C.MAX_MEDIAN_SPEED_MISMATCH_KMH),
            F.lit(False),
        ).alias("speed_mismatch"),
    )


def plausible_segments(segments: DataFrame) -> DataFrame:
    """Drop segments with a mostly implausible clock (itself or its place) or a wrong speed."""
    place = Window.partitionBy("trip_id", "place")
    return (
        segments.withColumns({
            "_place_bad": F.sum("implausible").over(place) * 2 > F.sum("readable").over(place),
            "_bad": F.col("implausible") * 2 > F.col("readable"),
        })
        .where(~F.col("_place_bad") & ~F.col("_bad") & ~F.col("speed_mismatch"))
        .drop("_place_bad", "_bad")
    )


def attach_kept(rows: DataFrame, kept: DataFrame, fixes: DataFrame, ordering: Ordering) -> DataFrame:
    """Add ``is_kept`` to the rows, without shuffling them by segment.

    The kept segment numbers are gathered per trip (or per block of an oversized trip), which
    is how the rows are already laid out.
    """
    keys = list(ordering.partition)
    if ordering.blocked:
        spans = fixes.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("_n"))
        kept = spans.join(kept, ["trip_id", "segment"]).select(*keys, "segment")
    gathered = kept.groupBy(*keys).agg(F.collect_set("segment").alias("_kept"))
    return rows.join(gathered, keys, "left").withColumn(
        "is_kept", F.coalesce(F.array_contains("_kept", F.col("segment")), F.lit(False))
    ).drop("_kept")


def detect_good_fixes(parsed: DataFrame, ordering: Ordering) -> DataFrame:
    """Add the final status of every sample (gaps are filled later)."""
    # Parsed readings are written once: the segments are summarized before any status is known, and
    # without the table every text would be parsed, and every trip be sorted, for both again.
    rows = durable(parsed)
    fixes = rows.where(F.col("initial_status") == C.OK)
    # One row per segment. Writing this small table keeps the fixes from being paired again for
    # each of its uses.
    segments = durable(summarize_segments(speed_pairs(fixes, ordering)))
    kept = select_chain(plausible_segments(segments))
    rows = attach_kept(rows, kept, fixes, ordering)
    good_override = F.col("gps").isNotNull() & in_ranges(F.col("t"), "good_ranges")
    status = (
        F.when((F.col("initial_status") == C.OK) & F.col("is_kept") | good_override, F.lit(C.OK))
        .when(F.col("initial_status") == C.OK, F.lit(C.SPOOFED))
        .otherwise(F.col("initial_status"))
    )
    return rows.withColumn("status", status)


# --- times and gaps --------------------------------------------------------------------------------


def clock_jumps(parsed: DataFrame, ordering: Ordering) -> DataFrame:
    """Add ``jump_s``: the merge gap between a sample and the one before."""
    df = scan(parsed, ordering, _row_before=Previous(F.struct("t", "instant")))
    clock_s = (F.unix_micros("instant") - F.unix_micros("_row_before.instant")) / 1e6
    jump = clock_s - (F.col("t") - F.col("_row_before.t"))
    is_jump = (jump > C.CLOCK_JITTER_S) & (jump <= C.MAX_MERGE_GAP_S)
    return df.withColumn("jump_s", F.when(is_jump, jump).otherwise(F.lit(0.0)))


def assign_times(df: DataFrame, ordering: Ordering) -> DataFrame:
    """Add ``time`` and ``time_estimated`` from the nearest accepted fixes with a good clock."""
    df = clock_jumps(df, ordering)
    untrusted = F.when(F.col("instant").isNull(), 1).otherwise(0)
    df = df.withColumn("_untrusted", untrusted)
    df = scan(
        df, ordering, _jumps=RunningSum(F.col("jump_s")), _doubts=RunningSum(F.col("_untrusted"))
    )
    is_anchor = (F.col("status") == C.OK) & F.col("instant").isNotNull()
    anchor = F.when(is_anchor, F.struct("t", "instant", "_jumps", "_doubts"))
    df = df.withColumn("_anchor", anchor)
    df = scan(df, ordering, _past=LastKnown(F.col("_anchor")))
    df = scan(df, ordering, _future=NextKnown(F.col("_anchor")))

    def derive(name: str, doubts: Column) -> Column:
        side = F.col(name)
        offset_s = F.rint(F.col("t") - side["t"] + F.col("_jumps") - side["_jumps"])
        time = F.timestamp_micros(
            F.unix_micros(side["instant"]) + (offset_s * 1_000_000).cast("long")
        )
        return F.when(side.isNotNull(), F.struct(
            (doubts > 0).alias("estimated"), F.abs(side["t"] - F.col("t")).alias("far"),
            time.alias("time"),
        ))

    past = derive("_past", F.col("_doubts") - F.col("_past._doubts"))
    future = derive("_future", F.col("_future._doubts") - F.col("_doubts") + F.col("_untrusted"))
    df = df.withColumns({"_from_past": past, "_from_future": future})
    prefer_future = F.struct("_from_future.estimated", "_from_future.far") < F.struct(
        "_from_past.estimated", "_from_past.far"
    )
    chosen = F.when(F.col("_from_past").isNull(), F.col("_from_future")).when(
        F.col("_from_future").isNull() | ~prefer_future, F.col("_from_past")
    ).otherwise(F.col("_from_future"))
    return df.withColumns({
        "time": F.when(is_anchor, F.col("instant")).otherwise(
            F.coalesce(chosen["time"], F.when(chosen.isNull(), F.col("instant")))
        ),
        "time_estimated": F.when(is_anchor, F.lit(False)).otherwise(
            F.coalesce(chosen["estimated"], F.lit(True))
        ),
    })


def interpolate_gaps(df: DataFrame, ordering: Ordering) -> DataFrame:
    """Fill short runs without a good fix between two good fixes (position, not speed)."""
    good = F.when(F.col("status") == C.OK, F.struct("t", "time", "lat", "lon"))
    df = df.withColumn("_good", good)
    # The rows are in descending order here, so looking ahead first saves a sort.
    df = scan(df, ordering, _right=NextKnown(F.col("_good")))
    df = scan(df, ordering, _left=LastKnown(F.col("_good")))

    def seconds(start: str, end: Column, end_t: Column) -> Column:
        by_clock = (F.unix_micros(end) - F.unix_micros(f"{start}.time")) / 1e6
        return F.coalesce(by_clock, end_t - F.col(f"{start}.t"))

    gap_s = seconds("_left", F.col("_right.time"), F.col("_right.t"))
    elapsed_s = seconds("_left", F.col("time"), F.col("t"))
    fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed_s / gap_s))
    fills = (
        (F.col("status") != C.OK)
        & F.col("_left").isNotNull() & F.col("_right").isNotNull()
        & (gap_s > 0) & (gap_s <= C.MAX_INTERPOLATION_GAP_S)
    )

    def between(name: str) -> Column:
        start, end = F.col(f"_left.{name}"), F.col(f"_right.{name}")
        return F.when(fills, start + (end - start) * fraction).otherwise(F.col(name))

    return df.withColumns({
        "lat": between("lat"), "lon": between("lon"),
        "status": F.when(fills, F.lit(C.INTERPOLATED)).otherwise(F.col("status")),
    })


def clean_tracks(
    raw: DataFrame,
    overrides: DataFrame | None = None,
    areas: Sequence[tuple] = (),
    ordering: Ordering | None = None,
    hot=None,
    timezone: str | None = None,
) -> DataFrame:
    """Clean the readings of all trips: status, time, position and speed of every sample."""

    def work(df, o):
        df = parse_readings(df, o, areas, timezone)
        df = detect_good_fixes(df, o)
        df = assign_times(df, o)
        is_ok = F.col("status") == C.OK
        df = df.withColumns({
            "lat": F.when(is_ok, F.col("gps.lat")),
            "lon": F.when(is_ok, F.col("gps.lon")),
            "kmh": F.when(is_ok, F.col("gps.speed_kmh")),
        })
        kept = ["gps_text", "clock_text", "gps_score", "clock_score", "timezone"]
        block = [BLOCK] if o.blocked else []
        return interpolate_gaps(df, o).select("trip_id", "seq", *CLEAN_COLUMNS, *kept, *block)

    return by_group(attach_overrides(raw, overrides), ordering or blocks.trips(), work, hot)
