"""Simplified routes, and the coverage heatmap made from them.

Geometry is kept as rows ``(trip_id, run, pos, lat, lon)``, so a route of any length is spread
over tasks. ``nest_geometry`` builds the per-trip document form of ordinary trips.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom import constants as C
from trackloom.functions import report
from trackloom.operators import blocks, stats
from trackloom.operators.blocks import (
    BLOCK, Following, LastKnown, NextKnown, Ordering, RunningSum, by_group, scan,
)
from trackloom.session import durable

# Video time of one block of an oversized run when it is thinned.
THIN_SPAN_S = 4096.0


def runs_of_points(span_s: float = 16384) -> Ordering:
    """Points of a run in video order."""
    return Ordering(("trip_id", "run"), ("t", "seq"), "t", span_s)


def route_points(samples: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Located samples in runs, with coordinates rounded before any thinning."""
    runs = stats.route_runs(samples, ordering, hot)
    return runs.select(
        "trip_id", "run", "t", "seq",
        report.rounded("lat", C.GEOMETRY_DECIMALS).alias("lat"),
        report.rounded("lon", C.GEOMETRY_DECIMALS).alias("lon"),
    )


# --- dropping close points ---------------------------------------------------------------------------


def _bounds(rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run in rows sorted by run."""
    values = rows[keys].to_numpy()
    new = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], new]), np.concatenate([new, [len(rows)]]) - 1


def _is_far(phi_a: np.ndarray, turn_a: np.ndarray, phi_b: np.ndarray, turn_b: np.ndarray) -> np.ndarray:
    """Whether points (in radians) are at least the minimum step apart."""
    half_phi, half_turn = np.sin((phi_b - phi_a) / 2), np.sin((turn_b - turn_a) / 2)
    chord = half_phi**2 + np.cos(phi_a) * np.cos(phi_b) * half_turn**2
    return 2 * C.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, chord))) >= C.GEOMETRY_MIN_STEP_M


def _far_enough(lat: np.ndarray, lon: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which points are at least the minimum step away from the one kept before them in their run.

    All runs move on by one point at a time.
    """
    kept = np.zeros(len(lat), bool)
    phi, turn = np.radians(lat), np.radians(lon)
    kept[first] = True
    at, step = first.copy(), 1
    while (going := np.flatnonzero(first + step <= last)).size:
        here = first[going] + step
        away = _is_far(phi[at[going]], turn[at[going]], phi[here], turn[here])
        kept[here[away]] = True
        at[going[away]] = here[away]
        step += 1
    return kept


def _thin_runs(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Thin many runs; the last point of each always stays, and runs of one point go."""
    first, last = _bounds(rows, keys)
    kept = _far_enough(rows["lat"].to_numpy(), rows["lon"].to_numpy(), first, last)
    kept[last] = True
    kept[first[first == last]] = False
    return rows[kept]


def _following(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first later one that is far enough, and where a walk over these ends.

    The point after the last stands for none. All open points look one point further at a time.
    """
    size = len(lat)
    phi, turn = np.radians(lat), np.radians(lon)
    after = np.full(size, size)
    waiting, step = np.arange(size), 1
    while (waiting := waiting[waiting + step < size]).size:
        away = _is_far(phi[waiting], turn[waiting], phi[waiting + step], turn[waiting + step])
        after[waiting[away]] = waiting[away] + step
        waiting, step = waiting[~away], step + 1
    exits = np.where(after < size, after, np.arange(size))
    for _ in range(size.bit_length()):
        exits = exits[exits]
    return after, exits


def _first_far(lat: np.ndarray, lon: np.ndarray, point: tuple[float, float]) -> int:
    """Place of the first point that is far enough from a given one, or -1."""
    begin, size = 0, 16
    phi, turn = np.radians(point[0]), np.radians(point[1])
    while begin < len(lat):
        part = slice(begin, begin + size)
        away = np.flatnonzero(_is_far(phi, turn, np.radians(lat[part]), np.radians(lon[part])))
        if away.size:
            return begin + int(away[0])
        begin, size = begin + size, size * 4
    return -1


def _enter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of the first kept point of every block, null where a block keeps none.

    Rows ``(block, lat, lon, exits, run...)`` come by run and block. Between rows only the last kept point
    of the current run is held; how a block goes on from its first kept point is in its table of exits.
    """
    run, point = None, None
    for batch in batches:
        entries = []
        for row in range(batch.num_rows):
            own = tuple(batch.column(i)[row].as_py() for i in range(4, batch.num_columns))
            lat, lon, exits = (batch.column(i)[row].values.to_numpy() for i in (1, 2, 3))
            entry = 0 if own != run else _first_far(lat, lon, point)
            if entry >= 0:
                point = (lat[exits[entry]], lon[exits[entry]])
            run = own
            entries.append(None if entry < 0 else entry)
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[4:], batch.column(0), pa.array(entries, pa.int64())], [*names[4:], names[0], "_entry"]
        )


def _thin_blocks(points: DataFrame, ordering: Ordering) -> DataFrame:
    """Thin oversized runs in three passes, whatever the data.

    After any kept point the next kept one is the first that is far enough from it. So each block is
    turned into a table, in parallel: for every point the next one in the block, and the last one that a
    walk from it reaches. One row per block then goes through its run in order, which finds the first kept
    point of each block from the last one kept before it. At last all blocks are walked from there, in
    parallel again. Every run keeps its last point; runs of one point go.
    """
    fine = replace(ordering, span=min(ordering.span, THIN_SPAN_S))
    points = fine.cut(points.drop(BLOCK))
    keys, columns = list(ordering.keys), [c for c in points.columns if c not in (*ordering.keys, BLOCK)]
    types = dict(points.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    arrays = ", ".join(f"{c} array<{types[c]}>" for c in columns)

    def tables(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        out = []
        for first, last in zip(*_bounds(rows, by)):
            part = rows.iloc[first : last + 1]
            after, exits = _following(part["lat"].to_numpy(), part["lon"].to_numpy())
            out.append([*(part[k].iloc[0] for k in by), *(part[c].tolist() for c in columns), after.tolist(), exits.tolist()])
        return pd.DataFrame(out, columns=[*by, *columns, "_after", "_exits"])

    packed = durable(blocks.map_groups(
        points, [*keys, BLOCK], ["t", "seq"], tables, f"{key_schema}, {BLOCK} bigint, {arrays}, _after array<bigint>, _exits array<bigint>"
    ))
    entered = packed.repartition(*keys).sortWithinPartitions(*keys, BLOCK).select(
        BLOCK, F.col("lat").cast("array<double>"), F.col("lon").cast("array<double>"), "_exits", *keys
    ).mapInArrow(_enter_blocks, f"{key_schema}, {BLOCK} bigint, _entry bigint")
    whole = packed.groupBy(*keys).agg(F.sum(F.size("_after")).alias("_points"), F.max(BLOCK).alias("_last"))
    walked = packed.join(entered, [*keys, BLOCK]).join(whole, keys).where("_points > 1")
    ends = F.col(BLOCK) == F.col("_last")
    rows = walked.select(*keys, "_after", "_entry", ends.alias("_ends"), F.arrays_zip(*columns).alias("_rows"))

    def kept_places(after: pd.Series, entry: pd.Series, is_last: pd.Series) -> pd.Series:
        out = []
        for following, at, last in zip(after, entry, is_last):
            size, kept = len(following), []
            at = size if pd.isna(at) else int(at)
            while at < size:
                kept.append(at)
                at = int(following[at])
            if last and (not kept or kept[-1] != size - 1):
                kept.append(size - 1)
            out.append(kept)
        return pd.Series(out)

    places = F.pandas_udf(kept_places, "array<int>")("_after", "_entry", "_ends")
    kept = rows.select(*keys, F.explode(F.transform(places, lambda i: F.col("_rows")[i])).alias("_row"))
    return kept.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in points.columns if c != BLOCK]).withColumn(BLOCK, F.lit(0).cast("long"))


def thin_points(points: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Drop points closer than the minimum step to the last kept point of their run."""

    def work(df, o):
        if o.blocked:
            return _thin_blocks(df, o)
        return blocks.map_groups(df, list(o.keys), ["t", "seq"], _thin_runs, df.schema)

    return by_group(points, ordering or runs_of_points(), work, hot)


# --- Douglas-Peucker ---------------------------------------------------------------------------------


def _simplify_runs(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Keep the points of many runs that deviate more than the tolerance.

    All open stretches of all runs are measured at once, level by level: a stretch whose farthest
    point (the first of equals) is beyond the tolerance is divided there.
    """
    if not len(rows):
        return rows
    first, last = _bounds(rows, keys)
    lat = rows["lat"].to_numpy()
    narrow = np.repeat(np.cos(np.radians(lat[first])), last - first + 1)
    x, y = rows["lon"].to_numpy() * narrow * C.METERS_PER_DEGREE, lat * C.METERS_PER_DEGREE
    kept = np.zeros(len(rows), bool)
    kept[first] = kept[last] = True
    start, end = first, last
    while (wide := end - start > 1).any():
        start, end = start[wide], end[wide]
        inside = end - start - 1
        begins = np.cumsum(inside) - inside
        stretch = np.repeat(np.arange(len(start)), inside)
        point = np.arange(len(stretch)) - begins[stretch] + start[stretch] + 1
        dx, dy = x[end] - x[start], y[end] - y[start]
        from_x, from_y = x[point] - x[start][stretch], y[point] - y[start][stretch]
        length = np.hypot(dx, dy)
        across = np.abs(dy[stretch] * from_x - dx[stretch] * from_y) / np.where(length > 0, length, 1)[stretch]
        off = np.where(length[stretch] > 0, across, np.hypot(from_x, from_y))
        most = np.maximum.reduceat(off, begins)
        far = np.minimum.reduceat(np.where(off == most[stretch], point, len(rows)), begins)
        divided = most > C.GEOMETRY_TOLERANCE_M
        far, start, end = far[divided], start[divided], end[divided]
        kept[far] = True
        start, end = np.concatenate([start, far]), np.concatenate([far, end])
    return rows[kept]


def _simplify_blocks(points: DataFrame, ordering: Ordering) -> DataFrame:
    """Simplify oversized runs, all open stretches of a level at once.

    Every point finds the kept points around it by a scan; the farthest point of each stretch is
    found by a map-side combined aggregate and is kept from then on.
    """
    keys = list(ordering.keys)
    first = F.struct("t", "seq", "lat", "lon")
    ends = points.groupBy(*keys).agg(F.min(first).alias("_first"), F.max(first).alias("_end"))
    df = points.join(ends, keys)
    df = df.withColumns({
        "_x": F.col("lon") * F.cos(F.radians("_first.lat")) * C.METERS_PER_DEGREE,
        "_y": F.col("lat") * C.METERS_PER_DEGREE,
        "_kept": (first == F.col("_first")) | (first == F.col("_end")),
    }).drop("_first", "_end")
    while True:
        corner = F.when(F.col("_kept"), F.struct("t", "seq", "_x", "_y"))
        df = df.withColumn("_corner", corner)
        df = scan(
            df, ordering, _a=LastKnown(F.col("_corner")), _b=NextKnown(F.col("_corner"))
        )
        dx, dy = F.col("_b._x") - F.col("_a._x"), F.col("_b._y") - F.col("_a._y")
        from_x, from_y = F.col("_x") - F.col("_a._x"), F.col("_y") - F.col("_a._y")
        length = F.hypot(dx, dy)
        off = F.when(length > 0, F.abs(dy * from_x - dx * from_y) / length).otherwise(
            F.hypot(from_x, from_y)
        )
        df = durable(df.withColumn("_off", F.when(~F.col("_kept"), off)))
        rank = F.struct(F.col("_off"), (-F.col("t")).alias("nt"), (-F.col("seq")).alias("ns"))
        farthest = (
            df.where(F.col("_off") > C.GEOMETRY_TOLERANCE_M)
            .groupBy(*keys, "_a").agg(F.max(rank).alias("_far"))
            .select(*keys, (-F.col("_far.nt")).alias("t"), (-F.col("_far.ns")).alias("seq"), F.lit(True).alias("_new"))
        )
        farthest = durable(farthest)
        if farthest.isEmpty():
            return df.where("_kept").select(*points.columns)
        df = df.drop("_corner", "_a", "_b", "_off").join(farthest, [*keys, "t", "seq"], "left")
        df = df.withColumn("_kept", F.col("_kept") | F.coalesce("_new", F.lit(False))).drop("_new")


def simplify_points(points: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Drop the points of each run that stay within the tolerance of the simplified line."""

    def work(df, o):
        if o.blocked:
            return _simplify_blocks(df, o)
        return blocks.map_groups(df, list(o.keys), ["t", "seq"], _simplify_runs, df.schema)

    return by_group(points, ordering or runs_of_points(), work, hot)


def simplify_routes(samples: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Simplified geometry of all trips as rows ``(trip_id, run, pos, lat, lon)``."""
    hot = hot or blocks.find_hot_keys(samples, ("trip_id",))
    points, o = route_points(samples, ordering, hot), runs_of_points()
    run_hot = blocks.narrower(hot) or blocks.find_hot_keys(points, o.keys)

    def both(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        return _simplify_runs(_thin_runs(rows, keys), keys)

    def work(df, order):
        if order.blocked:
            return _simplify_blocks(_thin_blocks(df, order), order)
        return blocks.map_groups(df, list(order.keys), ["t", "seq"], both, df.schema)

    simplified = by_group(points, o, work, run_hot)
    numbered = by_group(
        simplified, o, lambda d, order: scan(d, order, _n=RunningSum(F.lit(1))), run_hot
    )
    return numbered.select(
        "trip_id", "run", (F.col("_n") - 1).cast("int").alias("pos"), "lat", "lon"
    )


def nest_geometry(geometry: DataFrame) -> DataFrame:
    """One row per trip with its runs as nested arrays, for the geometry document."""
    point = F.struct("pos", "lat", "lon")
    runs = geometry.groupBy("trip_id", "run").agg(
        F.transform(
            F.array_sort(F.collect_list(point)), lambda p: F.struct(p["lat"], p["lon"])
        ).alias("points")
    )
    return runs.groupBy("trip_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("run", "points"))), lambda r: r["points"]
        ).alias("runs")
    )


def coverage_dots(geometry: DataFrame) -> DataFrame:
    """The middle point of the longest run of each trip (the first of equally long ones)."""
    sizes = geometry.groupBy("trip_id", "run").agg(F.count(F.lit(1)).alias("points"))
    longest = sizes.groupBy("trip_id").agg(
        F.max_by(F.struct("run", "points"), F.struct("points", -F.col("run"))).alias("_run")
    )
    middle = longest.select(
        "trip_id", F.col("_run.run").alias("run"), F.floor(F.col("_run.points") / 2).cast("int").alias("pos")
    )
    return geometry.join(middle, ["trip_id", "run", "pos"]).select("trip_id", "lat", "lon")


# --- heatmap -----------------------------------------------------------------------------------------


def reference_lat(geometry: DataFrame) -> float:
    """Latitude of the first point of the first trip, which fixes the cell width."""
    row = geometry.agg(F.min_by("lat", F.struct("trip_id", "run", "pos")).alias("lat")).first()
    return row["lat"] if row["lat"] is not None else 0.0


def trip_cells(geometry: DataFrame, at_lat: float, hot=None) -> DataFrame:
    """The distinct ground cells each trip passes through."""
    cell_lat = C.HEAT_CELL_M / C.HEAT_METERS_PER_DEGREE
    cell_lon = cell_lat / math.cos(at_lat * math.pi / 180)
    by_pos = Ordering(("trip_id", "run"), ("pos",), "pos", 50_000)
    legs = by_group(
        geometry, by_pos, lambda d, o: scan(d, o, _to=Following(F.struct("lat", "lon"))), hot
    ).where(F.col("_to").isNotNull())
    d_lat, d_lon = F.col("_to.lat") - F.col("lat"), F.col("_to.lon") - F.col("lon")
    along = F.greatest(F.abs(d_lat) / F.lit(cell_lat), F.abs(d_lon) / F.lit(cell_lon))
    legs = legs.withColumn("_steps", F.greatest(F.lit(1), F.ceil(along * 2).cast("int")))
    walked = legs.withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    share = F.col("_step") / F.col("_steps")
    return walked.select(
        "trip_id",
        F.floor((F.col("lat") + d_lat * share) / F.lit(cell_lat)).alias("row"),
        F.floor((F.col("lon") + d_lon * share) / F.lit(cell_lon)).alias("column"),
    ).distinct()


def heat_cells(geometry: DataFrame, at_lat: float) -> DataFrame:
    """Trips per ground cell; a trip counts once however long it stayed."""
    return trip_cells(geometry, at_lat).groupBy("row", "column").agg(
        F.count(F.lit(1)).alias("trips")
    )


def heat_points(cells: DataFrame, zoom: int, at_lat: float) -> DataFrame:
    """Cells merged for a zoom level, with the opacity of their count on a log scale."""
    cell_lat = C.HEAT_CELL_M / C.HEAT_METERS_PER_DEGREE
    cell_lon = cell_lat / math.cos(at_lat * math.pi / 180)
    meters_per_pixel = (
        C.EARTH_CIRCUMFERENCE_M * math.cos(at_lat * math.pi / 180) / (C.WORLD_WIDTH_PX * 2**zoom)
    )
    merge = max(1, math.floor(C.HEAT_RADIUS_PX / 2 * meters_per_pixel / C.HEAT_CELL_M))
    # A single number: the busiest cell, at least the smallest scale.
    busiest = cells.agg(F.max("trips")).first()[0] or 0
    scale = math.log(max(C.HEAT_MIN_SCALE_COUNT, busiest))
    merged = cells.groupBy(
        F.floor(F.col("row") / merge).alias("row"), F.floor(F.col("column") / merge).alias("column")
    ).agg(F.max("trips").alias("trips"))
    level = C.HEAT_MIN_LEVEL + (1 - C.HEAT_MIN_LEVEL) * (F.log("trips") / F.lit(scale))
    return merged.select(
        "row", "column", "trips",
        ((F.col("row") + 0.5) * merge * F.lit(cell_lat)).alias("lat"),
        ((F.col("column") + 0.5) * merge * F.lit(cell_lon)).alias("lon"),
        (1 - F.pow(1 - level, F.lit(1 / C.HEAT_OVERLAP))).alias("opacity"),
    )
