"""The heaviest chain of mutually reachable segments of a trip, whatever their number.

The best chain that ends with a segment depends on all segments before it, so the choice itself is a
fold. What costs time is whether one segment can be reached from another, and that depends on nothing
else: pairs of blocks of segments are tested in parallel and leave a bit per pair of segments. The fold
then walks the blocks of a trip in order, with the best totals so far as its state, and takes the best
reachable predecessors of a whole block from its bits at once. One way for trips of any size: a short
trip is a single pair of blocks.

Nothing on earth is further than about 80 hours away at the highest speed. Blocks that ended longer
ago are reachable as a whole and are not paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as C
from trackloom.session import durable

# Segments of one block. The bits of a pair of blocks take 128 KB.
BLOCK_SEGMENTS = 1024
# Nothing is further away than this many seconds at the highest speed.
ALWAYS_REACHABLE_S = float(np.pi * C.EARTH_RADIUS_M / (C.MAX_SPEED_KMH / 3.6) + 1)

Batches = Iterator[pa.RecordBatch]
_FIX = ("t", "s", "lat", "lon")


def reachable(start: dict[str, np.ndarray], end: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the car could get from the starts (columns) to the ends (rows).

    The time is that of the video, or that of the clocks if both are trusted and show a gap of up to
    12 hours more.
    """
    video_s = np.maximum(1.0, end["t"][:, None] - start["t"])
    clock_s = end["s"][:, None] - start["s"]
    with np.errstate(invalid="ignore"):
        uses_clock = (clock_s >= video_s - C.CLOCK_JITTER_S) & (clock_s <= video_s + C.MAX_MERGE_GAP_S)
        duration = np.where(uses_clock, np.maximum(video_s, clock_s), video_s)
    lat_a, lat_b = np.radians(start["lat"]), np.radians(end["lat"])[:, None]
    dlon = np.radians(end["lon"][:, None] - start["lon"])
    a = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin(dlon / 2) ** 2
    distance = 2 * C.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))
    return distance / duration * 3.6 <= C.MAX_SPEED_KMH


def _fixes(row: dict, side: str) -> dict[str, np.ndarray]:
    return {name: np.asarray([np.nan if v is None else v for v in row[f"{side}_{name}"]], float) for name in _FIX}


def _test_pairs(batches: Batches) -> Batches:
    """The bits of each pair of blocks: a row per later segment, a column per earlier one."""
    for batch in batches:
        bits = []
        for row in batch.select([f"{s}_{n}" for s in ("last", "first") for n in _FIX]).to_pylist():
            bits.append(np.packbits(reachable(_fixes(row, "last"), _fixes(row, "first"))).tobytes())
        keys = [batch.column(n) for n in ("trip_id", "block", "before")]
        # only the pair of a block with itself passes on what it holds
        own = pc.equal(keys[1], keys[2])
        held = [pc.if_else(own, batch.column(n), pa.scalar(None, batch.schema.field(n).type)) for n in ("segments", "weights")]
        sizes = pc.list_value_length(batch.column("segments")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*keys, sizes, *held, pa.array(bits, pa.binary())], ["trip_id", "block", "before", "size", "segments", "weights", "bits"]
        )


class Fold:
    """The best chains of one trip up to the current block."""

    def __init__(self) -> None:
        self.totals: list[np.ndarray] = []
        self.origins: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.starts = [0]
        self.places: dict[int, int] = {}
        # of all blocks before each: the best total, and the earliest segment that has it
        self.best = [(0, -1)]
        self.top, self.origin = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, block: int, before: int, size: int, segments: list[int] | None, weights: list[int] | None, bits: bytes) -> None:
        """Take in one pair; the pairs of a block come by earlier block, the block itself last."""
        place = self.places.setdefault(block, len(self.places))
        earlier = self.places[before]
        if len(self.top) == 0:
            # blocks too long ago to be paired are reachable as a whole
            total, at = self.best[earlier]
            self.top, self.origin = np.full(size, total), np.full(size, at)
        wide = size if earlier == place else len(self.totals[earlier])
        can = np.unpackbits(np.frombuffer(bits, np.uint8), count=size * wide).reshape(size, wide).astype(bool)
        if earlier < place:
            found = np.where(can, self.totals[earlier], 0)
            at = found.argmax(axis=1)
            most = found[np.arange(size), at]
            better = most > self.top
            self.top[better], self.origin[better] = most[better], self.starts[earlier] + at[better]
            return
        weights, total = np.asarray(weights, np.int64), np.zeros(size, np.int64)
        for i in range(size):
            if i:
                found = np.where(can[i, :i], total[:i], 0)
                at = int(found.argmax())
                if found[at] > self.top[i]:
                    self.top[i], self.origin[i] = found[at], self.starts[place] + at
            total[i] = self.top[i] + weights[i]
        self.totals.append(total)
        self.origins.append(self.origin)
        self.numbers.append(np.asarray(segments, np.int64))
        self.starts.append(self.starts[-1] + size)
        most, at = self.best[-1]
        highest = int(total.argmax())
        self.best.append((int(total[highest]), self.starts[place] + highest) if total[highest] > most else (most, at))
        self.top, self.origin = np.empty(0, np.int64), np.empty(0, np.int64)

    def chain(self) -> np.ndarray:
        """Numbers of the segments of the heaviest chain; of equal ends the earliest."""
        numbers, origins = np.concatenate(self.numbers), np.concatenate(self.origins)
        kept, at = [], self.best[-1][1]
        while at >= 0:
            kept.append(at)
            at = int(origins[at])
        return numbers[kept]


def _fold_blocks(batches: Batches) -> Batches:
    """Chains of trips whose pairs come in order; the state of one trip is kept between batches."""
    fold, trip = None, None
    kind = None

    def finish() -> pa.RecordBatch:
        chain = fold.chain()
        return pa.RecordBatch.from_arrays([pa.array([trip] * len(chain), kind), pa.array(chain)], ["trip_id", "segment"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in range(batch.num_rows):
            number, *pair = (batch.column(i)[row].as_py() for i in range(7))
            if fold is None or number != trip:
                if fold is not None:
                    yield finish()
                fold, trip = Fold(), number
            fold.add(*pair)
    if fold is not None:
        yield finish()


def _flat(side: str) -> list[Column]:
    fix = F.col(side)
    values = (fix["t"], F.unix_micros(fix["instant"]) / 1e6, fix["lat"], fix["lon"])
    return [v.cast("double").alias(f"{side}_{n}") for n, v in zip(_FIX, values)]


def deal_pairs(pairs: DataFrame) -> DataFrame:
    """Spread the pairs of every trip over all tasks; few bytes make much work, so tasks stay as they are."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "trip_id", "block", "before")


def select_chain(segments: DataFrame, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """Keep the time-ordered chain of mutually reachable segments with the most fixes.

    ``segments``: ``trip_id, segment, weight, first, last``. Of equally heavy chains the one that is
    earliest, from its end backwards.
    """
    trip_type = dict(segments.dtypes)["trip_id"]
    counts = segments.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_count"), F.min("segment").cast("long").alias("segment"))
    # a single segment is its own chain
    alone = counts.where("_count = 1").select("trip_id", "segment")
    several = segments.join(counts.where("_count > 1").select("trip_id"), "trip_id", "left_semi")
    row = F.struct(F.col("segment").cast("long").alias("segment"), F.col("weight").cast("long").alias("weight"), *_flat("first"), *_flat("last"))
    packed = several.groupBy("trip_id", F.floor(F.col("segment") / block_segments).alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    names = [f"{side}_{n}" for side in ("first", "last") for n in _FIX]
    packed = durable(packed.select(
        "trip_id", "block", F.col("rows.segment").alias("segments"), F.col("rows.weight").alias("weights"),
        *[F.col(f"rows.{n}").alias(n) for n in names],
    ).withColumns({"begins": F.array_min("first_t"), "ends": F.array_max("last_t")}))
    # only the times of blocks are compared to pair them; the rows of a block follow by its key
    times = packed.select("trip_id", "block", "begins", "ends")
    before = times.select("trip_id", F.col("block").alias("before"), F.col("ends").alias("ended"))
    pairs = times.join(before, "trip_id").where(
        (F.col("before") <= F.col("block")) & ((F.col("ended") >= F.col("begins") - ALWAYS_REACHABLE_S) | (F.col("before") == F.col("block")))
    ).select("trip_id", "block", "before")
    ends = packed.select("trip_id", "block", "segments", "weights", *[n for n in names if n.startswith("first")])
    starts = packed.select("trip_id", F.col("block").alias("before"), *[n for n in names if n.startswith("last")])
    paired = pairs.join(ends, ["trip_id", "block"]).join(starts, ["trip_id", "before"])
    tested = deal_pairs(paired.select("trip_id", "block", "before", "segments", "weights", *names)).mapInArrow(
        _test_pairs, f"trip_id {trip_type}, block long, before long, size long, segments array<long>, weights array<long>, bits binary"
    )
    walked = tested.repartition("trip_id").sortWithinPartitions("trip_id", "block", "before")
    return alone.unionByName(walked.mapInArrow(_fold_blocks, f"trip_id {trip_type}, segment bigint"))
