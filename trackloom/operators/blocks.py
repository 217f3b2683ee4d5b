"""Ordered per-group computations that survive very large groups.

Most operators of this library look at the rows of a trip in order. A plain window does that
well: one shuffle by trip, one sort. But a window puts a whole trip into one task, so a trip
holding a large part of all rows would stall the job. Therefore every ordered operator here is
written once, against ``scan``, and can run in two ways:

* plain: the window is partitioned by the group keys;
* blocked: the group is cut into blocks of consecutive rows. Each block is processed on its own
  and summarized to one row; only these summaries are windowed over the whole group, and what
  is carried into each block (running totals, last known values) is joined back.

``by_group`` counts the rows per group, sends ordinary groups the plain way and only oversized
ones the blocked way. The results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.session import durable

# Groups with more rows than this are processed in blocks (a 12 h video at 1 Hz has 43,200).
MAX_GROUP_ROWS = 200_000
# Up to this many oversized keys are sent to the tasks as a broadcast table.
MAX_BROADCAST_KEYS = 100_000

BLOCK = "_block"
# The block of rows without a position.
NO_POSITION = -(2**62)


@dataclass(frozen=True)
class Ordering:
    """Group keys, the order inside a group, and how a group can be cut into blocks.

    ``position`` is a SQL expression that never decreases along the order; rows are in one
    block when their positions fall into the same ``span``.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    position: str
    span: float
    blocked: bool = False

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, BLOCK) if self.blocked else self.keys

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the block number, when blocks are used.

        Rows without a position sort first, so they share a block before all others.
        """
        if not self.blocked:
            return df
        block = F.floor(F.expr(self.position) / F.lit(self.span)).cast("long")
        return df.withColumn(BLOCK, F.coalesce(block, F.lit(NO_POSITION)))

    def rows(self, last: int = 0):
        """Window over the rows of the partition up to an offset from the current row."""
        return self.window().rowsBetween(Window.unboundedPreceding, last)

    def window(self, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.partition).orderBy(*order)

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])


def trips(span_s: float = 16384, **options) -> Ordering:
    """Samples of a trip in video order. A block covers a few hours of video."""
    return Ordering(("trip_id",), ("t", "seq"), "t", span_s, **options)


# --- scan specifications ----------------------------------------------------------------------


class Spec:
    """One output column of a scan. Blocks are combined through ``edge`` and ``carry``."""

    def __init__(self, value: Column):
        self.value = value

    def edge(self, ordering: Ordering) -> Column:
        """Aggregate of one block."""
        raise NotImplementedError

    def carry(self, edge: Column, keys: tuple[str, ...]) -> Column:
        """What the other blocks of the group contribute, as a window over the edges."""
        raise NotImplementedError

    def local(self, ordering: Ordering) -> Column:
        """The value inside the partition."""
        raise NotImplementedError

    def merge(self, local: Column, carried: Column) -> Column:
        raise NotImplementedError


class RunningSum(Spec):
    """Sum up to and including the current row."""

    def local(self, ordering):
        return F.sum(self.value).over(ordering.rows())

    def edge(self, ordering):
        return F.sum(self.value)

    def carry(self, edge, keys):
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return F.sum(edge).over(before)

    def merge(self, local, carried):
        return F.when(carried.isNull(), local).otherwise(
            carried + F.coalesce(local, F.lit(0))
        )


class RunningMax(Spec):
    """The largest value before the current row."""

    def local(self, ordering):
        return F.max(self.value).over(ordering.rows(-1))

    def edge(self, ordering):
        return F.max(self.value)

    def carry(self, edge, keys):
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return F.max(edge).over(before)

    def merge(self, local, carried):
        return F.greatest(local, carried)


class LastKnown(Spec):
    """The latest non-null value before the current row (or including it)."""

    def __init__(self, value: Column, inclusive: bool = False):
        super().__init__(value)
        self.inclusive = inclusive

    def local(self, ordering):
        return F.last(self.value, ignorenulls=True).over(ordering.rows(0 if self.inclusive else -1))

    def edge(self, ordering):
        return F.max_by(F.struct(self.value.alias("v")), _order_if_known(self.value, ordering))

    def carry(self, edge, keys):
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(edge, ignorenulls=True).over(before)

    def merge(self, local, carried):
        return F.coalesce(local, carried["v"])


class NextKnown(LastKnown):
    """The earliest non-null value after the current row (or including it)."""

    def local(self, ordering):
        window = ordering.window(descending=True).rowsBetween(
            Window.unboundedPreceding, 0 if self.inclusive else -1
        )
        return F.last(self.value, ignorenulls=True).over(window)

    def edge(self, ordering):
        return F.min_by(F.struct(self.value.alias("v")), _order_if_known(self.value, ordering))

    def carry(self, edge, keys):
        after = (
            Window.partitionBy(*keys)
            .orderBy(F.col(BLOCK).desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.last(edge, ignorenulls=True).over(after)


class Previous(Spec):
    """The value of the row before, null or not."""

    def local(self, ordering):
        return F.lag(F.struct(self.value.alias("v"))).over(ordering.window())

    def edge(self, ordering):
        return F.max_by(F.struct(self.value.alias("v")), ordering.order_key())

    def carry(self, edge, keys):
        return F.lag(edge).over(Window.partitionBy(*keys).orderBy(BLOCK))

    def merge(self, local, carried):
        return F.coalesce(local, carried)["v"]


class Following(Previous):
    """The value of the row after, null or not."""

    def local(self, ordering):
        return F.lead(F.struct(self.value.alias("v"))).over(ordering.window())

    def edge(self, ordering):
        return F.min_by(F.struct(self.value.alias("v")), ordering.order_key())

    def carry(self, edge, keys):
        return F.lead(edge).over(Window.partitionBy(*keys).orderBy(BLOCK))


class GroupTotal(Spec):
    """An aggregate over the whole group that is combined by itself (sum, min, max)."""

    def __init__(self, value: Column, function=F.sum):
        super().__init__(value)
        self.function = function

    def local(self, ordering):
        # in the order of the other scans, so that the rows are sorted once for all of them
        whole = ordering.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self.function(self.value).over(whole)

    def edge(self, ordering):
        return self.function(self.value)

    def carry(self, edge, keys):
        return self.function(edge).over(Window.partitionBy(*keys))

    def merge(self, local, carried):
        return carried


def _order_if_known(value: Column, ordering: Ordering) -> Column:
    return F.when(value.isNotNull(), ordering.order_key())


def scan(df: DataFrame, ordering: Ordering, **specs: Spec) -> DataFrame:
    """Add one column per specification, computed along the order of each group."""
    if not ordering.blocked:
        columns = {name: spec.local(ordering) for name, spec in specs.items()}
        # `lag` and `lead` yield wrapped values, so that nulls stay distinct from "no row".
        for name, spec in specs.items():
            if isinstance(spec, Previous):
                columns[name] = columns[name]["v"]
        return df.withColumns(columns)

    # A group of any size: the rows are cut by block, and only one row per block goes through
    # a window over the whole group.
    df = durable(df)
    edges = df.groupBy(*ordering.partition).agg(
        *[spec.edge(ordering).alias(f"_edge_{name}") for name, spec in specs.items()]
    )
    carried = edges.select(
        *ordering.partition,
        *[
            spec.carry(F.col(f"_edge_{name}"), ordering.keys).alias(f"_carry_{name}")
            for name, spec in specs.items()
        ],
    )
    local = df.withColumns({
        f"_local_{name}": spec.local(ordering)
        for name, spec in specs.items()
        if not isinstance(spec, GroupTotal)
    })
    joined = local.join(carried, list(ordering.partition))
    return joined.select(
        *df.columns,
        *[
            spec.merge(
                F.lit(None) if isinstance(spec, GroupTotal) else F.col(f"_local_{name}"),
                F.col(f"_carry_{name}"),
            ).alias(name)
            for name, spec in specs.items()
        ],
    )


def neighborhood(
    df: DataFrame, ordering: Ordering, before: float, after: float,
    columns: Callable[[Callable], dict[str, Column]],
) -> DataFrame:
    """Add window columns that look a bounded distance around each row.

    ``columns`` gets a function that makes the window, either over rows or, with ``ranged``,
    for range frames over the position in whole thousandths. In blocked mode the rows within
    ``before`` and ``after`` of a block are shown to it as well, and dropped again.
    """
    df = df.withColumn("_ms", F.round(F.expr(ordering.position) * 1000).cast("long"))
    keys = ordering.keys
    if ordering.blocked:
        own = F.col(BLOCK)
        inside = F.expr(ordering.position) - own * F.lit(ordering.span)
        shown = F.array(
            own,
            F.when(inside <= F.lit(after), own - 1),
            F.when(inside >= F.lit(ordering.span - before), own + 1),
        )
        df = df.withColumn("_shown", F.explode(F.filter(shown, lambda b: b.isNotNull())))
        keys = (*keys, "_shown")

    def window(ranged: bool = False):
        return Window.partitionBy(*keys).orderBy(*(["_ms"] if ranged else ordering.order))

    out = df.withColumns(columns(window))
    if ordering.blocked:
        out = out.where(F.col("_shown") == F.col(BLOCK)).drop("_shown")
    return out.drop("_ms")


# --- choosing the way ---------------------------------------------------------------------------


@dataclass(frozen=True)
class HotKeys:
    """Keys of the oversized groups. ``keys`` is None when there are none."""

    keys: DataFrame | None = None
    bounded: bool = True

    def restrict(self, df: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
        keys = F.broadcast(self.keys) if self.bounded else self.keys
        return df.join(keys, list(names), how)


NO_HOT_KEYS = HotKeys()


def find_hot_keys(df: DataFrame, keys: tuple[str, ...], max_rows: int | None = None) -> HotKeys:
    """Find the groups with more than ``max_rows`` rows.

    The count is a map-side combined aggregate over the key columns alone. At most
    ``MAX_BROADCAST_KEYS`` keys come to the driver; a longer list stays a table.
    """
    limit = MAX_GROUP_ROWS if max_rows is None else max_rows
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    found = hot.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not found:
        return NO_HOT_KEYS
    if len(found) > MAX_BROADCAST_KEYS:
        return HotKeys(durable(hot), bounded=False)
    return HotKeys(df.sparkSession.createDataFrame(found, hot.schema))


def narrower(hot: HotKeys) -> HotKeys | None:
    """What is known about finer groups: none is oversized when no coarser one is."""
    return hot if hot.keys is None else None


def by_group(
    df: DataFrame,
    ordering: Ordering,
    work: Callable[[DataFrame, Ordering], DataFrame],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Run ``work`` the plain way on ordinary groups and in blocks on oversized ones."""
    if ordering.blocked:
        return work(ordering.cut(df), ordering)
    if hot is None:
        hot = find_hot_keys(df, ordering.keys)
    if hot.keys is None:
        return work(df, ordering)
    blocked = replace(ordering, blocked=True)
    ordinary = work(hot.restrict(df, ordering.keys, "left_anti"), ordering)
    oversized = work(blocked.cut(hot.restrict(df, ordering.keys, "left_semi")), blocked)
    return ordinary.unionByName(oversized.drop(BLOCK))


def map_groups(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame, list[str]], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``work(rows, keys)`` to batches of whole groups, many small groups at a time.

    Rows are shuffled by key and sorted by key and ``order``; the last, possibly unfinished group of
    a batch waits for the next one. A group must fit into memory; a batch holds little more.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            if not len(batch):
                continue
            values = batch[keys].to_numpy()
            cut = len(batch) - 1
            while cut > 0 and (values[cut - 1] == values[-1]).all():
                cut -= 1
            if waiting and (cut or not (waiting[-1][keys].to_numpy()[-1] == values[0]).all()):
                yield work(pd.concat([*waiting, batch.iloc[:cut]], ignore_index=True), keys)
                waiting = []
            elif cut:
                yield work(batch.iloc[:cut].reset_index(drop=True), keys)
            waiting.append(batch.iloc[cut:])
        if waiting:
            yield work(pd.concat(waiting, ignore_index=True), keys)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
