"""Hashes over the texts of a group in order, whatever the group's length.

A hash is a fold: its state goes from line to line, so the lines of one group must meet in order. They
never meet in memory. Blocks of a group join their lines to short pieces in parallel, each walking its
sorted rows; the pieces of a group are then sorted and streamed through the hash, whose state is all
that is kept from batch to batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of one joined piece. Pieces are small so that any batch of them is.
PIECE_BYTES = 4096

Batches = Iterator[pa.RecordBatch]


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key differs from the row before; nulls are equal to each other."""
    size = len(columns[0])
    new = np.zeros(size, bool)
    for column in columns:
        before, after = column.slice(0, size - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False)
        differ = pc.or_(differ, pc.xor(pc.is_null(before), pc.is_null(after)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def _join_lines(batches: Batches) -> Batches:
    """Pieces ``(group, block, piece, text)`` of rows ``(group, block, line)`` sorted by both keys."""
    last, number = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = batch.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
        data = memoryview(lines.buffers()[2])
        starts = np.flatnonzero(changes([batch.column(0), batch.column(1)]))
        rows, numbers, texts = [], [], []
        for begin, end in zip([0, *starts], [*starts, len(lines)]):
            key = (batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py())
            if key != last:
                last, number = key, 0
            while begin < end:
                # as many whole lines as fit, one at least
                cut = max(begin + 1, min(end, int(np.searchsorted(offsets, offsets[begin] + PIECE_BYTES, "right")) - 1))
                rows.append(begin)
                numbers.append(number)
                texts.append(data[offsets[begin] : offsets[cut]].tobytes())
                begin, number = cut, number + 1
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())],
            ["group", "block", "piece", "text"],
        )


def _hash_pieces(batches: Batches) -> Batches:
    """``(group, digest)`` of pieces ``(group, text)`` sorted by group and place."""
    state, group = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes([batch.column(0)])
        new[0] = state is None or batch.column(0)[0] != group
        groups, digests = [], []
        for row, text in enumerate(batch.column(1)):
            if new[row]:
                if state is not None:
                    groups.append(group.as_py())
                    digests.append(state.hexdigest())
                state, group = hashlib.sha256(), batch.column(0)[row]
            state.update(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.field(0).type), pa.array(digests, pa.string())], ["group", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group.as_py()], group.type), pa.array([state.hexdigest()], pa.string())], ["group", "digest"])


def hash_lines(df: DataFrame, group: str, order: tuple[str, ...], line: Column, block: Column) -> DataFrame:
    """``(group, digest)``: the SHA-256 of all lines of each group, in order and without anything between.

    ``block`` never decreases along the order and cuts a long group into parts that different tasks join.
    Groups without rows do not appear; null lines count as empty.
    """
    kind = dict(df.dtypes)[group]
    rows = df.select(
        F.col(group).alias("group"), block.cast("long").alias("block"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.coalesce(line, F.lit("")).alias("line"),
    )
    rows = rows.repartition("group", "block").sortWithinPartitions("group", "block", *[f"_o{i}" for i in range(len(order))])
    pieces = rows.select("group", "block", "line").mapInArrow(_join_lines, f"group {kind}, block long, piece long, text binary")
    pieces = pieces.repartition("group").sortWithinPartitions("group", "block", "piece").select("group", "text")
    return pieces.mapInArrow(_hash_pieces, f"group {kind}, digest string").withColumnRenamed("group", group)
