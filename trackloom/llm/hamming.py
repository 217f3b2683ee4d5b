"""Exact top-k search for binary codes: incremental multi-index hashing.

A code is cut into segments, each with an index of the codes by segment value. If two codes differ
in at most r bits, some segment differs in few: the search radius grows one bit at a time, each step
probing one segment's index at one more bit (step r probes segment r mod m at exactly r div m
differing bits), and after step r every code within r bits was met. A query stops when its k-th
verified distance is at most r: then nothing outside can be nearer or tie.

Distinct codes are cut into blocks, and so are distinct query codes; every pair of blocks is searched
exactly on its own and the lists are merged. Codes shared by many rows are searched once.

Codes are the signs of the first 64 components (1 where positive); vectors of each length are searched
by themselves. Ties in distance go to the smaller
id. Invalid vectors take no part (see ``valid_vectors``). An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import bounded_batches, stored
from trackloom.llm.similarity import by_group
from trackloom.llm.vectors import each_length, ranked, valid_vectors, with_copies

BITS = 64
BLOCK = 16_384
QUERY_BLOCK = 4_096
#: Tasks that the pairs of blocks are spread over at most; a task takes pairs of the same codes together.
TASKS = 8_192
#: Values of one vectorised probe at most, so that memory stays bounded.
PROBES = 2_000_000


def sign_code(embedding: str) -> Column:
    """The signs of a vector's first 64 components as one long, the first component the lowest bit."""
    bits = F.transform(F.slice(embedding, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


class MultiIndex:
    """Segment indexes over the distinct codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        size = max(1, int(np.log2(max(len(codes), 2))))
        count = -(-BITS // size)
        edges = np.linspace(0, BITS, count + 1).astype(int)
        self.shifts = edges[:-1].astype(np.uint64)
        self.widths = np.diff(edges)
        self.masks = [np.uint64((1 << int(w)) - 1) for w in self.widths]
        self.orders, self.offsets = [], []
        for shift, mask, width in zip(self.shifts, self.masks, self.widths):
            values = (codes >> shift) & mask
            self.orders.append(np.argsort(values, kind="stable"))
            self.offsets.append(np.concatenate([[0], np.cumsum(np.bincount(values.astype(np.int64), minlength=1 << int(width)))]))
        self._flips: dict[tuple[int, int], np.ndarray] = {}

    def flips(self, width: int, bits: int) -> np.ndarray:
        """All segment values with so many bits set."""
        if (width, bits) not in self._flips:
            chosen = [sum(1 << b for b in c) for c in itertools.combinations(range(width), bits)]
            self._flips[width, bits] = np.array(chosen, np.int64)
        return self._flips[width, bits]

    def step(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) positions that step ``radius`` meets for the first time."""
        segment, bits = radius % len(self.widths), radius // len(self.widths)
        flips = self.flips(int(self.widths[segment]), bits)
        out = []
        for at in range(0, len(queries), max(1, PROBES // max(len(flips), 1))):
            part = queries[at : at + max(1, PROBES // max(len(flips), 1))]
            values = ((part >> self.shifts[segment]) & self.masks[segment]).astype(np.int64)
            buckets = (values[:, None] ^ flips[None, :]).ravel()
            low, high = self.offsets[segment][buckets], self.offsets[segment][buckets + 1]
            counts = high - low
            ends = np.cumsum(counts)
            place = np.repeat(low - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
            code = self.orders[segment][place]
            query = np.repeat(np.repeat(np.arange(len(part)), len(flips)), counts)
            differ = part[query] ^ self.codes[code]
            first = np.ones(len(code), bool)
            for other in range(len(self.widths)):  # met before where another segment was probed that far
                apart = np.bitwise_count((differ >> self.shifts[other]) & self.masks[other])
                if other < segment:
                    first &= apart > bits
                elif other > segment:
                    first &= apart >= bits
            out.append((query[first] + at, code[first], np.bitwise_count(differ[first]).astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and distances of the ``k`` nearest codes of each query, and of all that tie with the last."""
        k = min(k, len(self.codes))
        active = np.arange(len(queries))
        seen = np.zeros((len(queries), BITS + 1), np.int64)
        found, limit = [], np.full(len(queries), BITS)
        for radius in range(BITS + 1):
            if not len(active):
                break
            if radius // len(self.widths) > int(self.widths.max()):
                break
            query, code, distance = self.step(queries[active], radius)
            query = active[query]
            found.append((query, code, distance))
            np.add.at(seen, (query, distance), 1)
            covered = seen[active, : radius + 1].sum(axis=1) >= k
            limit[active[covered]] = radius
            active = active[~covered]
        query, code, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        near = distance <= limit[query]
        query, code, distance = query[near], code[near], distance[near]
        # up to the distance of the k-th: cumulative counts per query
        kth = (np.cumsum(seen, axis=1) < k).sum(axis=1)
        near = distance <= kth[query]
        return query[near], code[near], distance[near]


def packed(codes: DataFrame, id_column: str, block: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``block`` codes, ``(name, ids, codes)`` as packed binary, and their number."""
    count = max(1, -(-codes.count() // block))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            name: [int(rows[name].iloc[0])], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
            "codes": [rows["code"].to_numpy(np.int64).tobytes()],
        })

    spread = codes.select(F.col(id_column).alias("id"), "code").withColumn(name, F.pmod(F.xxhash64("code"), F.lit(count)))
    return stored(by_group(spread, [name], pack, f"{name} long, ids binary, codes binary")), count


def search(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: nearest codes of every row whose id is divisible by ``every``."""
    rows = stored(valid_vectors(vectors).select("vec_id", sign_code("embedding").alias("code"), F.size("embedding").alias("length")))
    return each_length(rows, F.col("length"), lambda own: search_codes(own.select("vec_id", "code"), k, every))


def search_codes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """The search over ``(vec_id, code)`` rows."""
    spark = rows.sparkSession
    copies = stored(with_copies(rows, "code", k))
    reps = copies.where("vec_id = rep").select("rep", "code")
    queries = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(reps, "code").select(
        "query_id", F.col("rep").alias("query_rep"), "code"
    )
    asked = queries.select("query_rep", "code").distinct()
    with bounded_batches(spark):
        row_blocks, count = packed(reps, "rep", BLOCK, "row_block")
        query_blocks, query_count = packed(asked, "query_rep", QUERY_BLOCK, "query_block")
    tasks = min(count * query_count, TASKS)
    # every block of codes meets every block of the stated queries: blocks, not rows, are paired
    number = F.col("row_block") * query_count + F.col("query_block")
    pairs = query_blocks.select(
        F.col("ids").alias("query_ids"), F.col("codes").alias("query_codes"), "query_block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("row_block"),
    ).join(row_blocks, "row_block").select("row_block", "ids", "codes", "query_ids", "query_codes", F.floor(number * tasks / (count * query_count)).cast("int").alias("task"))
    spread = pairs.repartitionById(tasks, F.col("task")).sortWithinPartitions("row_block").drop("task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, index = None, None
        for batch in batches:
            for row in batch.itertuples():
                if row.row_block != block:
                    block, index = row.row_block, MultiIndex(np.frombuffer(row.codes, np.uint64))
                query, code, distance = index.search(np.frombuffer(row.query_codes, np.uint64), k + 1)
                ids = np.frombuffer(row.ids, np.int64)[code]
                # the smallest ids among ties; a list never needs more than k + 1 codes
                order = np.lexsort((ids, distance, query))
                query, distance, ids = query[order], distance[order], ids[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                best = place <= k
                yield pd.DataFrame({
                    "query_rep": np.frombuffer(row.query_ids, np.int64)[query[best]], "rep": ids[best], "distance": distance[best],
                })

    with bounded_batches(spark, rows=8):  # rows are whole blocks
        found = stored(spread.mapInPandas(run, "query_rep long, rep long, distance long"))
    return ranked(found, queries.select("query_id", "query_rep"), copies, k, F.col("distance"), "distance")
