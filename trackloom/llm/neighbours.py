"""Approximate nearest neighbours over shifted space-filling curves, completed exactly.

Vectors are projected to a few dimensions in several random ways, shifted, and ordered by Hilbert
key. Spark range-partitions each ordering; runs of neighbouring keys form windows. A query meets the
windows around its own key on every curve, the lists are merged, and inner products rank them.

Windows alone find a share of the true neighbours that depends on the data (``window_search``; see
the README for measured recall). On directionless vectors it is too low, so an exact check follows:
each window of the first curve has a centre and a radius, which bound the inner products inside it;
windows that may hold something better than a query's k-th find so far are read, all others are not.
The result is exact.

Equal vectors are searched once, and vectors of each length by themselves. Ties go to the smaller id. Invalid vectors take no part (see
``valid_vectors``). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import bounded_batches, stored
from trackloom.llm.similarity import by_group
from trackloom.llm.vectors import each_length, ranked, valid_vectors, with_copies

CURVES = 4
DIMENSIONS = 6
BITS = 9
#: Vectors in one window; a query meets three windows per curve.
WINDOW = 1_024
#: Vectors that the scale of the projections is fitted on.
SAMPLE = 10_000
QUERY_BLOCK = 4_096
SEED = 3
#: Products are compared with this slack before they are computed in one fixed order.
SLACK = 1e-9

KEYED = "curve int, key long, id long, vector binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indexes of integer points (n, d) with ``bits`` bits per axis.

    Works from the highest bit down: each level's cell is turned into its place on the curve by
    undoing the reflection and rotation of the levels above.
    """
    n, d = cells.shape
    axes = [cells[:, i].astype(np.int64).copy() for i in range(d)]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (axes[i] & bit) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(up, low, swap)
            axes[i] ^= swap
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[d - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((axes[i] ^ turn) >> level) & 1)
    return key


def curve_frames(sample: np.ndarray, curves: int = CURVES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, low, span, shift) per curve: orthonormal random directions, scaled on a sample."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    frames = []
    for _ in range(curves):
        directions = np.linalg.qr(rng.standard_normal((width, min(DIMENSIONS, width))))[0]
        values = sample @ directions
        low, high = np.quantile(values, 0.001, axis=0), np.quantile(values, 0.999, axis=0)
        frames.append((directions, low, np.maximum(high - low, 1e-12), rng.uniform(0, 1, directions.shape[1])))
    return frames


def with_keys(reps: DataFrame, frames: list) -> DataFrame:
    """``(curve, key, id, vector)``: every vector once per curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.stack([np.asarray(v, np.float64) for v in batch["embedding"]])
            packed = [row.tobytes() for row in matrix]
            for number, (directions, low, span, shift) in enumerate(frames):
                # the shift moves the grid; half of the range stays free for it
                place = np.clip((matrix @ directions - low) / span, 0, 1) * 0.5 + 0.5 * shift
                cells = np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                yield pd.DataFrame({"curve": number, "key": hilbert_keys(cells, BITS), "id": batch["rep"], "vector": packed})

    return reps.select("rep", "embedding").mapInPandas(run, KEYED)


def windows(keyed: DataFrame) -> DataFrame:
    """Adds ``window``: consecutive numbers per curve of runs of ``WINDOW`` vectors in key order.

    Range partitions are numbered in order; inside one, rows are counted as they pass.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for batch in batches:
            place = np.zeros(len(batch), np.int64)
            for curve, at in batch.groupby("curve").indices.items():
                place[at] = counts.get(curve, 0) + np.arange(len(at))
                counts[curve] = counts.get(curve, 0) + len(at)
            yield batch.assign(piece=place // WINDOW)

    ordered = (
        keyed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
        .withColumn("part", F.spark_partition_id())
    )
    pieces = stored(ordered.mapInPandas(cut, f"{KEYED}, part int, piece long"))
    in_order = Window.partitionBy("curve").orderBy("part", "piece")
    numbers = pieces.select("curve", "part", "piece").distinct().withColumn("window", F.row_number().over(in_order).cast("long"))
    return pieces.join(numbers, ["curve", "part", "piece"]).select("curve", "window", "id", "vector")


def top(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``keep`` largest entries, and of all that are as large but for rounding."""
    keep = min(keep, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return np.nonzero(scores >= least[:, None] - SLACK)


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def window_search(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_rep, rep, score)``: each query's best finds in the windows around it, per curve."""
    around = asked.join(placed, asked["query_rep"] == placed["id"]).select(
        "curve", F.explode(F.array(F.col("window") - 1, F.col("window"), F.col("window") + 1)).alias("window"), "id", "vector",
        F.lit(True).alias("asks"),
    )
    # a query of the window itself is there twice: as a query and as a candidate
    rows = placed.select("curve", "window", "id", "vector", F.lit(False).alias("asks")).unionByName(around)

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        ids = group["id"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_rep": [], "rep": [], "score": []})
        vectors = list(group["vector"])
        own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        candidates = _matrix([vectors[i] for i in others])
        found = []
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            row, column = top(_matrix([vectors[i] for i in part]) @ candidates.T, k + 1)
            scores = (_matrix([vectors[i] for i in part]) @ candidates.T)[row, column]
            found.append(pd.DataFrame({"query_rep": ids[part[row]], "rep": ids[others[column]], "score": scores}))
        return pd.concat(found)

    return by_group(rows, ["curve", "window"], rank, "query_rep long, rep long, score double")


def best_lists(found: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best different finds of each query."""
    order = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    distinct = found.groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    return distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")


def exact_check(placed: DataFrame, asked: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """Finds that may still improve a query's list, from the windows that a bound does not exclude."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(list(group["vector"]))
        centre = matrix.mean(axis=0)
        radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1).max()))
        return pd.DataFrame({
            "window": [int(group["window"].iloc[0])], "ids": [group["id"].to_numpy(np.int64).tobytes()],
            "vectors": [matrix.tobytes()], "centre": [centre.tobytes()], "radius": [radius],
        })

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "query_ids": [group["id"].to_numpy(np.int64).tobytes()], "query_vectors": [b"".join(group["vector"])],
            "query_bounds": [group["bound"].to_numpy(np.float64).tobytes()],
        })

    first = placed.where("curve = 0")
    boxes = stored(by_group(first, ["window"], pack, "window long, ids binary, vectors binary, centre binary, radius double"))
    questions = asked.join(first, asked["query_rep"] == first["id"]).join(bounds, "query_rep", "left").select(
        "id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")
    )
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = stored(by_group(
        questions.withColumn("_group", F.pmod(F.xxhash64("id"), F.lit(groups))), ["_group"], pack_queries,
        "query_ids binary, query_vectors binary, query_bounds binary",
    ))
    last = boxes.agg(F.coalesce(F.max("window"), F.lit(1))).first()[0]
    # every block of the stated queries meets every window: blocks, not rows, are paired
    pairs = packed.withColumn("window", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long")))).join(boxes, "window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, asks = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                vectors = np.frombuffer(row.vectors, np.float64).reshape(len(ids), -1)
                queries = np.frombuffer(row.query_vectors, np.float64).reshape(len(asks), -1)
                bounds = np.frombuffer(row.query_bounds, np.float64) - SLACK
                most = queries @ np.frombuffer(row.centre, np.float64) + np.sqrt((queries**2).sum(axis=1)) * row.radius
                reads = np.flatnonzero(most >= bounds)
                for at in range(0, len(reads), 512):
                    part = reads[at : at + 512]
                    scores = queries[part] @ vectors.T
                    q, c = top(scores, k + 1)
                    good = scores[q, c] >= bounds[part[q]]
                    q, c = q[good], c[good]
                    yield pd.DataFrame({"query_rep": asks[part[q]], "rep": ids[c], "score": scores[q, c]})

    with bounded_batches(placed.sparkSession, rows=8):  # rows are whole blocks
        return stored(pairs.drop("window").mapInPandas(run, "query_rep long, rep long, score double"))


def search(vectors: DataFrame, k: int, every: int, exact: bool = True) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: nearest vectors of every row whose id is divisible by ``every``.

    With ``exact=False`` the windows' finds are ranked as they are.
    """
    rows = stored(valid_vectors(vectors))
    with bounded_batches(vectors.sparkSession):
        return each_length(rows, F.size("embedding"), lambda own: search_vectors(own, k, every, exact))


def search_vectors(rows: DataFrame, k: int, every: int, exact: bool) -> DataFrame:
    """The search over valid ``(vec_id, embedding)`` rows of one length."""
    copies = stored(with_copies(rows, "embedding", k))
    reps = copies.where("vec_id = rep").select("rep", "embedding")
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").collect()
    queries = stored(rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(reps, "embedding").select(
        "query_id", F.col("rep").alias("query_rep")
    ))
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = queries.select("query_rep").distinct()
    frames = curve_frames(np.array([r["embedding"] for r in sample], np.float64))
    placed = stored(windows(with_keys(reps, frames)))
    found = stored(best_lists(window_search(placed, asked, k), k))
    if exact:
        bounds = found.groupBy("query_rep").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") > k).drop("n")
        found = best_lists(found.unionByName(exact_check(placed, asked, bounds, k)), k + 5)
    # the final products in one fixed order of summation
    vector_of = reps.select("rep", "embedding")
    scored = (
        found.select("query_rep", "rep").join(vector_of, "rep")
        .join(vector_of.select(F.col("rep").alias("query_rep"), F.col("embedding").alias("_query")), "query_rep")
        .select("query_rep", "rep", F.aggregate(
            F.zip_with("_query", "embedding", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
        ).alias("score"))
    )
    return ranked(scored, queries, copies, k, F.desc("score"), "score")
