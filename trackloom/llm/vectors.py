"""What the two searches share: valid vectors, distinct keys with their smallest ids, and final ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` rows that take part: no null, zero or non-finite vector, no null id.

    Vectors compare with vectors of their own length only (``each_length``). Repeated rows count once.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & F.exists("embedding", lambda x: x != 0)).distinct()
    )


def each_length(rows: DataFrame, length: Column, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of a search within the rows of each length; a table has few lengths, mostly one."""
    lengths = sorted(r[0] for r in rows.select(length).distinct().collect())
    return reduce(DataFrame.unionByName, [search(rows.where(length == n)) for n in lengths] or [search(rows)])


def with_copies(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k + 1`` smallest ids of every key: ``(key, vec_id, rep)``.

    However many rows share a key, a result list never holds more of them; ``rep`` is the smallest.
    """
    order = Window.partitionBy(key).orderBy("vec_id")
    return (
        rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
        .withColumn("rep", F.first("vec_id").over(order)).drop("_r")
    )


def ranked(found: DataFrame, queries: DataFrame, copies: DataFrame, k: int, better: Column, value: str) -> DataFrame:
    """Rank the entries of each query: ``(query_id, rank, vec_id, value)``.

    ``found`` has (query_rep, rep, value); ``queries`` (query_id, query_rep); ``copies`` (vec_id, rep).
    """
    order = Window.partitionBy("query_id").orderBy(better, "vec_id")
    of_rep = Window.partitionBy("query_rep").orderBy(better, "vec_id")
    # the k + 1 best entries of a distinct query first: many queries may share it
    best = (
        found.join(copies.select("vec_id", "rep"), "rep").withColumn("_r", F.row_number().over(of_rep))
        .where(F.col("_r") <= k + 1).select("query_rep", "vec_id", value)
    )
    return (
        queries.join(best, "query_rep").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", value)
    )
