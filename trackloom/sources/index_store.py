"""The trip index on disk: entries in buckets, replaced bucket by bucket and published by version.

Entries lie in ``entries/bucket=B/generation=G``. A version is a small table that names the generation of
every bucket. Whoever changes entries writes new generations of the buckets they are in, and then the
next version; readers take the newest version that is complete, so they see all of a change or nothing.
Other buckets are neither read nor written.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trackloom import constants as C
from trackloom.session import durable

BUCKETS = 64


def _bucket(name: str = "id") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = [f.getPath() for f in store.listStatus(folder)]
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("-")[1]) for p in done)


def _generations(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.parquet(f"{path}/versions/v-{version}").select("bucket", "generation").collect()
    return {row.bucket: row.generation for row in rows}


def _publish(spark: SparkSession, path: str, version: int, generations: dict[int, int], columns: str, format_version: int) -> None:
    rows = [(b, g, format_version, columns) for b, g in generations.items()]
    table = spark.createDataFrame(rows, "bucket int, generation long, format_version int, columns string")
    table.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.parquet(f"{path}/versions/v-{version}")


def _write_entries(entries: DataFrame, path: str, generation: int) -> None:
    laid = entries.withColumns({"bucket": _bucket(), "generation": F.lit(generation).cast("long")})
    laid.repartition("bucket").write.partitionBy("bucket", "generation").option("partitionOverwriteMode", "dynamic").mode(
        "overwrite"
    ).parquet(f"{path}/entries")


def write_index(index: DataFrame, path: str, format_version: int = C.INDEX_FORMAT_VERSION) -> int:
    """Write a whole index as the next version and return its number."""
    spark = index.sparkSession
    version = max(versions(spark, path), default=0) + 1
    _write_entries(index, path, version)
    _publish(spark, path, version, {b: version for b in range(BUCKETS)}, index.schema.json(), format_version)
    return version


def read_index(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The entries of a version, the newest by default; only the folders that belong to it are read."""
    version = max(versions(spark, path)) if version is None else version
    head = spark.read.parquet(f"{path}/versions/v-{version}").select("columns").first()
    generations = _generations(spark, path, version)
    by_generation: dict[int, list[int]] = {}
    for bucket, generation in generations.items():
        if buckets is None or bucket in buckets:
            by_generation.setdefault(generation, []).append(bucket)
    wanted = reduce(lambda a, b: a | b, (
        (F.col("generation") == g) & F.col("bucket").isin(own) for g, own in by_generation.items()
    ), F.lit(False))
    columns = T.StructType.fromJson(json.loads(head.columns))
    schema = T.StructType([*columns.fields, T.StructField("bucket", T.IntegerType()), T.StructField("generation", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/entries").where(wanted)
    return rows.drop("bucket", "generation")


def format_of(spark: SparkSession, path: str) -> int:
    """Format version of the newest version."""
    return spark.read.parquet(f"{path}/versions/v-{max(versions(spark, path))}").first().format_version


def replace_entries(spark: SparkSession, path: str, old: DataFrame, entries: DataFrame) -> int:
    """Take entries ``old(id)`` out of the stored index and put others in; returns the new version.

    Only the buckets of these ids are read and written.
    """
    current = max(versions(spark, path))
    gone = durable(old.select("id").union(entries.select("id")).distinct())
    # at most as many numbers as there are buckets
    touched = [row.b for row in gone.select(_bucket().alias("b")).distinct().collect()]
    kept = read_index(spark, path, current, touched).join(gone, "id", "left_anti")
    changed = durable(kept.unionByName(entries.select(*kept.columns)))
    generations = _generations(spark, path, current)
    version = current + 1
    _write_entries(changed, path, version)
    head = spark.read.parquet(f"{path}/versions/v-{current}").first()
    _publish(spark, path, version, {**generations, **dict.fromkeys(touched, version)}, head.columns, head.format_version)
    return version
