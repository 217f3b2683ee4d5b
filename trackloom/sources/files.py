"""File listings and small state tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom import constants as C
from trackloom.functions import text
from trackloom.operators.roads import chunks_in_box
from trackloom.session import durable


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files below a folder: ``path`` (relative), ``name, size, mtime``. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    absolute = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    plain = F.regexp_replace(F.col("path"), r"^\w+:(//[^/]*)?", "")
    relative = F.substring(plain, F.lit(len(absolute.rstrip("/")) + 2), F.length(plain))
    return files.select(
        relative.alias("path"), F.regexp_extract(relative, r"([^/]*)$", 1).alias("name"), "size", "mtime"
    )


def scan_library(spark: SparkSession, path: str) -> DataFrame:
    """The visible videos directly in a library folder, sorted by name."""
    files = list_files(spark, path, recursive=False)
    return files.where(~F.col("name").startswith(".") & text.is_video(F.col("name"))).orderBy("name")


def fingerprint_files(spark: SparkSession, path: str, changed: DataFrame | None = None) -> DataFrame:
    """Content fingerprints ``(path, name, fingerprint)``, only of ``changed(path)`` when given.

    Files may be of any size: each task opens its files where they lie and reads the first and last
    megabyte. Paths are relative to the folder, so equal names in two folders stay apart.
    """
    files = list_files(spark, path).select("path", "name", "size")
    if changed is not None:
        files = files.join(changed.select("path").distinct(), "path", "left_semi")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
        for batch in batches:
            prints = []
            for name, size in zip(batch["path"], batch["size"]):
                with store.open_input_file(f"{base}/{name}") as file:
                    chunk = C.FINGERPRINT_CHUNK_BYTES
                    digest = hashlib.sha256(file.read_at(min(chunk, size), 0))
                    if size > chunk:
                        tail = max(chunk, size - chunk)
                        digest.update(file.read_at(size - tail, tail))
                prints.append(f"{size}:{digest.hexdigest()[:16]}")
            yield batch[["path", "name"]].assign(fingerprint=prints)

    return files.mapInPandas(read, "path string, name string, fingerprint string")


def write_map(
    roads: DataFrame, chunks: DataFrame, localities: DataFrame, path: str, cell_deg: float = 1.0, most_folders: int = 4096
) -> None:
    """Write the map tables; chunks are laid out by the cell of their south-west corner.

    Cells are doubled until the map has at most so many, each a folder, and chunks are sorted in them. The
    size of the cells and how many the largest chunk spans are kept beside them, so that a reader knows
    which cells may reach into a box.
    """
    roads.write.mode("overwrite").parquet(f"{path}/roads")
    def cell(name):
        return F.floor(F.col(name) / cell_deg).cast("int")

    used = durable(chunks.select(cell("min_lat").alias("lat"), cell("min_lon").alias("lon")).distinct())
    while used.count() > most_folders:
        cell_deg *= 2
        used = durable(used.select(*[F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("lat", "lon")]).distinct())
    laid = chunks.withColumns({"cell_lat": cell("min_lat"), "cell_lon": cell("min_lon")})
    laid.repartition("cell_lat", "cell_lon").sortWithinPartitions("cell_lat", "cell_lon", "min_lat").write.mode("overwrite").partitionBy(
        "cell_lat", "cell_lon"
    ).parquet(f"{path}/road_chunks")
    chunks.agg(
        F.lit(cell_deg).alias("cell_deg"), F.coalesce(F.max(cell("max_lat") - cell("min_lat")), F.lit(0)).alias("reach_lat"),
        F.coalesce(F.max(cell("max_lon") - cell("min_lon")), F.lit(0)).alias("reach_lon"),
    ).write.mode("overwrite").parquet(f"{path}/layout")
    localities.write.mode("overwrite").parquet(f"{path}/localities")


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    roads, chunks, localities = (spark.read.parquet(f"{path}/{t}") for t in ("roads", "road_chunks", "localities"))
    return roads, chunks.drop("cell_lat", "cell_lon"), localities


def read_chunks_in_box(spark: SparkSession, path: str, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Road chunks of a stored map whose bounding box touches a box; only cells that reach it are read."""
    layout = spark.read.parquet(f"{path}/layout").first()
    def cells(low: float, high: float, reach: int) -> tuple[int, int]:
        return math.floor(low / layout.cell_deg) - reach, math.floor(high / layout.cell_deg)

    chunks = spark.read.parquet(f"{path}/road_chunks").where(
        F.col("cell_lat").between(*cells(min_lat, max_lat, layout.reach_lat))
        & F.col("cell_lon").between(*cells(min_lon, max_lon, layout.reach_lon))
    )
    return chunks_in_box(chunks, min_lat, max_lat, min_lon, max_lon).drop("cell_lat", "cell_lon")
