"""Session settings the jobs rely on, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options the jobs need on an existing session.

    Instants are computed as UTC, so the session time zone must be UTC. Skew handling and
    adaptive execution are on by default in Spark 4 and are only stated here.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # The JVM never compiles methods above 8000 bytes of bytecode. Larger fused stages are run
    # operator by operator, in small methods that it does compile.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ship_package(spark)
    return spark


def build_session(app: str, master: str = "local[*]", **options: str) -> SparkSession:
    """Build a local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, which all executors share.

    Only a local session, which has no other machine, falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    This cuts the lineage, so a lost executor repeats little, and what reads it later loads only the
    columns and row groups it needs. The folder goes with the session's other checkpoint files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if _shipped.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "trackloom.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for file in sorted(root.rglob("*.py")):
            bundle.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    _shipped["application"] = context.applicationId
