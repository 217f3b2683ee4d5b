"""Track documents: reading, validation, the canonical written form, and flat tables.

A track document is one JSON file per video: a header and one object per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom import constants as C
from trackloom.functions import text
from trackloom.functions.report import rounded

OVERRIDE_KINDS = ("bad", "good")
_HEADER_TYPES = {
    "video_filename": "string", "fingerprint": "string", "video_size": "bigint",
    "video_mtime": "double", "extraction_status": "string", "extracted_at": "string",
    "extractor_version": "int", "cleaning_version": "int", "video.width": "int",
    "video.height": "int", "video.duration_s": "double",
}
_STREET = (
    "array<struct<name:string,name_en:string,ref:string,highway:string,distance_m:bigint,"
    "start_t:double,end_t:double>>"
)
_LOCALITIES = "map<string,struct<name:string,name_en:string,place:string>>"
_ENRICHMENT = (
    "struct<enricher_version:int,osm_timestamp:string,osm_source:string,"
    "samples_digest:string,enriched_at:string>"
)
_RANGES = "array<array<double>>"


# Documents of a bundle: enough that files are few, so few that every reader gets some.
BUNDLE = 1000


def write_documents(documents: DataFrame, path: str) -> None:
    """Write document texts ``(file_stem, text)``, many to a file. Texts need not be JSON.

    A file for each would have to be created, listed and opened, which takes far longer than its text. The
    files are not compressed, so that their sizes tell how much text a task gets.
    """
    documents.select("file_stem", "text").write.option("maxRecordsPerFile", BUNDLE).option("compression", "none").mode(
        "append"
    ).parquet(path)


def read_documents(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Raw documents ``(file_stem, document)``; the document is null when it is not JSON.

    A byte order mark is accepted. Each file is a document and its name the stem, or with ``bundled`` the
    files are those of ``write_documents``.
    """
    if bundled:
        files = spark.read.schema("file_stem string, text string").parquet(path).withColumnRenamed("text", "value")
        stem = F.col("file_stem")
    else:
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        # File names in the metadata are URL-encoded, except that a plus stands for itself.
        stem = text.stem(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))
    content = F.regexp_replace("value", "^\ufeff", "")
    return files.select(stem.alias("file_stem"), F.try_parse_json(content).alias("document"))


def _field(name: str, as_type: str, of: str = "document") -> Column:
    return F.try_variant_get(F.col(of), f"$.{name}", as_type)


def _type_of(name: str, of: str = "sample") -> Column:
    """JSON type of a field: NULL for missing and null alike."""
    return F.coalesce(F.schema_of_variant(_field(name, "variant", of)), F.lit("VOID"))


def _is_number(name: str) -> Column:
    return _type_of(name).rlike("^(BIGINT|DOUBLE|DECIMAL)")


def _sample_problem() -> Column:
    """The first reason why a sample cannot be used, or null."""
    raw, status, time = _field("raw", "string", "sample"), _field("status", "string", "sample"), _field("time", "string", "sample")
    def bad_coordinate(name: str) -> Column:
        return (_type_of(name) != "VOID") & ~_is_number(name)

    located = status.isin(*C.LOCATED_STATUSES)
    return (
        F.when(raw.isNull() | ~raw.contains(C.RAW_TEXT_SEPARATOR), "invalid raw text")
        .when(~_is_number("t"), "t must be a number")
        .when(F.size(F.coalesce(_field("scores", "array<double>", "sample"), F.array().cast("array<double>"))) != 2,
              "scores must be two numbers")
        .when(status.isNull() | ~status.isin(*C.ALL_STATUSES), "unknown status")
        .when(bad_coordinate("lat") | bad_coordinate("lon"), "lat and lon must be numbers or null")
        .when(located & ((_type_of("lat") == "VOID") | (_type_of("lon") == "VOID")),
              "a located sample needs lat and lon")
        .when((time != "") & time.try_cast("timestamp").isNull(), "invalid time")
        .when((time != "") & ~time.rlike(r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"), "time needs a UTC offset")
    )


def _header_problem() -> Column:
    """The first reason why a header cannot be used, or null."""
    missing = F.lit(None).cast("string")
    for name, kind in reversed(_HEADER_TYPES.items()):
        missing = F.when(_field(name, kind).isNull(), F.lit(f"missing field {name}")).otherwise(missing)
    bad = F.lit(False)
    for kind in OVERRIDE_KINDS:
        given = _field(f"overrides.{kind}_ranges_s", "variant")
        ranges = _field(f"overrides.{kind}_ranges_s", _RANGES)
        wrong = F.exists(ranges, lambda r: (F.size(r) != 2) | (F.get(r, 0) > F.get(r, 1))
                         | F.get(r, 0).isNull() | F.get(r, 1).isNull())
        bad = bad | (given.isNotNull() & (ranges.isNull() | F.coalesce(wrong, F.lit(False))))
    samples = _field("samples", "array<variant>")
    return (
        F.when(F.col("document").isNull(), "invalid JSON").when(missing.isNotNull(), missing)
        .when(bad, "invalid override range").when(samples.isNull(), "missing field samples")
    )


def explode_samples(documents: DataFrame) -> DataFrame:
    """Samples of the documents as variants, numbered from 0."""
    return documents.select(
        "file_stem",
        F.posexplode(_field("samples", "array<variant>")).alias("seq", "sample"),
    )


def validate(documents: DataFrame) -> DataFrame:
    """Documents with the reason why they cannot be read (null = fine) and the sample number."""
    problems = explode_samples(documents).withColumn("_problem", _sample_problem())
    first = problems.where("_problem is not null").groupBy("file_stem").agg(
        F.min(F.struct((F.col("seq") + 1).alias("number"), F.col("_problem").alias("problem"))).alias("_bad")
    )
    checked = documents.withColumn("_header", _header_problem()).join(first, "file_stem", "left")
    return checked.select(
        "file_stem", "document",
        F.coalesce(
            "_header", F.concat(F.lit("invalid sample #"), F.col("_bad.number"), F.lit(": "), F.col("_bad.problem"))
        ).alias("reason"),
        F.when(F.col("_header").isNull(), F.col("_bad.number")).alias("sample_number"),
    )


def read_tracks(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid documents as tables: headers, samples with their raw readings, and the quarantine."""
    checked = validate(documents)
    good = checked.where("reason is null").select("file_stem", "document")
    header = good.select(
        "file_stem",
        *[_field(name, kind).alias(name.split(".")[-1]) for name, kind in _HEADER_TYPES.items()],
        *[
            F.coalesce(_field(f"overrides.{k}_ranges_s", _RANGES), F.array().cast(_RANGES)).alias(f"{k}_ranges_s")
            for k in OVERRIDE_KINDS
        ],
        F.coalesce(_field("streets", _STREET), F.array().cast(_STREET)).alias("streets"),
        F.coalesce(_field("localities", _LOCALITIES), F.expr(f"cast(map() as {_LOCALITIES})")).alias("localities"),
        _field("enrichment", _ENRICHMENT).alias("enrichment"),
    )
    header = header.withColumn("stem", text.stem(F.col("video_filename")))
    raw = _field("raw", "string", "sample")
    split_at = F.locate(C.RAW_TEXT_SEPARATOR, raw)
    scores = _field("scores", "array<double>", "sample")
    samples = explode_samples(good).select(
        F.col("file_stem").alias("trip_id"), "seq",
        _field("t", "double", "sample").alias("t"),
        _field("time", "string", "sample").try_cast("timestamp").alias("time"),
        *[_field(n, "double", "sample").alias(n) for n in ("lat", "lon")],
        _field("kmh", "int", "sample").alias("kmh"),
        _field("status", "string", "sample").alias("status"),
        F.coalesce(_field("time_estimated", "boolean", "sample"), F.lit(False)).alias("time_estimated"),
        F.substring(raw, F.lit(1), split_at - 1).alias("gps_text"),
        F.substring(raw, split_at + len(C.RAW_TEXT_SEPARATOR), F.length(raw)).alias("clock_text"),
        scores[0].alias("gps_score"), scores[1].alias("clock_score"),
    )
    return header, samples, checked.where("reason is not null").select("file_stem", "reason", "sample_number")


def overrides_table(headers: DataFrame) -> DataFrame:
    """Override ranges of the headers as rows."""
    parts = [
        headers.select(
            F.col("file_stem").alias("trip_id"), F.lit(kind).alias("kind"),
            F.explode(f"{kind}_ranges_s").alias("_r"),
        )
        for kind in OVERRIDE_KINDS
    ]
    both = parts[0].unionByName(parts[1])
    return both.select("trip_id", "kind", F.col("_r")[0].alias("start_s"), F.col("_r")[1].alias("end_s"))


# --- writing ---------------------------------------------------------------------------------------


def iso_local(time: Column, timezone: Column) -> Column:
    """ISO text of an instant with the local offset, such as ``2026-09-25T11:17:07+03:00``."""
    local = F.from_utc_timestamp(time, timezone)
    offset_s = F.unix_timestamp(local) - F.unix_timestamp(time)
    minutes = F.abs(F.floor(offset_s / 60))
    sign = F.when(offset_s < 0, "-").otherwise("+")
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign,
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
    )


def persisted_samples(samples: DataFrame) -> DataFrame:
    """Samples in their stored form: rounded, with one raw text, and offset times."""
    return samples.select(
        "trip_id", "seq",
        rounded("t", 2).alias("t"),
        iso_local(F.col("time"), F.col("timezone")).alias("time"),
        rounded("lat", 6).alias("lat"), rounded("lon", 6).alias("lon"), "kmh", "status",
        F.when(F.col("time_estimated"), F.lit(True)).alias("time_estimated"),
        F.concat("gps_text", F.lit(C.RAW_TEXT_SEPARATOR), "clock_text").alias("raw"),
        F.array(rounded("gps_score", 2), rounded("clock_score", 2)).alias("scores"),
    )


def sample_documents(samples: DataFrame) -> DataFrame:
    """The ``samples`` array of each track document as JSON text.

    The form has one document per trip, so a trip's samples meet in one row (some megabytes for a
    day of video). ``write_samples`` stores long trips without that.
    """
    stored = persisted_samples(samples)
    order = ["t", "time", "lat", "lon", "kmh", "status", "time_estimated", "raw", "scores"]
    return stored.groupBy("trip_id").agg(
        F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", F.struct(*order).alias("s")))), lambda x: x["s"]
        )).alias("samples_json")
    )


def write_samples(samples: DataFrame, path: str) -> None:
    """Stored samples as Parquet, by trip month so that later jobs can prune."""
    month = F.coalesce(F.date_format("time", "yyyy-MM"), F.lit("unknown"))
    samples.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(path)
