"""Shared helpers: reading tables, stored intermediate tables, and walking long texts in pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that goes to a Python worker. Texts are long; the default of 10,000 rows
#: would hold tens of megabytes per batch.
BATCH_ROWS = 500
#: Bytes of one batch, where the Spark version knows the setting.
BATCH_BYTES = 8 << 20

#: Characters that the vectorised text scanners turn into arrays at once.
PIECE_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name. Only Spark touches the path, which may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside; the session's own settings come back afterwards."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """Write a result as Parquet below ``spark.checkpoint.dir`` and read it back.

    The files cut the lineage, survive lost executors, and later reads see pruned columns and
    pushed filters. Where the setting is absent, as in local tests, a temporary folder is used.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chosen(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that any other column, whatever its name, can do no harm."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a number written as text, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def letters(texts: Sequence[str | None], overlap: int, limit: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk whole texts in pieces of bounded size.

    Yields (code points, text number per code point). Each text stands between two spaces. A text
    longer than ``limit`` comes in pieces of its own, always cut at the same places; the last
    ``overlap`` characters of a piece begin the next one, so that no run of ``overlap + 1``
    characters is lost or seen twice. Null counts as empty.
    """
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def points() -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return codes, np.repeat(np.asarray(owners, dtype=np.int64), [len(p) for p in parts])

    for number, text in enumerate(texts):
        text = f" {text or ''} "
        if parts and held + len(text) > limit:
            yield points()
            parts, owners, held = [], [], 0
        while len(text) > limit + overlap:
            parts, owners = [text[: limit + overlap]], [number]
            yield points()
            text, parts, owners = text[limit:], [], []
        parts.append(text)
        owners.append(number)
        held += len(text)
    if parts:
        yield points()


#: Bytes as letters a to z, digits and whatever lies beyond ASCII; A to Z in lower case, the rest a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def folded_words(data: bytes | None, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes in order: runs of ASCII letters, digits and anything beyond ASCII.

    Only A to Z are lower-cased. Comes in lists that cover about ``limit`` bytes each, cut between
    words, so that the list of a long text's words is never held whole. Null counts as empty.
    """
    data = (data or b"").translate(_FOLDED)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + limit)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes and where each begins.

    Words are what ASCII white space separates. A word's hash is a polynomial in its bytes modulo
    2**64, mixed at the end.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    if not inside.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    lengths = ends - starts
    where = np.flatnonzero(inside)
    place = np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = _powers(int(lengths.max()))
    terms = (raw[where].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths)), starts


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (two rounds of multiply and shift)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 1024), 0x100000001B3, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS
