"""Mixing sources to target weights: a low-discrepancy source schedule.

The mix is a row of equal-token slots. The k-th slot takes the k-th point of the golden-ratio
sequence and maps it through the cumulative target weights, so every stretch of the schedule holds
the sources in the wanted proportion. Slots of a source are ranked. The documents of a source lie on
a line of tokens in shuffled order; slot r takes the tokens from r to r + 1 block lengths of that
line, which starts over at its end. Slots and the documents of their blocks meet in a join on
(source, block).

Every source gives its target to the word: targets are rounded by largest remainder, the last block of
a source is cut to the words left, slots beyond it are dropped, and the few slots that the schedule's
rounding leaves short (one, for a source smaller than a block) follow at its end.

Null texts have size 0 and are never taken. Null sources are a source of their own. Repeated rows
are documents of their own. A mix without any tokens takes nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most this many times its own tokens.
MOST_REPEATS = 3
#: Tokens per slot at most. Small corpora get shorter slots, so that rounding stays small.
BLOCK_TOKENS = 1024
#: Slots in the mix at least.
LEAST_SLOTS = 20_000
#: Shuffle order of a source: buckets by hash, then by hash inside each bucket.
BUCKETS = 2048
#: Slots that one group ranks.
SLOT_CHUNK = 50_000
GOLDEN = 0.6180339887498949
#: Cells of the unit interval through which a point finds the source that holds it.
CELLS = 1024
#: Rows of a table made on the driver up to which it is broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a driver-made table whose row count is known to be low."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def word_count(text: str) -> Column:
    """Words between ASCII white space in a column; 0 for null.

    Spaces outnumber everything else, so counting the places where a word begins needs no list.
    """
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def target_shares(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> list[float]:
    """Target tokens per source, in the given order.

    Sources share all tokens by weight. A target stops at ``most`` times its source's size; the
    excess is shared again by weight among the others until none is above.
    """
    total = float(sum(size for _, size in sizes))
    limits = [most * size for _, size in sizes]
    given = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        rest = total - sum(limits[i] for i in sorted(capped))
        weight = sum(given[i] for i in range(len(sizes)) if i not in capped)
        targets = [limits[i] if i in capped else rest * given[i] / weight for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in capped and targets[i] > limits[i]}
        if not above:
            return targets
        capped |= above


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> list[tuple]:
    """(source, source_size, target) by code point of the source, null last.

    One row per source reaches the driver: sources are collections, not documents.
    """
    found = [(r["source"], int(r["n"] or 0)) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    targets = target_shares(found, weights)
    return [(source, size, target) for (source, size), target in zip(found, targets)]


def whole_targets(targets: list[float]) -> list[int]:
    """Targets as whole words with the same sum, rounded by largest remainder; none is rounded up from a whole number."""
    words = [int(t) for t in targets]
    rest = round(sum(targets)) - sum(words)
    order = sorted(range(len(targets)), key=lambda i: (words[i] - targets[i], i))
    for i in order[: max(rest, 0)]:
        words[i] += targets[i] > words[i]
    return words


def schedule(spark, sources: list[tuple], n_slots: int) -> DataFrame:
    """Slots ``(number, source_no, rank)``: which source each slot of the mix takes, ranked per source.

    A window over all slots of a source would be one task; ranks are counted per stretch of slots
    and offset by the stretches before.
    """
    total = sum(t for _, _, t in sources) or 1.0
    cells, low = [], 0.0
    for number, (_, _, target) in enumerate(sources):
        high = 2.0 if number + 1 == len(sources) else low + target / total
        if target > 0:
            cells += [(cell, number, low, high) for cell in range(int(low * CELLS), int(min(high, 1.0) * CELLS) + 1)]
            low = high
    # at most CELLS and two per source
    intervals = small(spark.createDataFrame(cells, "cell int, source_no int, _low double, _high double"), len(cells))
    point = (F.col("id").cast("double") + 0.5) * F.lit(GOLDEN)
    slots = (
        spark.range(n_slots).withColumn("_point", point - F.floor(point))
        .withColumn("cell", F.floor(F.col("_point") * CELLS).cast("int"))
        .join(intervals, "cell").where((F.col("_low") <= F.col("_point")) & (F.col("_point") < F.col("_high")))
        .select(F.col("id").alias("number"), "source_no", F.floor(F.col("id") / SLOT_CHUNK).alias("_chunk"))
    )
    before = Window.partitionBy("source_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy("source_no", "_chunk").agg(F.count("*").alias("_n"))
        .select("source_no", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("source_no", "_chunk").orderBy("number")
    return (
        slots.withColumn("_inside", F.row_number().over(inside) - 1).join(offsets, ["source_no", "_chunk"])
        .select("number", "source_no", (F.col("_before") + F.col("_inside")).alias("rank"))
    )


def filled(slots: DataFrame, numbers: DataFrame, block: int) -> DataFrame:
    """Slots ``(source_no, rank)`` for every block of each source's target: the scheduled ones and those still missing."""
    wanted = numbers.select("source_no", F.ceil(F.col("words") / block).alias("_blocks"))
    scheduled = slots.join(wanted, "source_no").where(F.col("rank") < F.col("_blocks")).select("source_no", "rank")
    counts = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("_n"))
    short = wanted.join(counts, "source_no", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < F.col("_blocks"))
    missing = short.select("source_no", F.explode(F.sequence(F.col("_n"), F.col("_blocks") - 1)).alias("rank"))
    return scheduled.unionByName(missing)


def token_line(sized: DataFrame) -> DataFrame:
    """Where each document begins on its source's line of tokens (``at``), in shuffled order."""
    hashed = sized.withColumn("_hash", F.xxhash64(F.lit(7), "doc_id", "size"))
    hashed = hashed.withColumn("_bucket", F.pmod(F.shiftright("_hash", 20), F.lit(BUCKETS)))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_n"))
        .select("source_no", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_no", "_bucket"])
        .withColumn("at", F.col("_before") + F.col("_inside")).drop("_hash", "_bucket", "_inside", "_before")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """How many words the mix takes of each document: a row per document with its source's target."""
    spark = docs.sparkSession
    sized = stored(chosen(docs, "doc_id", "source", "text").select("doc_id", "source", word_count("text").alias("size")))
    sources = source_targets(sized, weights)
    total = sum(size for _, size, _ in sources)
    block = max(1, min(block_tokens, total // LEAST_SLOTS))
    n_slots = -(-total // block)

    numbers = small(spark.createDataFrame(
        [(s, i, n, float(t), w) for i, ((s, n, t), w) in enumerate(zip(sources, whole_targets([t for _, _, t in sources])))],
        "source string, source_no int, source_size long, target double, words long",
    ), len(sources))
    numbered = sized.withColumnRenamed("source", "_source").join(
        numbers, F.col("_source").eqNullSafe(F.col("source"))
    ).drop("_source")
    line = stored(token_line(numbered))

    # A document's copy in pass p covers [p * source_size + at, ... + size) of the unrolled line.
    slots = filled(schedule(spark, sources, n_slots), numbers, block).select("source_no", F.col("rank").alias("block"))
    copies = (
        line.where(F.col("size") > 0)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))))
        .withColumn("_from", F.col("_pass") * F.col("source_size") + F.col("at"))
        .withColumn("_to", F.col("_from") + F.col("size"))
        # the line ends at the target, within its last block
        .withColumn("_to", F.least("_to", "words")).where(F.col("_from") < F.col("_to"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    )
    part = F.least(F.col("_to"), (F.col("block") + 1) * block) - F.greatest(F.col("_from"), F.col("block") * block)
    taken = (
        copies.withColumn("_part", part).join(slots, ["source_no", "block"])
        .groupBy("source_no", "at", "doc_id").agg(F.sum("_part").alias("taken"))
    )
    result = (
        line.alias("l").join(
            taken.select(F.col("source_no").alias("_s"), F.col("at").alias("_a"), "taken"),
            (F.col("source_no") == F.col("_s")) & (F.col("at") == F.col("_a")) & (F.col("size") > 0), "left",
        )
    )
    return result.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def resample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, to the nearest whole number.

    All columns stay. Rows of one id (or without an id) share their counts. Only the document at the
    end of a source's last slot is taken in part, so rounding moves at most one document per source.
    Documents without words are not taken.
    """
    taken = mix(docs, weights, block_tokens).groupBy(F.col("doc_id").alias("_mixed_id")).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("_mixed_times")
    ).where("_mixed_times > 0")
    repeated = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_mixed_id"])).withColumn(
        "_mixed_copy", F.explode(F.sequence(F.lit(1), F.col("_mixed_times")))
    )
    return repeated.drop("_mixed_id", "_mixed_times", "_mixed_copy")
