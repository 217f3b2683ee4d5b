"""Packing: shortest-pack-first over the length histogram.

Documents become token ids; a document longer than a sequence is cut into full sequences and a rest.
Only the histogram of piece lengths, at most one count per length, reaches the driver. There the
lengths are placed, longest first, into the patterns with the shortest packs that still have room;
a pattern is a list of lengths with a count of how many sequences follow it. The patterns are joined
back to the pieces by (length, rank within the length).

Null texts count as empty: one piece with the end id alone. Repeated rows are packed once each. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, small_batches, stored

SEQUENCE = 2048
END_ID = 1
#: Distinct words, and parts of words, whose ids a worker remembers.
REMEMBERED_WORDS = 300_000
#: Rank groups per length. Ranks are counted inside a group and offset by the groups before.
RANK_GROUPS = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: How many sequences follow it, and (length, copies) in the order of the sequence.
Pattern = tuple[int, tuple[tuple[int, int], ...]]
_WHITE = re.compile(r"[ \t\n\r]+")
#: White space that str.split divides at and the vocabulary does not, or the other way round.
_ODD_WHITE = re.compile("[\x1c-\x1f\x85]")
#: Fixed values of the vocabulary: how it divides a word. It holds for words of the characters that
#: the second pattern leaves: ASCII and letters of Latin-1, no special token.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\x00-\xff]*")
_ODD = re.compile(r"[^\x21-\x7eÀ-ÖØ-öø-ÿ]|<\|")


class WordEncoder(dict):
    """Token ids of whole texts, word by word: a dictionary from words to places in a list of ids.

    The vocabulary drops white space and never joins across it, so the ids of a text are the ids of
    its words in order. A new word in plain letters is divided as the vocabulary divides it, into
    runs of letters, single digits and runs of marks, and each part is remembered as well; other
    words go to the tokenizer whole. The first ``REMEMBERED_WORDS`` words stay, among them the
    frequent ones; later ones are forgotten after their text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in range(0x21, 0x100) if not _ODD.search(chr(c))]
        self._spelling = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in plain}
        self._parts: dict[str, int] = {}  # place and number of a part's ids, in one integer
        self._part_ids = array("I")
        self._starts, self._lengths, self._flat = array("q"), array("q"), array("I")

    def _part(self, part: str) -> array | list[int]:
        place = self._parts.get(part)
        if place is not None:
            return self._part_ids[place >> 6 : (place >> 6) + (place & 63)]
        ids = [token.id for token in self._model.tokenize(part.translate(self._spelling))]
        if len(self._parts) < REMEMBERED_WORDS and len(ids) < 64:
            self._parts[part] = len(self._part_ids) << 6 | len(ids)
            self._part_ids.extend(ids)
        return ids

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self._starts.append(len(self._flat))
        if _ODD.search(word):
            self._flat.extend(self._tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            for part in _PARTS.findall(word.lower()):
                self._flat.extend(self._part(part))
        self._lengths.append(len(self._flat) - self._starts[-1])
        return number

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()  # the vocabulary knows lower case only; fewer words differ
        words = _WHITE.split(text) if _ODD_WHITE.search(text) else text.split()
        if not words:
            return np.empty(0, np.uint32)
        which = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        lengths = np.frombuffer(self._lengths, np.int64)[which]
        ends = np.cumsum(lengths)
        jump = np.repeat(np.frombuffer(self._starts, np.int64)[which] - ends + lengths, lengths)
        ids = np.frombuffer(self._flat, np.uint32)[jump + np.arange(len(jump))] if len(jump) else np.empty(0, np.uint32)
        if len(self) > REMEMBERED_WORDS:
            while len(self) > REMEMBERED_WORDS:
                self.popitem()
            del self._flat[self._starts[REMEMBERED_WORDS] :], self._starts[REMEMBERED_WORDS:], self._lengths[REMEMBERED_WORDS:]
        return ids


#: One per worker process and vocabulary, so that later tasks of a worker find the words known.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``sequence`` ids, with the checksum of its ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(words.encode(text if isinstance(text, str) else ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), sequence):
                    part = ids[start : start + sequence]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    small_batches(docs.sparkSession)
    return chosen(docs, "doc_id", "text").mapInPandas(pieces, PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[Pattern]:
    """Patterns ``(count, ((length, copies), ...))`` that hold every piece of a histogram.

    Lengths are placed longest first. Open patterns are kept by the room they have left, and the
    shortest pack, the one with most room, takes the length. A pattern that stands for more
    sequences than there are pieces left is divided. Where no open pattern has room, new packs
    begin with as many copies as fit. Each length divides few patterns, so there are at most a
    few per length, however many pieces there are.
    """
    room: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def keep(count: int, runs: tuple, free: int) -> None:
        (room.setdefault(free, []) if free else done).append((count, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((free for free, packs in room.items() if packs), default=0)
            if most >= length:
                count, runs = room[most].pop()
                if count > left:
                    keep(count - left, runs, most)
                    count = left
            else:
                most, runs = sequence, ()
                count = max(1, left // (sequence // length))
            copies = max(1, min(most // length, left // count))
            keep(count, (*runs, (length, copies)), most - copies * length)
            left -= count * copies
    return done + [pattern for packs in room.values() for pattern in packs]


def pattern_slots(patterns: list[Pattern]) -> list[tuple[int, ...]]:
    """Which ranks of a length go where: (length, first rank, end rank, first sequence, offset, copies)."""
    taken: dict[int, int] = {}
    slots, sequence = [], 0
    for count, runs in sorted(patterns, key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for length, copies in runs:
            first = taken.get(length, 0)
            taken[length] = first + count * copies
            slots.append((length, first, taken[length], sequence, offset, copies))
            offset += length * copies
        sequence += count
    return slots


def with_ranks(pieces: DataFrame, groups: int = RANK_GROUPS) -> DataFrame:
    """Number the pieces of each length from 0.

    A window by length alone would put the pieces of one common length into one task. Pieces are
    spread over rank groups by a hash of the document; each group counts its own pieces and starts
    after the groups before it.
    """
    spread = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy("length", "_group").agg(F.count("*").alias("_n"))
        .select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_group").orderBy("ids_crc32", "doc_id", "start")
    numbered = spread.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, ["length", "_group"])
        .withColumn("rank", F.col("_before") + F.col("_inside")).drop("_group", "_before", "_inside")
    )


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents: a row per piece with its sequence and the place in it.

    The slots that are broadcast number at most a few per length, whatever the input: the
    histogram has at most ``sequence`` lengths.
    """
    spark = docs.sparkSession
    pieces = stored(tokenize_pieces(docs, tokenizer_path, sequence, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        pattern_slots(shortest_pack_first(histogram, sequence)),
        "length long, _first long, _end long, _sequence long, _offset long, _copies long",
    )
    nth = F.col("rank") - F.col("_first")
    return (
        with_ranks(pieces).join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end")))
        .withColumn("sequence_id", (F.col("_sequence") + F.floor(nth / F.col("_copies"))).cast("long"))
        .withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_copies")) * F.col("length"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )
