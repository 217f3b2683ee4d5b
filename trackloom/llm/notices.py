"""License scans: exact phrases, and short notices with a bounded number of edits.

A text is read as words (ASCII letters in lower case, digits, anything beyond ASCII) with one space
between them, so line breaks, markup and punctuation never count as edits. A notice that may differ
in e characters is split into e + 1 pieces: whatever the edits, one piece stands unchanged. All
pieces of all notices are searched at once by an Aho-Corasick automaton. Around each piece found, the
regex library matches the whole notice with at most e insertions, deletions and substitutions; what
it accepts is reported with its words, its place in the text and its edits. Where accepted notices
overlap, the one with the fewest edits stays, then the longest, the first, and the first label.

Whole texts are read, long ones in pieces that overlap by more than the longest notice. Null texts
count as empty and have no spans. Repeated rows come back as often as they come in. An empty table
gives no rows. Extra columns are ignored. A null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import bounded_batches, folded_words, stored

#: One edit is allowed for so many characters of a notice, and so many edits at most.
CHARS_PER_EDIT = 10
MOST_EDITS = 3
#: A run of candidate places is verified in windows of at most so many notice lengths.
WINDOW = 8
#: Bytes of a text that are looked at together.
PIECE_BYTES = 1 << 20

# The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A short notice in folded words, and the label a text gets that holds it."""

    label: str
    text: str

    @property
    def edits(self) -> int:
        return min(MOST_EDITS, len(self.text) // CHARS_PER_EDIT)

    def seeds(self) -> list[tuple[int, str]]:
        """The pieces of which one at least survives any allowed edits, with their offsets."""
        edges = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(edges, edges[1:])]


NOTICES = (
    Notice("mit-notice", "released under the mit license"),
    Notice("mit-notice", "licensed under the mit license"),
    Notice("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-notice", "licensed under the apache license version 2 0"),
    Notice("gpl-notice", "licensed under the gnu general public license"),
    Notice("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Notice("lgpl-notice", "gnu lesser general public license"),
    Notice("agpl-notice", "gnu affero general public license"),
    Notice("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("mpl-notice", "subject to the terms of the mozilla public license"),
    Notice("isc-grant", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("cc-by-notice", "licensed under cc by 4 0"),
    Notice("cc-by-sa-notice", "licensed under cc by sa 4 0"),
    Notice("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    Notice("cc-by-nd-notice", "licensed under cc by nd 4 0"),
    Notice("public-domain", "free and unencumbered software released into the public domain"),
    Notice("reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Place:
    """A phrase or notice found: its first and last word, and its edits (none in a phrase)."""

    label: str
    first: int
    last: int
    edits: int
    length: int
    base: bool


class Scanner:
    """All phrases and notices in one automaton."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.reach = max([len(n.text) + n.edits for n in notices] + [len(p) for p, _ in PHRASES]) + 1
        self.fuzzy = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, _) in enumerate(PHRASES):
            wanted.setdefault(phrase, []).append((-1 - i, 0))
        for i, notice in enumerate(notices):
            for offset, seed in notice.seeds():
                wanted.setdefault(seed, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in wanted.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def windows(self, places: list[int], number: int, size: int) -> Iterator[tuple[int, int]]:
        """Where a notice may lie: around its presumed starts, joined where they overlap, of bounded length."""
        notice = self.notices[number]
        span = len(notice.text) + notice.edits
        begin = end = None
        for at in sorted(set(places)):
            a, b = max(0, at - notice.edits), min(size, at + span)
            if begin is None:
                begin, end = a, b
            elif a <= end and b - begin <= WINDOW * span:
                end = b
            else:
                yield begin, end
                begin, end = a, b
        if begin is not None:
            yield begin, end

    def scan(self, text: str, known: int) -> Iterator[tuple[str, int, int, int, int, bool]]:
        """(label, start, end, edits, length, base) in a folded text; what ends within ``known`` was seen before."""
        places: dict[int, list[int]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            start = last + 1 - length
            for number, offset in uses:
                if number >= 0:
                    places.setdefault(number, []).append(start - offset)
                elif last + 1 > known and (start == 0 or text[start - 1] == " ") and text[last + 1 : last + 2] in ("", " "):
                    yield PHRASES[-1 - number][1], start, last + 1, 0, length, True
        for number, starts in places.items():
            notice = self.notices[number]
            for begin, end in self.windows(starts, number, len(text)):
                for match in self.fuzzy[number].finditer(text, begin, end):
                    if match.end() > known:
                        yield notice.label, match.start(), match.end(), sum(match.fuzzy_counts), len(notice.text), False


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def places_of(data: bytes | None, notices: tuple[Notice, ...] = NOTICES, piece: int = PIECE_BYTES) -> tuple[int, list[Place]]:
    """The number of words of a text and all places, those of notices still overlapping."""
    finder = scanner(notices)
    total, tail, found = 0, [], []
    for words in folded_words(data, piece):
        parts = [w.decode("utf-8", "replace") for w in tail]
        known = len(" ".join(parts))
        offset = total - len(tail)
        text = " ".join([*parts, b" ".join(words).decode("utf-8", "replace")]) if words else ""
        total += len(words)
        hits = list(finder.scan(text, known)) if words else []
        if hits:
            # the word of a character is the number of spaces before it; a match may begin or end with a space
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            for label, start, end, edits, length, base in hits:
                start, end = start + (text[start] == " "), end - (text[end - 1] == " ")
                first, last = (int(np.searchsorted(spaces, p)) for p in (start, end - 1))
                found.append(Place(label, offset + first, offset + last, edits, length, base))
        held, tail = 0, tail + words
        for i in range(len(tail) - 1, -1, -1):
            held += len(tail[i]) + 1
            if held > 4 * finder.reach:
                tail = tail[i:]
                break
    return total, found


def settled(places: list[Place]) -> list[Place]:
    """Of overlapping notices those with the fewest edits, then the longest, the first, the first label."""
    kept: list[Place] = []
    taken: set[int] = set()
    for place in sorted({p for p in places if not p.base}, key=lambda p: (p.edits, -p.length, p.first, p.label, p.last)):
        own = range(place.first, place.last + 1)
        if taken.isdisjoint(own):
            taken.update(own)
            kept.append(place)
    return sorted(kept, key=lambda p: (p.first, p.last))


_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def offsets_of(data: bytes, words: set[int]) -> dict[int, tuple[int, int]]:
    """Where some of a text's words lie in it, in code points."""
    out, most = {}, max(words)
    for number, match in enumerate(_WORD.finditer(data.decode("utf-8", "replace"))):
        if number in words:
            out[number] = match.span()
        if number == most:
            break
    return out


SPANS = "array<struct<label:string,start:long,end:long,first_word:long,last_word:long,edits:int>>"
_SPAN_TYPE = pa.list_(pa.struct([
    ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()),
]))


def find_notices(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``(doc_id, n_words, phrases, notices, score)`` of every row.

    ``phrases`` are the places of the exact phrases, ``notices`` those matched with bounded edits; both
    hold places in code points (end exclusive) and in words. The score is 1 where a phrase stands, else
    the share of unchanged characters of the best notice, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, phrases, fuzzy, scores = [], [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                total, places = places_of(data, notices)
                exact = sorted((p for p in places if p.base), key=lambda p: (p.first, p.last))
                others = settled(places)
                ends = {w for p in (*exact, *others) for w in (p.first, p.last)}
                at = offsets_of(data, ends) if ends else {}
                lists = [[(p.label, at[p.first][0], at[p.last][1], p.first, p.last, p.edits) for p in some] for some in (exact, others)]
                counts.append(total)
                phrases.append(lists[0])
                fuzzy.append(lists[1])
                scores.append(1.0 if exact else max((1 - p.edits / p.length for p in others), default=0.0))
            names = [f.name for f in _SPAN_TYPE.value_type]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()),
                *(pa.array([[dict(zip(names, s)) for s in row] for row in col], _SPAN_TYPE) for col in (phrases, fuzzy)),
                pa.array(scores, pa.float64()),
            ], ["doc_id", "n_words", "phrases", "notices", "score"])

    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    with bounded_batches(docs.sparkSession):
        return stored(rows.mapInArrow(run, f"doc_id {kind}, n_words long, phrases {SPANS}, notices {SPANS}, score double"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last places, and labels of ``find_notices``."""
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.col("phrases.label")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"), F.array_max("phrases.first_word").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.col("notices.label"))).alias("labels"), "score",
    )
