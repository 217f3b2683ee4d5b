"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a set of typical n-grams, learned by counting the n-grams of all labelled texts.
The sets lie in one array of slots, a bit per language: a lookup combines the slots of an n-gram's
hashes with AND, and what is left are all languages that contain it. Per text and language the hits
are counted, corrected for the false positives that the filter's fill implies, and the language with
the most wins.

Null texts and texts without a letter give ``und`` with score 0. Without labelled texts nothing is
known and every text is ``und``. Repeated rows are predicted once each. Ties go to the language that
comes first by code point. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, crc_mod, letters, mix, small_batches

GRAM = 3
#: An n-gram belongs to a language if it makes up at least this share of its n-grams ...
LEAST_SHARE = 3e-5
#: ... and at least this share of what it has where it is most frequent: stray labels fall away.
LEAST_RATIO = 0.05
#: N-grams per language, the most frequent first. This bounds the model, not the counting.
MOST_GRAMS = 30_000
BITS_PER_GRAM = 16
HASHES = 3
UNKNOWN = "und"

COUNTS = "lang string, gram long, n long"
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"

_SPACE = np.uint32(32)


def _letter_table() -> np.ndarray:
    """What each code point of the basic plane counts as: itself if a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x10000)), np.uint32, 0x10000)


_LETTERS: np.ndarray | None = None


@lru_cache(1 << 16)
def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


def _spaced(codes: np.ndarray) -> np.ndarray:
    """The code points with a space for those beyond the basic plane that are no letters."""
    high = codes >= 0x10000
    if not high.any():
        return codes
    found, where = np.unique(codes[high], return_inverse=True)
    codes = codes.copy()
    codes[high] = np.where([_is_letter(int(c)) for c in found], found, _SPACE)[where]
    return codes


def grams(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of letters and single word borders, and the text of each.

    Three code points of 16 bits; those beyond the basic plane are folded. An n-gram has a letter
    in its middle, so borders stand only at its ends.
    """
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    codes = _spaced(codes)
    folded = np.where(codes < 0x10000, codes, 0x8000 | (codes & 0x7FFF))
    plain = np.where(codes < 0x10000, _LETTERS[folded], folded)
    plain = plain.astype(np.uint64)
    if len(plain) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    packed = (plain[:-2] << np.uint64(32)) | (plain[1:-1] << np.uint64(16)) | plain[2:]
    good = (plain[1:-1] != 32) & (owners[:-2] == owners[2:])
    return packed[good], owners[1:-1][good]


def count_grams(labelled: DataFrame) -> DataFrame:
    """How often each n-gram occurs per language, over the whole texts of ``(text, lang)`` rows.

    Workers sum the counts of a batch first; the number of different n-grams, not the length of
    the texts, is what is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts = held.setdefault(lang, [])
                for codes, owners in letters([t.lower() for t in texts if isinstance(t, str)], GRAM - 1):
                    parts.append(np.unique(grams(codes, owners)[0], return_counts=True))
                if len(parts) > 16:
                    held[lang] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:  # hand on what is summed so far
                yield from frames(held, merged)
                held = {}
        yield from frames(held, merged)

    def frames(held: dict, merged) -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            if parts:
                keys, n = merged(parts)
                yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n})

    small_batches(labelled.sparkSession)
    return (
        labelled.select("text", "lang").mapInPandas(count, COUNTS)
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )


@dataclass
class LanguageFilter:
    """Slots with a bit per language; ``fill`` is the share of set bits per language."""

    langs: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    fill: np.ndarray

    @classmethod
    def build(cls, grams_by_lang: dict[str, np.ndarray]) -> LanguageFilter:
        langs = sorted(grams_by_lang)
        most = max((len(g) for g in grams_by_lang.values()), default=0)
        size = 1 << max(10, (most * BITS_PER_GRAM - 1).bit_length())
        slots = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
        fill = np.zeros(len(langs))
        for number, lang in enumerate(langs):
            for at in cls._places(grams_by_lang[lang].astype(np.uint64), size):
                slots[at, number // 64] |= np.uint64(1 << (number % 64))
            fill[number] = ((slots[:, number // 64] >> np.uint64(number % 64)) & np.uint64(1)).mean()
        return cls(langs, slots, fill)

    @staticmethod
    def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        spread = mix(keys)
        for n in range(HASHES):
            yield ((spread >> np.uint64(21 * n)) & np.uint64(size - 1)).astype(np.int64)

    def hits(self, keys: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
        """(texts, languages + 1): n-grams that a language contains, and all n-grams, per text."""
        found = None
        for at in self._places(keys, len(self.slots)):
            found = self.slots[at] if found is None else found & self.slots[at]
        out = np.zeros((texts, len(self.langs) + 1))
        for number in range(len(self.langs)):
            bit = (found[:, number // 64] >> np.uint64(number % 64)) & np.uint64(1)
            out[:, number] = np.bincount(owners, bit, texts)
        out[:, -1] = np.bincount(owners, minlength=texts)
        return out

    def decide(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language number per text (-1 without letters) and its share of the corrected hits."""
        total = hits[:, -1:]
        false = self.fill**HASHES
        corrected = np.clip((hits[:, :-1] - total * false) / (1 - false), 0, None)
        best = corrected.argmax(axis=1)
        top = corrected[np.arange(len(hits)), best]
        score = np.where(total[:, 0] > 0, top / np.maximum(total[:, 0], 1), 0.0)
        return np.where(total[:, 0] > 0, best, -1), np.clip(score, 0, 1)


def learn(labelled: DataFrame) -> LanguageFilter:
    """Learn the filters from all ``(text, lang)`` rows with a language.

    At most ``MOST_GRAMS`` n-grams per language reach the driver.
    """
    counts = count_grams(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    # a language has at most 1 / LEAST_SHARE n-grams of that share, so what follows is small
    kept = {}
    best: dict[int, float] = {}
    rows = shares.select("lang", "gram", "share").collect()
    for r in rows:
        best[r["gram"]] = max(best.get(r["gram"], 0.0), r["share"])
    for r in sorted(rows, key=lambda r: (-r["share"], r["gram"])):
        found = kept.setdefault(r["lang"], [])
        if r["share"] >= LEAST_RATIO * best[r["gram"]] and len(found) < MOST_GRAMS:
            found.append(r["gram"])
    return LanguageFilter.build({lang: np.asarray(g, np.int64) for lang, g in kept.items()})


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` rows ``(doc_id, held_out, text)`` with the predicted language of the whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = [t.lower() if isinstance(t, str) else "" for t in batch["text"]]
            hits = np.zeros((len(texts), len(model.langs) + 1))
            if model.langs:
                for codes, owners in letters(texts, GRAM - 1):
                    keys, of = grams(codes, owners)
                    hits += model.hits(keys, of, len(texts))
            best, share = model.decide(hits) if model.langs else (np.full(len(texts), -1), np.zeros(len(texts)))
            names = np.array([*model.langs, UNKNOWN], dtype=object)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                "lang_pred": names[best], "score": share,
            })

    small_batches(spark)
    return docs.select("doc_id", "held_out", "text").mapInPandas(score, PREDICTIONS)


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row."""
    rows = chosen(docs, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)))
    return predict(rows, learn(rows.where(~F.col("held_out"))))
