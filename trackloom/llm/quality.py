"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax
over that average gives the classes. Vectors and output weights are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. Scoring covers whole texts: because the
output is linear in the average, each hash bucket has one learned number (its vector times the
output weights), and a text's score needs only the sum of those numbers.

Null texts count as empty and are scored by the bias alone. A null label is no label. Without
labels, or with one class only, the score is the share of label 1 (0.5 without labels). Repeated
rows are scored once each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, crc_mod, letters, mix, small_batches

#: Labelled rows that are learned from, at most: those with the smallest hashes of their ids.
MOST_LABELLED = 6_000
BUCKETS = 1 << 17
DIMENSIONS = 8
#: Character n-grams run over everything but line breaks; words are what white space separates.
GRAMS = (3, 5)
EPOCHS = 5
RATE = 0.5
SEED = 11

FEATURES = "buckets binary, counts binary, wide int, label int, number long"
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def features(codes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of the character n-grams, words and word pairs of code points.

    A pair is hashed as the difference of its words, so a word that repeats itself is the same
    feature whatever the word.
    """
    wide = codes.astype(np.uint64)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    for n in GRAMS:
        if len(wide) >= n:
            key = wide[: len(wide) - n + 1].copy()
            for k in range(1, n):
                key *= np.uint64(0x100000001B3)
                key += wide[k : len(wide) - n + 1 + k]
            inside = owners[: len(key)] == owners[n - 1 :]
            yield owners[: len(key)][inside], _bucket(key[inside], n)
    edge = np.flatnonzero(np.diff((~white).astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts):
        # a word's hash: difference of a running polynomial, shifted to a common origin
        terms = wide * _weights(len(wide))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        words = (sums[ends] - sums[starts]) * _inverse_weights(len(wide))[starts]
        of = owners[starts]
        yield of, _bucket(words, 1)
        pairs = of[1:] == of[:-1]
        yield of[1:][pairs], _bucket((words[1:] - words[:-1])[pairs], 2)


def _bucket(key: np.ndarray, salt: int) -> np.ndarray:
    return (mix(key + np.uint64(salt)) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if len(_TABLES.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _TABLES[base] = np.multiply.accumulate(steps)
    return _TABLES[base][:n]


def _weights(n: int) -> np.ndarray:
    return _table(_BASE, n)


def _inverse_weights(n: int) -> np.ndarray:
    return _table(_INVERSE, n)


def labelled_features(rows: DataFrame) -> DataFrame:
    """Bucket counts of ``(text, label, number)`` rows: all of a text, in as few bytes as hold its largest."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label, number in zip(batch["text"], batch["label"], batch["number"]):
                counts = np.zeros(BUCKETS, np.int64)
                for codes, owners in letters([text], max(GRAMS) - 1):
                    for _, bucket in features(codes, owners):
                        counts += np.bincount(bucket, minlength=BUCKETS)
                used = np.flatnonzero(counts)
                wide = np.min_scalar_type(counts.max()).itemsize
                yield pd.DataFrame({
                    "buckets": [used.astype("<i4").tobytes()], "counts": [counts[used].astype(f"<u{wide}").tobytes()],
                    "wide": [wide], "label": [label], "number": [number],
                })

    small_batches(rows.sparkSession)
    return rows.select("text", "label", "number").mapInPandas(extract, FEATURES)


class FiledTexts(Sequence):
    """``(buckets, counts, label)`` of labelled texts in a temporary file of the driver, one read at a time.

    Whole texts of any length thus take disk, not memory. The order is that of numbers, labels and contents.
    """

    def __init__(self, rows: Iterable[Row]):
        self.file = tempfile.TemporaryFile()
        entries, at = [], 0
        for r in rows:
            self.file.write(r["buckets"])
            self.file.write(r["counts"])
            digest = hashlib.sha256(r["buckets"] + r["counts"]).digest()
            entries.append((r["number"], r["label"], digest, at, len(r["buckets"]), len(r["counts"]), r["wide"]))
            at += len(r["buckets"]) + len(r["counts"])
        self.entries = sorted(entries)
        self.labels = [e[1] for e in self.entries]

    def __len__(self) -> int:
        return len(self.entries)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        _, label, _, at, first, second, wide = self.entries[i]
        self.file.seek(at)
        return np.frombuffer(self.file.read(first), "<i4"), np.frombuffer(self.file.read(second), f"<u{wide}"), label


@dataclass
class SubwordModel:
    """Log odds of label 1: the average of ``table`` over a text's features, plus ``bias``."""

    table: np.ndarray
    bias: float

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        """Per whole text."""
        sums, totals = np.zeros(len(texts)), np.zeros(len(texts))
        for codes, owners in letters(texts, max(GRAMS) - 1):
            first = int(owners[0])
            many = int(owners[-1]) - first + 1
            for of, bucket in features(codes, owners):
                of = of - first
                sums[first : first + many] += np.bincount(of, self.table[bucket], many)
                totals[first : first + many] += np.bincount(of, minlength=many)
        return sums / np.maximum(totals, 1) + self.bias


def train(texts: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> SubwordModel:
    """Stochastic gradient descent over ``(buckets, counts, label)``, one text at a step.

    The input vectors start small and random, the output weights at zero, and the step falls
    linearly to zero. Texts come in a new seeded order in each epoch.
    """
    labels = np.array(texts.labels if isinstance(texts, FiledTexts) else [label for _, _, label in texts], np.int64)
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(odds))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets, counts, label = texts[i]
            now = rate * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            weights = (counts / counts.sum()).astype(np.float32)
            hidden = weights @ vectors[buckets]
            logits = hidden @ output + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = output @ error
            output -= now * np.outer(hidden, error)
            bias -= now * 0.01 * error
            # the average spreads the gradient thinly over many features; undo it by their number
            vectors[buckets] -= (now * len(buckets)) * weights[:, None] * back
    difference = output[:, 1] - output[:, 0]
    return SubwordModel((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> SubwordModel:
    """Train on at most ``most`` labelled rows of ``docs``: a sample by hash, the same at every run."""
    spark = docs.sparkSession
    small = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .withColumn("number", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("number", "doc_id", "label").limit(most)
    )
    rows = docs.join(F.broadcast(small), "doc_id").select("text", "label", "number")  # at most `most` ids
    return train(FiledTexts(labelled_features(rows).toLocalIterator()))


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """``(doc_id, held_out, text)`` rows with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odds = shared.value.log_odds([t if isinstance(t, str) else "" for t in batch["text"]])
            chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                "score": chance, "predicted": (chance >= 0.5).astype(np.int32),
            })

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "held_out", "text").mapInPandas(run, SCORES)


def seen_labels(labels: DataFrame, fold: int, held: int) -> DataFrame:
    """``(doc_id, label)`` outside the held-out fold."""
    known = chosen(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & (crc_mod("doc_id", fold) != held))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """Learn from labelled rows outside the held-out fold and score every row."""
    rows = chosen(docs, "doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)))
    return score(rows, learn(rows, seen_labels(labels, fold, held)))


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """The documents of predicted label 1, with all their columns.

    Only texts go to the workers and only scores come back, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(chosen(docs, "doc_id", "text"), seen_labels(labels, fold, held)))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.log_odds([t if isinstance(t, str) else "" for t in texts]) >= 0)

    return docs.where(good(F.col("text")))
