"""Personal data by weak supervision.

Candidates come from patterns: the base kinds (email, ip, card, phone), base matches that fail their
check, and looser forms. Labelers vote on each candidate, for (1), against (-1) or not at all (0):
the pattern's own check, a gazetteer (domain endings, country codes, card prefixes, address ranges),
the words before it, and its borders. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without labels. Its posteriors train a logistic classifier of
spans, which decides on candidates that are not base spans; base spans always stay.

Everything that touches texts is column expressions. Only the counts of (kind, votes) patterns, at
most ``kinds * 3**labelers`` rows, reach the driver. Null texts count as empty. Repeated rows are
scanned once each. Without candidates the classifier accepts nothing. Extra columns are kept by
``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import stored
from trackloom.llm.spans import MARK, chunks, cut, found, joined, let, larger, listed, running, smaller

# The base patterns, with separators inside a run marked where a group would repeat.
_LOCAL = rf"[A-Za-z0-9._%+{MARK}-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+{MARK}[A-Za-z0-9{MARK}-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]{{15,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms that the method adds.
SPELLED = r"(?i)\b[A-Z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Z0-9-]{1,63} ?[\[(]dot[\])] ?[A-Z]{2,10}\b"
LOCAL_PHONE = r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|br|mx|jp|cn|in|ru|pl|se|no"
COUNTRY_CODES = r"\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIXES = r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED_IPS = r"(?:0|10|127|169\.254|192\.168|2[2-5][0-9])\."
FOR_WORDS = {
    "email": "mail|contact|write to|correo|courriel", "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell|anruf",
    "spelled": "mail|contact|write to|correo|courriel", "local_phone": "phone|tel|call|fax|mobile|cell|anruf",
    "social": "ssn|social security|tax id",
}
AGAINST_WORDS = "version|release|build|isbn|order|invoice|serial|hash|token|part no|figure|section"

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("spelled", "local_phone", "social")
LABELERS = ("check", "gazetteer", "context", "borders")
CONTEXT_CHARS = 40
ROUNDS = 50
STEPS = 300

Votes = tuple[str, int, int, int, int]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether no part is above 255, however many zeros lead it."""
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(text, r"\."), small)


def _check(kind: str, text: Column) -> Column:
    """The condition under which a match of a base kind is a base span."""
    digits = _digits(text)
    return {
        "email": F.lit(True),
        "ip": _octets(text),
        "card": F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19)),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _gazetteer(kind: str, text: Column) -> Column:
    return {
        "email": text.rlike(rf"(?i)\.(?:{ENDINGS})$"),
        "ip": ~text.rlike(rf"^{RESERVED_IPS}"),
        "card": _digits(text).rlike(f"^{CARD_PREFIXES}"),
        "phone": text.rlike(f"^{COUNTRY_CODES}"),
        "spelled": text.rlike(rf"(?i)[\])] ?(?:{ENDINGS})$"),
        "local_phone": text.rlike("^[(]?[2-9][0-9][0-9]"),
        "social": ~text.rlike("^(?:000|666|9)"),
    }[kind]


def matches(text: Column) -> dict[str, Column]:
    """Per kind the matches of its pattern in a text."""
    # only texts with a sign of a kind are prepared and searched for it
    dotted = F.when(text.contains("@"), joined(text, "[A-Za-z0-9-]", r"\.", "[A-Za-z0-9-]")).otherwise("")
    number = F.when(text.rlike("[0-9](?:[ -]?[0-9]){15}"), joined(text, "[0-9]", "[ -]", "[0-9]")).otherwise("")
    return {
        "email": found(dotted, EMAIL, "."),
        "ip": found(text, IP),
        "card": found(number, CARD, "-"),  # only the digits count
        "phone": found(text, PHONE, when=text.contains("+")),
        "spelled": found(text, SPELLED, when=text.rlike("(?i)[(\\[]at[)\\]]")),
        "local_phone": found(text, LOCAL_PHONE, when=text.rlike("[0-9]{3}[.-][0-9]{4}")),
        "social": found(text, SOCIAL, when=text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    }


def candidates(text: Column) -> Column:
    """All candidates of a text: (kind, start, end, base, check, gazetteer, context, borders)."""

    def voter(number: int, kind: str, pieces: Column):
        def voted(s: Column) -> Column:
            first = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            before = F.lower(cut(pieces, first, s["start"] - first))
            around = F.concat(F.right(before, F.lit(1)), F.lit(" "), cut(pieces, s["end"], F.lit(1)))
            passes = _check(kind, s["text"]) if kind in BASE_KINDS else F.lit(False)
            context = F.when(before.rlike(rf"\b(?:{AGAINST_WORDS})\W{{0,3}}$"), -1).when(
                before.rlike(rf"\b(?:{FOR_WORDS[kind]})\b"), 1
            ).otherwise(0)
            return F.struct(
                F.lit(number).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                passes.alias("base"),
                (F.when(passes, 1).otherwise(-1) if kind in BASE_KINDS else F.lit(0)).alias("check"),
                F.when(_gazetteer(kind, s["text"]), 1).otherwise(-1).alias("gazetteer"),
                context.alias("context"),
                F.when(around.rlike("[A-Za-z0-9_@/]"), -1).otherwise(1).alias("borders"),
            )

        return voted

    def voted(kind: str, number: int, spans: Column) -> Column:
        # most texts have no match of a kind and are not cut into pieces
        return let(spans, lambda all_spans: let(
            F.when(F.size(all_spans) > 0, chunks(text)), lambda pieces: F.transform(all_spans, voter(number, kind, pieces))
        ))

    return F.concat(*(voted(kind, n, spans) for n, (kind, spans) in enumerate(matches(text).items())))


def vote_counts(found_candidates: DataFrame) -> dict[Votes, int]:
    """How many candidates have each pattern of votes: a bounded table, whatever the corpus."""
    votes = found_candidates.select(F.explode("candidates").alias("c")).groupBy(
        *(F.col(f"c.{x}").alias(x) for x in ("kind", *LABELERS))
    ).agg(F.count("*").alias("n"))
    return {(r["kind"], *(r[x] for x in LABELERS)): r["n"] for r in votes.collect()}


def estimate(counts: dict[Votes, int], rounds: int = ROUNDS) -> dict[Votes, float]:
    """Posterior of each vote pattern by expectation-maximisation.

    Two classes per kind with votes that are independent given the class. Labelers start as right
    in 80 of 100 votes; a small prior keeps every share above zero.
    """
    kinds = sorted({v[0] for v in counts})
    prior = dict.fromkeys(kinds, 0.5)
    shares = [{(y, v): {1: (0.05, 0.15, 0.8), 0: (0.8, 0.15, 0.05)}[y][v + 1] for y in (0, 1) for v in (-1, 0, 1)} for _ in LABELERS]
    posterior: dict[Votes, float] = {}
    for _ in range(rounds):
        for votes in counts:
            odds = math.log(prior[votes[0]] / (1 - prior[votes[0]]))
            odds += sum(math.log(s[1, v] / s[0, v]) for s, v in zip(shares, votes[1:]))
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(n, posterior[v]) for v, n in counts.items() if v[0] == kind]
            prior[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for number, share in enumerate(shares):
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                # what a labeler is expected to do weighs like ten candidates
                for v in (-1, 0, 1):
                    mass[v] += 10 * {1: (0.05, 0.15, 0.8), 0: (0.8, 0.15, 0.05)}[y][v + 1]
                for votes, n in counts.items():
                    mass[votes[number + 1]] += n * (posterior[votes] if y else 1 - posterior[votes])
                total = sum(mass.values())
                share.update({(y, v): m / total for v, m in mass.items()})
    return posterior


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights of the kinds and of each labeler's votes for and against."""

    kinds: dict[str, float]
    votes: tuple[tuple[float, float], ...]

    def accepts(self, candidate: Column) -> Column:
        """Whether a candidate is personal data (probability of at least a half)."""
        odds = F.lit(0.0)
        for kind, weight in self.kinds.items():
            odds = odds + F.when(candidate["kind"] == kind, weight).otherwise(0.0)
        for name, (up, down) in zip(LABELERS, self.votes):
            odds = odds + F.when(candidate[name] == 1, up).when(candidate[name] == -1, down).otherwise(0.0)
        return odds >= 0


def train(counts: dict[Votes, int], posterior: dict[Votes, float], steps: int = STEPS) -> SpanClassifier:
    """Fit the classifier to the posteriors by gradient descent over the vote patterns."""
    kinds = {k: 0.0 for k in (*BASE_KINDS, *ADDED_KINDS)}
    votes = [[0.0, 0.0] for _ in LABELERS]
    total = sum(counts.values())
    for _ in range(steps if total else 0):
        by_kind, by_vote = dict.fromkeys(kinds, 0.0), [[0.0, 0.0] for _ in LABELERS]
        for pattern, n in counts.items():
            odds = kinds[pattern[0]] + sum(w[0] if v == 1 else w[1] if v == -1 else 0.0 for w, v in zip(votes, pattern[1:]))
            error = n / total * (posterior[pattern] - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            by_kind[pattern[0]] += error
            for slope, v in zip(by_vote, pattern[1:]):
                if v:
                    slope[0 if v == 1 else 1] += error
        for kind, slope in by_kind.items():
            kinds[kind] += 2.0 * slope
        for weight, slope in zip(votes, by_vote):
            weight[0] += 2.0 * slope[0]
            weight[1] += 2.0 * slope[1]
    if not total:
        kinds = dict.fromkeys(kinds, -1.0)
    return SpanClassifier(kinds, tuple((w[0], w[1]) for w in votes))


def accepted(found_candidates: Column, model: SpanClassifier) -> Column:
    """Base spans, and other candidates that the classifier accepts and that meet no base span."""
    none = F.lit(2**31 - 1)
    chosen = F.filter(found_candidates, lambda c: c["base"] | model.accepts(c))

    def free(base: Column, added: Column) -> Column:
        # in the order of starts an added span meets an earlier base span by the largest end so far, and
        # a later one by the smallest start to come
        return let(F.array_sort(F.transform(F.concat(base, added), lambda c: F.struct(c["start"].alias("at"), c.alias("c")))), lambda rows: F.filter(
            F.arrays_zip(
                rows.alias("row"),
                running(F.transform(rows, lambda r: F.when(r["c"]["base"], r["c"]["end"]).otherwise(0)), larger, F.lit(0)).alias("ended"),
                F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["c"]["base"], r["at"]).otherwise(none))), smaller, none)).alias("begins"),
            ),
            lambda z: ~z["row"]["c"]["base"] & (z["ended"] <= z["row"]["at"]) & (z["begins"] >= z["row"]["c"]["end"]),
        ))

    def merged(rows: Column) -> Column:
        base, added = F.filter(rows, lambda c: c["base"]), F.filter(rows, lambda c: ~c["base"])
        apart = F.transform(free(base, added), lambda z: z["row"]["c"])
        return F.array_sort(F.when((F.size(added) == 0) | (F.size(base) == 0), rows).otherwise(F.concat(base, apart)))

    return let(chosen, merged)


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: all personal data of each document, by kind and start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", candidates(text).alias("candidates")))
    counts = vote_counts(rows)
    model = train(counts, estimate(counts))
    return rows.select("doc_id", accepted(F.col("candidates"), model).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts and digests of ``find``."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found_spans.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``n_chars`` to match.

    Spans that overlap are replaced together, so that no part of one stays.
    Texts without personal data stay as they are. The classifier learns from all of ``docs`` first;
    the spans are then found again next to the text, so that no text is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = vote_counts(docs.select(candidates(text).alias("candidates")))
    model = train(counts, estimate(counts))
    # a column of its own at each step: an expression that is used twice would search twice
    staged = docs.withColumn("_pii_candidates", candidates(text)).withColumn(
        "_pii_spans", F.array_sort(F.transform(accepted(F.col("_pii_candidates"), model), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
        )))
    )

    def named(spans: Column) -> Column:
        # spans that meet become one, named by the first: a span opens one if all before it have ended
        ends = running(F.transform(spans, lambda s: s["end"]), larger, F.lit(0))
        return let(ends, lambda ended: let(F.zip_with(
            spans, F.concat(F.array(F.lit(0)), F.slice(ended, 1, F.size(ended) - 1)),
            lambda s, before: F.struct(s["start"].alias("start"), before.alias("before"), s["kind"].alias("kind")),
        ), lambda rows: F.filter(rows, lambda r: r["start"] >= r["before"])))

    def replaced(spans: Column, pieces: Column) -> Column:
        parts = F.transform(named(spans), lambda r: F.concat(
            cut(pieces, r["before"], r["start"] - r["before"]), F.lit("<"), F.upper(r["kind"]), F.lit(">")
        ))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, last, F.length(text) - last))

    clean = let(chunks(text), lambda pieces: replaced(F.col("_pii_spans"), pieces))
    changed = staged.withColumn("text", F.when(F.size("_pii_spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))
