"""Pattern matches and their places as column expressions, without leaving the JVM.

A text is split at its matches; running sums of the lengths of the pieces and of the matches give the
places, in a time that grows with the matches times their logarithm.
Places are code points, ends exclusive. Patterns hold no group that repeats without bound: the JVM
matches those by recursion, and a long text would exhaust its stack. Where a rule needs one, the
separators inside a run are first replaced by a mark of the same length (``joined``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a separator between two characters of a run; a text's own marks become another one.
MARK, OWN_MARK = "\u0001", "\u0002"
#: Characters of one piece of a text that is cut at many places.
CHUNK = 256
SPAN = "array<struct<start:int,end:int,text:string>>"


def joined(text: Column, before: str, separators: str, after: str) -> Column:
    """The text with ``MARK`` for each separator that stands between two of the given characters."""
    return F.regexp_replace(
        F.translate(text, MARK, OWN_MARK), f"(?<={before}){separators}(?={after})", MARK
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """``op`` over each value and all before it, for an associative ``op`` with a neutral value.

    Every round combines each value with the one 1, 2, 4, .. places before it, so that m values take
    about m * log(m) steps.
    """

    def doubled(a: Column, j: Column) -> Column:
        by = F.least(F.call_function("shiftleft", F.lit(1), j), F.size(a))
        return F.zip_with(F.concat(F.array_repeat(neutral, by), F.slice(a, 1, F.size(a) - by)), a, op)

    # as many rounds as the number of values has binary digits
    return let(values, lambda v: F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(v)))), v, lambda a, j: doubled(a, j - 1)))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def chunks(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` characters, from which ``cut`` takes parts."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """The part of a text in ``chunks`` from a place on, without walking the text from its start."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((start + length) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length)


def found(text: Column, pattern: str, separator: str | None = None, when: Column | None = None) -> Column:
    """All matches, leftmost first and not overlapping, as an array of (start, end, text).

    ``separator`` takes the place of each ``MARK`` in the matched texts, where the searched text is
    ``joined``. ``when`` is a cheap condition that must hold for any match; elsewhere nothing is
    searched.
    """

    def placed(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: spans(
            # one entry per match: the length of the piece before it, and the match
            F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("skip"), x.alias("text")))
        ))

    def spans(steps: Column) -> Column:
        return let(steps, lambda all_steps: F.zip_with(
            running(F.transform(all_steps, lambda x: x["skip"] + F.length(x["text"])), lambda a, b: a + b, F.lit(0)), all_steps,
            lambda end, x: F.struct(
                (end - F.length(x["text"])).alias("start"), end.alias("end"),
                (F.translate(x["text"], MARK, separator) if separator else x["text"]).alias("text"),
            ),
        ))

    empty = F.array().cast(SPAN)
    searched = let(text, lambda t: F.when(t.rlike(pattern), placed(t)).otherwise(empty))
    return (searched if when is None else F.when(F.coalesce(when, F.lit(False)), searched).otherwise(empty)).cast(SPAN)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of (.., kind, start, end) structs in the given order, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
