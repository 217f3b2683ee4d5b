"""Transliteration and street labels as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from trackloom import constants as C


def transliterate(text: Column) -> Column:
    """KMU 2010 transliteration of Ukrainian text, letter by letter inside the JVM."""
    letters = F.create_map(*[F.lit(x) for pair in C.KMU_LETTERS.items() for x in pair])
    initials = F.create_map(*[F.lit(x) for pair in C.KMU_INITIAL_LETTERS.items() for x in pair])
    chars = F.split(text, "")
    apostrophes = [F.lit(a) for a in C.APOSTROPHES]

    def latin(char: Column, i: Column) -> Column:
        before = F.coalesce(F.get(chars, i - 1), F.lit(""))
        after = F.coalesce(F.get(chars, i + 1), F.lit(""))
        lower = F.lower(char)
        starts_word = ~before.rlike(r"^\p{L}$") & ~before.isin(*apostrophes)
        mapped = (
            F.when((lower == "г") & (F.lower(before) == "з"), F.lit("gh"))
            .when(starts_word, F.coalesce(F.try_element_at(initials, lower), F.try_element_at(letters, lower)))
            .otherwise(F.try_element_at(letters, lower))
        )
        is_upper, next_upper = char != lower, after != F.lower(after)
        cased = (
            F.when(is_upper & next_upper, F.upper(mapped))
            .when(is_upper, F.concat(F.upper(F.substring(mapped, 1, 1)), F.substring(mapped, 2, 9)))
            .otherwise(mapped)
        )
        return F.when(char.isin(*apostrophes), F.lit("")).otherwise(F.coalesce(cased, char))

    return F.when(text.isNotNull(), F.array_join(F.transform(chars, latin), ""))


@F.pandas_udf(T.StringType())
def _drop_accents(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii"),
        na_action="ignore",
    )


def to_ascii(text: Column) -> Column:
    """Drop diacritics and other non-ASCII characters. Only non-ASCII texts reach Python."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_drop_accents(F.when(foreign, text)), text)


def clean_filename_part(text: Column) -> Column:
    """Replace forbidden characters and collapse white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, C.FORBIDDEN_FILENAME_REGEX, " "), r"\s+", " "))


def drop_street_type_words(name: Column, words: tuple[str, ...]) -> Column:
    """Remove street-type words (compared in lowercase, without trailing ``,:;``)."""
    known = F.array(*[F.lit(w) for w in words])
    kept = F.filter(
        F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "),
        lambda w: ~F.array_contains(known, F.regexp_replace(F.lower(w), "[,:;]+$", "")),
    )
    return F.array_join(kept, " ")


def latin_ref(ref: Column) -> Column:
    """The first ref of a list in Latin letters, before diacritics are dropped."""
    return transliterate(F.element_at(F.split(ref, ";"), 1))


def normalize_ref(ref: Column) -> Column:
    """The first ref of a list, in ASCII without blanks and hyphens."""
    return F.regexp_replace(to_ascii(latin_ref(ref)), r"[\s\-]+", "")


def street_label(name: Column, name_en: Column, ref: Column, highway: Column) -> Column:
    """ASCII label of a street entry, or null when nothing is left of its name."""
    def given(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    own_name = given(name) & ~name.eqNullSafe(ref)
    by_ref = given(ref) & (F.coalesce(highway.isin(*C.REF_HIGHWAY_CLASSES), F.lit(False)) | ~own_name)
    # One pass through `to_ascii`, whichever rule gives the text.
    source = (
        F.when(by_ref, latin_ref(ref))
        .when(given(name_en), drop_street_type_words(name_en, C.ENGLISH_STREET_TYPE_WORDS))
        .when(given(name), transliterate(drop_street_type_words(name, C.UKRAINIAN_STREET_TYPE_WORDS)))
    )
    ascii_text = to_ascii(source)
    label = F.when(by_ref, F.regexp_replace(ascii_text, r"[\s\-]+", "")).otherwise(ascii_text)
    return F.nullif(clean_filename_part(label), F.lit(""))


def truncate_words(text: Column, length: Column) -> Column:
    """Cut a text to a length, at a word boundary if there is one."""
    cut = F.substring(text, F.lit(1), length)
    words = F.when(cut.contains(" "), F.regexp_extract(cut, r"^([\s\S]*) ", 1)).otherwise(cut)
    return F.when(F.length(text) <= length, text).otherwise(F.regexp_replace(words, "[ ,\\-]+$", ""))


def fit_street_labels(stretches: Column, length: Column) -> Column:
    """Join the labels of ``array<struct<label, distance_m>>`` within a length.

    The first and last label stay, then the longest stretches in between that still fit.
    """
    separator = F.lit(C.STREET_SEPARATOR)
    n = F.size(stretches)
    labels = F.transform(stretches, lambda s: s["label"])
    full = F.array_join(labels, C.STREET_SEPARATOR)
    first, last = F.element_at(labels, 1), F.element_at(labels, -1)
    ends = F.concat(first, separator, last)
    middle = F.array_sort(F.transform(
        F.slice(stretches, 2, F.greatest(n - 2, F.lit(0))),
        lambda s, i: F.struct((-s["distance_m"]).alias("d"), (i + 1).alias("i"), F.length(s["label"]).alias("n")),
    ))
    gap = len(C.STREET_SEPARATOR)
    state = F.struct(F.length(ends).alias("used"), F.array(F.lit(0), n - 1).alias("kept"))
    chosen = F.aggregate(
        middle, state,
        lambda s, m: F.when(
            s["used"] + gap + m["n"] <= length,
            F.struct((s["used"] + gap + m["n"]).alias("used"), F.concat(s["kept"], F.array(m["i"])).alias("kept")),
        ).otherwise(s),
    )["kept"]
    picked = F.array_join(
        F.transform(F.array_sort(chosen), lambda i: F.element_at(labels, i + 1)), C.STREET_SEPARATOR
    )
    return (
        F.when((F.length(full) <= length) | (n <= 1), truncate_words(full, length))
        .when(F.length(ends) > length, truncate_words(first, length))
        .otherwise(picked)
    )
