"""Parsing of overlay texts, clip names and trip names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackloom import constants as C


def _part(text: Column, regex: str, group: int) -> Column:
    """A regex group, or null when it did not take part in the match."""
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def is_reliable(text: Column, score: Column) -> Column:
    """A non-empty text whose lowest cell score is good enough."""
    return F.coalesce((text != "") & (score >= C.RELIABLE_SCORE), F.lit(False))


def gps_parts(text: Column) -> Column:
    """Speed, hemisphere, latitude, hemisphere and longitude as strings ('' where absent).

    Null when the text does not have the format. Keep it as a column of its own: everything
    derived from it then needs no further pattern matching.
    """
    split = F.split(F.regexp_replace(text, C.GPS_TEXT_REGEX, "$1,$2,$3,$4,$5"), ",")
    return F.when(text.rlike(C.GPS_TEXT_REGEX), split)


def gps_from_parts(parts: Column) -> Column:
    """Struct of speed, latitude and longitude; null without both valid coordinates."""
    lat = F.get(parts, 2).try_cast("double") * F.when(F.get(parts, 1) == "S", -1).otherwise(1)
    lon = F.get(parts, 4).try_cast("double") * F.when(F.get(parts, 3) == "W", -1).otherwise(1)
    gps = F.struct(
        F.get(parts, 0).try_cast("int").alias("speed_kmh"), lat.alias("lat"), lon.alias("lon")
    )
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), gps)


def parse_gps_text(text: Column) -> Column:
    """Struct of speed, latitude and longitude of a GPS text, or null."""
    return gps_from_parts(gps_parts(text))


def clock_parts(text: Column) -> Column:
    """The six numbers of a clock text as strings, or null when it does not have the format."""
    # one plain separator: splitting by a pattern would compile it for every row
    spaced = F.translate(text, "/.:", "   ")
    return F.when(text.rlike(C.CLOCK_TEXT_REGEX), F.split(spaced, " "))


def clock_numbers(parts: Column) -> Column:
    """Struct of the numbers in the parts of a clock text and the widths of its outer date numbers, else null.

    Keep it as a column of its own: what is derived from it then converts no text again.
    """
    names = ("first", "middle", "last", "hour", "minute", "second")
    return F.when(parts.isNotNull(), F.struct(
        *[F.get(parts, i).cast("int").alias(name) for i, name in enumerate(names)],
        F.length(F.get(parts, 0)).alias("first_width"), F.length(F.get(parts, 2)).alias("last_width"),
    ))


def year_last_numbers(parts: Column) -> Column:
    """Struct of the first two numbers of a date written with the year last, else null."""
    numbers = clock_numbers(parts)
    return F.when(
        numbers["last_width"] == 4,
        F.struct(numbers["first"].alias("first"), numbers["middle"].alias("middle")),
    )


def split_year_last_date(text: Column) -> Column:
    """Struct of the first two numbers of a clock text with the year last, else null."""
    return year_last_numbers(clock_parts(text))


def clock_from_parts(parts: Column, day_first: bool = True) -> Column:
    """Local wall time (as a UTC-session timestamp) from the parts of a clock text, or null."""
    numbers = clock_numbers(parts)
    return F.coalesce(clock_year_first(numbers), clock_year_last(numbers, day_first))


def clock_year_first(numbers: Column) -> Column:
    """Local wall time from the numbers of a clock text with the year first, or null."""
    is_year_first = (numbers["first_width"] == 4) & (numbers["last_width"] <= 2)
    return F.when(
        _is_time(numbers) & is_year_first,
        _moment(numbers["first"], numbers["middle"], numbers["last"], _day_seconds(numbers)),
    )


def clock_year_last(numbers: Column, day_first: bool = True) -> Column:
    """Local wall time from the numbers of a clock text with the year last, or null."""
    is_year_last = (numbers["last_width"] == 4) & (numbers["first_width"] <= 2)
    day, month = ("first", "middle") if day_first else ("middle", "first")
    return F.when(
        _is_time(numbers) & is_year_last,
        _moment(numbers["last"], numbers[month], numbers[day], _day_seconds(numbers)),
    )


def _is_time(numbers: Column) -> Column:
    return (numbers["hour"] <= 23) & (numbers["minute"] <= 59) & (numbers["second"] <= 59)


def _day_seconds(numbers: Column) -> Column:
    return numbers["hour"] * 3600 + numbers["minute"] * 60 + numbers["second"]


def _moment(year: Column, month: Column, day: Column, seconds: Column) -> Column:
    """Timestamp of a valid calendar day, or null. Whole-number checks avoid failed attempts."""
    is_leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(is_leap, 29).otherwise(28)).when(
        month.isin(4, 6, 9, 11), 30
    ).otherwise(31)
    is_valid = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= days)
    return F.when(is_valid, F.timestamp_seconds(
        F.unix_date(F.make_date(year, month, day)).cast("long") * 86400 + seconds
    ))


def parse_clock_text(text: Column, day_first: bool = True) -> Column:
    """Local wall time shown by the camera clock (as a UTC-session timestamp), or null."""
    return clock_from_parts(clock_parts(text), day_first)


def clock_offset_s(text: Column, t: Column) -> Column:
    """Clock reading minus video offset in seconds, free of time zones."""
    return F.unix_timestamp(parse_clock_text(text)) - t


def normalize_coordinate(text: Column) -> Column:
    """A coordinate token with the hemisphere letter first and without spaces."""
    letter = F.regexp_extract(text, "([NSEW])", 1)
    number = F.regexp_replace(F.regexp_replace(text, letter, F.lit("")), " ", "")
    return F.concat(letter, number)


# --- file names -----------------------------------------------------------------------------


def suffix(filename: Column) -> Column:
    """The extension with its dot ('' for none, or when the dot starts or ends the name)."""
    return F.regexp_extract(filename, r"[^.].*?(\.[^.]+)$", 1)


def stem(filename: Column) -> Column:
    """A filename without its extension."""
    return F.substring(filename, F.lit(1), F.length(filename) - F.length(suffix(filename)))


def resolve_stem(name: Column) -> Column:
    """A user-given video file, track file or bare name, as the bare name."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    known = F.lower(suffix(base)).isin([f".{e}" for e in C.VIDEO_EXTENSIONS] + [".json"])
    return F.when(known, stem(base)).otherwise(base)


def is_video(filename: Column) -> Column:
    return F.lower(suffix(filename)).isin([f".{e}" for e in C.VIDEO_EXTENSIONS])


def trip_date(filename: Column) -> Column:
    """The date a video name starts with, or null if there is none or it is not a real date."""
    return F.try_to_date(_part(stem(filename), C.TRIP_NAME_REGEX, 1), "yyyy-MM-dd")


def trip_name(filename: Column) -> Column:
    """The name after the date; the whole stem without a date or without any more text."""
    rest = _part(stem(filename), C.TRIP_NAME_REGEX, 2)
    return F.when(trip_date(filename).isNull(), stem(filename)).otherwise(
        F.coalesce(rest, stem(filename))
    )


def clip_start_time(clip_stem: Column, mtime: Column) -> Column:
    """Start of a clip from its name; for other numbered names the modification second."""
    from_name = F.try_to_timestamp(_part(clip_stem, C.CLIP_NAME_REGEX, 1), F.lit("yyyyMMddHHmmss"))
    numbered = clip_stem.rlike(C.TRAILING_INDEX_REGEX)
    return F.when(clip_stem.rlike(C.CLIP_NAME_REGEX), from_name).when(
        numbered, F.date_trunc("second", mtime)
    )


def clip_index(clip_stem: Column) -> Column:
    """The number at the end of a clip name, or null."""
    return _part(clip_stem, C.TRAILING_INDEX_REGEX, 1).try_cast("long")


def is_parking_clip(clip_stem: Column) -> Column:
    return clip_stem.rlike(C.PARKING_CLIP_REGEX)


def placeholder_name(start_time: Column) -> Column:
    return F.date_format(start_time, "yyyy-MM-dd 'Trip' HH-mm")


def max_filename_bytes(filename: Column) -> Column:
    """Longest name whose track and preview names still fit the file system."""
    own = F.length(suffix(filename))
    return F.lit(C.MAX_FILENAME_BYTES) - F.greatest(F.lit(len(".json")), own) + own


def filename_length_problem(filename: Column) -> Column:
    """Why a video name is too long, or null."""
    limit, size = max_filename_bytes(filename), F.octet_length(filename)
    unit = F.when(size == F.length(filename), F.lit("characters")).otherwise(F.lit("bytes in UTF-8"))
    return F.when(
        size > limit,
        F.concat(F.lit("use at most "), limit, F.lit(" "), unit, F.lit(" ("), size, F.lit(" now)")),
    )


def filename_problem(filename: Column, extension: Column) -> Column:
    """The first reason to reject a name typed by a user, or null."""
    return (
        F.when(filename.rlike(r"[^\x00-\x7F]"), F.lit("use ASCII characters only"))
        .when(
            filename.rlike(C.FORBIDDEN_FILENAME_REGEX),
            F.lit(f"do not use any of {C.FORBIDDEN_FILENAME_TEXT}"),
        )
        .when(
            F.length(filename) > C.MAX_FILENAME_LENGTH,
            F.concat(
                F.lit(f"use at most {C.MAX_FILENAME_LENGTH} characters ("),
                F.length(filename), F.lit(" now)"),
            ),
        )
        .when(trip_date(filename).isNull(), F.lit("start with the date (YYYY-mm-dd)"))
        .when(
            F.lower(suffix(filename)) != F.lower(extension),
            F.concat(F.lit("keep the "), extension, F.lit(" extension")),
        )
    )


def is_single_path_component(name: Column) -> Column:
    """Whether a name cannot leave its folder."""
    return (name != "") & ~name.startswith(".") & ~name.rlike(r"[/\\:\x00]")


def matches_globs(filename: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a name matches any include glob (none = all) and no exclude glob."""
    def any_of(patterns):
        return filename.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns))

    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def glob_to_regex(pattern: str) -> str:
    """Translate a file glob (``*``, ``?``, ``[...]``) to an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        char = pattern[i]
        closing = pattern.find("]", i + 2) if char == "[" else -1
        if closing > 0:
            body = pattern[i + 1 : closing].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = closing
        elif char == "*":
            out += "[\\s\\S]*"
        elif char == "?":
            out += "[\\s\\S]"
        else:
            out += char if char.isalnum() or char in " _" else "\\" + char
        i += 1
    return "^" + out + "$"


def parse_population(text: Column) -> Column:
    """Digits of a population tag before the first semicolon, or null."""
    digits = F.regexp_replace(F.element_at(F.split(text, ";"), 1), r"\D", "")
    return F.nullif(digits, F.lit("")).try_cast("long")


def content_fingerprint(content: Column) -> Column:
    """``<size>:<hash of the first and last megabyte>`` of a binary column, without overlap."""
    chunk, size = C.FINGERPRINT_CHUNK_BYTES, F.octet_length(content)
    tail_start = F.greatest(F.lit(chunk), size - chunk)
    head = F.substring(content, 1, chunk)
    tail = F.when(
        size > chunk, F.substring(content, tail_start + 1, F.lit(chunk))
    ).otherwise(F.lit(b""))
    digest = F.substring(F.sha2(F.concat(head, tail), 256), 1, 16)
    return F.concat(size.cast("string"), F.lit(":"), digest)
