"""The same results as ANSI SQL for an independent engine, over whole tables.

Named subqueries are shared; ``_with`` adds those a query needs. The readings are all from one
winter day, so local time is two hours ahead of UTC throughout.
"""

from __future__ import annotations

import re

from trackloom import constants as C

GPS = r"^(?:(\d{1,3}) KM/H ?)?(?:([NS])(\d{1,2}\.\d+))? ?(?:([EW])(\d{1,3}\.\d+))?$"
CLOCK = r"^(\d{1,4})[/.](\d{1,2})[/.](\d{1,4}) (\d{1,2}):(\d{2}):(\d{2})$"


def hav(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * 6371000.0 * asin(sqrt(least(1.0, {a}))))"


def _stem(name: str) -> str:
    return rf"regexp_replace({name}, '\.[^.]*$', '')"


def _ext(name: str) -> str:
    return rf"regexp_extract({name}, '\.[^.]*$')"


def _f(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 1 ELSE 0 END"


CTES: dict[str, str] = {}

CTES["flags"] = """
SELECT *, (trip_id % 5 = 0 AND seq BETWEEN 20 AND 34) OR (trip_id % 10 = 3 AND seq >= 30) AS spoof,
  trip_id % 7 = 0 AND seq BETWEEN 40 AND 45 AS nofix,
  28800 + seq + CASE WHEN trip_id % 11 = 0 AND seq >= 50 THEN 600 ELSE 0 END AS second,
  49800000 + trip_id * 1000 + seq * 270 AS lat_u, 24000000 + trip_id * 100 AS lon_u
FROM (SELECT event_id, user_id AS trip_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events)"""
CTES["readings"] = """
SELECT trip_id, seq, CAST(seq AS DOUBLE) AS t,
  CASE WHEN nofix THEN ''
    WHEN spoof THEN '200 KM/H S12.' || lpad(CAST(45000 + seq * 500 AS VARCHAR), 6, '0') || ' W77.030000'
    ELSE '108 KM/H N' || (lat_u // 1000000) || '.' || lpad(CAST(lat_u % 1000000 AS VARCHAR), 6, '0')
      || ' E' || (lon_u // 1000000) || '.' || lpad(CAST(lon_u % 1000000 AS VARCHAR), 6, '0') END AS gps_text,
  CASE WHEN spoof THEN '2023/12/20' WHEN trip_id % 3 = 0 THEN '01/01/2024' ELSE '2024/01/01' END || ' '
    || lpad(CAST(second // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(second // 60 % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(second % 60 AS VARCHAR), 2, '0') AS clock_text,
  CASE WHEN event_id % 53 = 0 THEN 0.4 ELSE 0.95 END::DOUBLE AS gps_score, 0.95::DOUBLE AS clock_score,
  DATE '2024-01-01' AS trip_date
FROM flags"""
CTES["users"] = "SELECT DISTINCT user_id AS trip_id FROM events"
CTES["gps_read"] = f"""
SELECT *, CASE WHEN ok AND abs(la) <= 90 AND abs(lo) <= 180 THEN la END AS lat,
  CASE WHEN ok AND abs(la) <= 90 AND abs(lo) <= 180 THEN lo END AS lon,
  CASE WHEN ok AND abs(la) <= 90 AND abs(lo) <= 180
    THEN TRY_CAST(nullif(regexp_extract(gps_text, '{GPS}', 1), '') AS INTEGER) END AS kmh
FROM (SELECT *, regexp_matches(gps_text, '{GPS}') AS ok,
  TRY_CAST(nullif(regexp_extract(gps_text, '{GPS}', 3), '') AS DOUBLE)
    * CASE WHEN regexp_extract(gps_text, '{GPS}', 2) = 'S' THEN -1 ELSE 1 END AS la,
  TRY_CAST(nullif(regexp_extract(gps_text, '{GPS}', 5), '') AS DOUBLE)
    * CASE WHEN regexp_extract(gps_text, '{GPS}', 4) = 'W' THEN -1 ELSE 1 END AS lo
  FROM readings)"""


def _clock(day_first: bool) -> str:
    def part(i: int) -> str:
        return f"regexp_extract(clock_text, '{CLOCK}', {i})"

    day, month = (1, 2) if day_first else (2, 1)
    time = f"' ' || lpad({part(4)}, 2, '0') || ':' || {part(5)} || ':' || {part(6)}"
    def date(y, m, d):
        return f"{part(y)} || '-' || lpad({part(m)}, 2, '0') || '-' || lpad({part(d)}, 2, '0') || {time}"

    return (
        f"CASE WHEN length({part(1)}) = 4 AND length({part(3)}) <= 2 THEN TRY_CAST({date(1, 2, 3)} AS TIMESTAMP) "
        f"WHEN length({part(3)}) = 4 AND length({part(1)}) <= 2 THEN TRY_CAST({date(3, month, day)} AS TIMESTAMP) END"
    )


CTES["clock_read"] = f"""
SELECT *, {_clock(True)} AS clock_d, {_clock(False)} AS clock_m,
  length(regexp_extract(clock_text, '{CLOCK}', 3)) = 4 AS year_last,
  TRY_CAST(nullif(regexp_extract(clock_text, '{CLOCK}', 1), '') AS INTEGER) AS first_number,
  TRY_CAST(nullif(regexp_extract(clock_text, '{CLOCK}', 2), '') AS INTEGER) AS middle_number
FROM gps_read"""
CTES["votes"] = """
SELECT trip_id, CAST(count(*) FILTER (year_last AND first_number > 12) AS BIGINT) AS votes_day,
  CAST(count(*) FILTER (year_last AND middle_number > 12) AS BIGINT) AS votes_month,
  CAST(count(*) FILTER (CAST(clock_d AS DATE) = trip_date) AS BIGINT) AS votes_date_day,
  CAST(count(*) FILTER (CAST(clock_m AS DATE) = trip_date) AS BIGINT) AS votes_date_month
FROM clock_read WHERE clock_text <> '' AND clock_score >= 0.6 GROUP BY trip_id"""

AREA = " OR ".join(
    f"(lat BETWEEN {a} AND {c} AND lon BETWEEN {b} AND {d})" for a, b, c, d in [(44.0, 22.0, 52.5, 40.5)]
)


def _clean_ctes(x: str, bad: str, good: str, area: str = "TRUE", trip_date: str = "trip_date") -> None:
    """The cleaning steps, for one way of giving overrides."""
    CTES[f"parsed{x}"] = f"""
SELECT c.trip_id, seq, t, gps_text, clock_text, gps_score, clock_score,
  CASE WHEN rel THEN lat END AS lat, CASE WHEN rel THEN lon END AS lon, CASE WHEN rel THEN kmh END AS kmh,
  clock, CASE WHEN abs(date_diff('day', {trip_date}, CAST(clock AS DATE))) <= 1 THEN clock - INTERVAL 2 HOUR END AS instant,
  CASE WHEN gps_text = '' THEN 'no_fix' WHEN NOT rel OR lat IS NULL THEN 'unreadable'
    WHEN {bad} OR NOT ({area}) THEN 'spoofed' ELSE 'ok' END AS initial
FROM (SELECT c.*, gps_text <> '' AND gps_score >= 0.6 AS rel,
    CASE WHEN clock_text <> '' AND clock_score >= 0.6 THEN
      CASE WHEN CASE WHEN votes_day + votes_month > 0 THEN votes_day >= votes_month ELSE votes_date_day >= votes_date_month END
        THEN clock_d ELSE clock_m END END AS clock
  FROM clock_read c LEFT JOIN votes v ON c.trip_id = v.trip_id) c"""
    CTES[f"stepped{x}"] = f"""
SELECT *, {hav('pl', 'po', 'lat', 'lon')} / greatest(1.0, t - pt) * 3.6 AS speed FROM (
  SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS po, lag(t) OVER w AS pt FROM parsed{x} WHERE initial = 'ok'
  WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq))"""
    CTES[f"fixes{x}"] = f"""
SELECT *, CAST(sum(CASE WHEN pt IS NULL OR speed > 250 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment,
  CAST(sum(CASE WHEN pt IS NULL OR speed > 1000 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS place,
  sum(coalesce(kmh, 0)) OVER w AS speed_sum, count(kmh) OVER w AS speed_n
FROM stepped{x} WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)"""
    CTES[f"pairs{x}"] = f"""
SELECT trip_id, seq, segment, abs({hav('lat', 'lon', 'lat2', 'lon2')} / (t2 - t) * 3.6 - shown / n) AS mismatch
FROM (SELECT a.*, b.lat AS lat2, b.lon AS lon2, b.t AS t2,
    b.speed_sum - a.speed_sum + coalesce(a.kmh, 0) AS shown,
    b.speed_n - a.speed_n + CASE WHEN a.kmh IS NULL THEN 0 ELSE 1 END AS n
  FROM fixes{x} a ASOF JOIN fixes{x} b
  ON a.trip_id = b.trip_id AND a.segment = b.segment AND a.t + 5 <= b.t) WHERE n > 0"""
    CTES[f"segments{x}"] = f"""
SELECT f.*, coalesce(p.n, 0) AS speed_pairs, coalesce(p.n >= 5 AND p.middle > 30, FALSE) AS speed_mismatch
FROM (SELECT trip_id, segment, place, count(*) AS weight, count(clock) AS readable,
    count(*) FILTER (clock IS NOT NULL AND instant IS NULL) AS implausible,
    min(t) AS first_t, max(t) AS last_t, arg_min(lat, t) AS first_lat, arg_min(lon, t) AS first_lon,
    arg_max(lat, t) AS last_lat, arg_max(lon, t) AS last_lon,
    arg_min(coalesce(epoch(instant), -1), t) AS first_s, arg_max(coalesce(epoch(instant), -1), t) AS last_s
  FROM fixes{x} GROUP BY ALL) f
LEFT JOIN (SELECT trip_id, segment, count(*) AS n, median(mismatch) AS middle FROM pairs{x} GROUP BY ALL) p
ON f.trip_id = p.trip_id AND f.segment = p.segment"""
    CTES[f"usable{x}"] = f"""
SELECT * FROM (SELECT *, sum(implausible) OVER p * 2 > sum(readable) OVER p AS place_bad FROM segments{x}
  WINDOW p AS (PARTITION BY trip_id, place))
WHERE NOT place_bad AND NOT implausible * 2 > readable AND NOT speed_mismatch"""
    CTES[f"chains{x}"] = f"""
SELECT trip_id, segment AS last_segment, weight AS total, [segment] AS path, last_t, last_lat, last_lon, last_s FROM usable{x}
UNION ALL
SELECT c.trip_id, s.segment, c.total + s.weight, list_append(c.path, s.segment), s.last_t, s.last_lat, s.last_lon, s.last_s
FROM chains{x} c JOIN usable{x} s ON c.trip_id = s.trip_id AND s.segment > c.last_segment
WHERE {hav('c.last_lat', 'c.last_lon', 's.first_lat', 's.first_lon')} / (
  CASE WHEN c.last_s >= 0 AND s.first_s >= 0
    AND s.first_s - c.last_s BETWEEN greatest(1.0, s.first_t - c.last_t) - 1.5 AND greatest(1.0, s.first_t - c.last_t) + 43200
  THEN greatest(greatest(1.0, s.first_t - c.last_t), s.first_s - c.last_s) ELSE greatest(1.0, s.first_t - c.last_t) END) * 3.6 <= 250"""
    CTES[f"kept{x}"] = f"""
SELECT trip_id, unnest(path) AS segment FROM (SELECT trip_id, path FROM chains{x}
  QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY total DESC, last_segment) = 1)"""
    CTES[f"status{x}"] = f"""
SELECT p.*, CASE WHEN k.segment IS NOT NULL OR (p.lat IS NOT NULL AND {good}) THEN 'ok'
  WHEN p.initial = 'ok' THEN 'spoofed' ELSE p.initial END AS status0
FROM parsed{x} p LEFT JOIN fixes{x} f ON p.trip_id = f.trip_id AND p.seq = f.seq
LEFT JOIN kept{x} k ON f.trip_id = k.trip_id AND f.segment = k.segment"""
    CTES[f"jumps{x}"] = f"""
SELECT *, CASE WHEN j > 1.5 AND j <= 43200 THEN j ELSE 0.0 END AS jump, CASE WHEN instant IS NULL THEN 1 ELSE 0 END AS doubt
FROM (SELECT *, epoch(instant) - epoch(lag(instant) OVER w) - (t - lag(t) OVER w) AS j FROM status{x}
  WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq))"""
    CTES[f"anchors{x}"] = f"""
SELECT *, CASE WHEN status0 = 'ok' AND instant IS NOT NULL
  THEN struct_pack(t := t, instant := instant, jumps := jumps, doubts := doubts) END AS anchor
FROM (SELECT *, sum(jump) OVER w AS jumps, sum(doubt) OVER w AS doubts FROM jumps{x}
  WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))"""
    CTES[f"sides{x}"] = f"""
SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(anchor IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
FROM anchors{x}"""
    CTES[f"timed{x}"] = f"""
SELECT *, CASE WHEN anchor IS NOT NULL THEN instant WHEN a IS NULL AND b IS NULL THEN instant
    WHEN use_b THEN b.instant + to_seconds(CAST(round_even(t - b.t + jumps - b.jumps, 0) AS BIGINT))
    ELSE a.instant + to_seconds(CAST(round_even(t - a.t + jumps - a.jumps, 0) AS BIGINT)) END AS time,
  CASE WHEN anchor IS NOT NULL THEN FALSE WHEN a IS NULL AND b IS NULL THEN TRUE
    WHEN use_b THEN b_est ELSE a_est END AS estimated
FROM (SELECT *, CASE WHEN a IS NULL THEN TRUE WHEN b IS NULL THEN FALSE
    ELSE (b_est = a_est AND b.t - t < t - a.t) OR (a_est AND NOT b_est) END AS use_b
  FROM (SELECT *, doubts - a.doubts > 0 AS a_est, b.doubts - doubts + doubt > 0 AS b_est FROM sides{x}))"""
    CTES[f"goods{x}"] = f"""
SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(g IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
FROM (SELECT *, CASE WHEN status0 = 'ok' THEN struct_pack(t := t, time := time, lat := lat, lon := lon) END AS g FROM timed{x})"""
    CTES[f"clean{x}"] = f"""
SELECT trip_id, seq, t, time, estimated, gps_text, clock_text, gps_score, clock_score,
  CASE WHEN fills THEN 'interpolated' ELSE status0 END AS status,
  CASE WHEN fills THEN l.lat + (r.lat - l.lat) * share WHEN status0 = 'ok' THEN lat END AS lat,
  CASE WHEN fills THEN l.lon + (r.lon - l.lon) * share WHEN status0 = 'ok' THEN lon END AS lon,
  CASE WHEN status0 = 'ok' THEN kmh END AS kmh
FROM (SELECT *, coalesce(status0 <> 'ok' AND gap > 0 AND gap <= 60, FALSE) AS fills,
    least(1.0, greatest(0.0, coalesce(epoch(time) - epoch(l.time), t - l.t) / gap)) AS share
  FROM (SELECT *, coalesce(epoch(r.time) - epoch(l.time), r.t - l.t) AS gap FROM goods{x}))"""


_clean_ctes("", "FALSE", "FALSE")
_clean_ctes("_o", "(c.trip_id % 9 = 0 AND t BETWEEN 5 AND 7)", "(p.trip_id % 10 = 3 AND p.t BETWEEN 30 AND 31)")
_clean_ctes("_a", "(c.trip_id % 9 = 0 AND t BETWEEN 5 AND 7)", "FALSE", AREA)

_clean_ctes("_r", "FALSE", "FALSE", trip_date="trip_date + CAST(c.trip_id % 3 AS INTEGER)")

CTES["frames"] = """
SELECT trip_id, seq * 2 + half AS seq, t + half * 0.5 AS t,
  CASE WHEN half = 1 AND seq % 17 = 0 THEN '' WHEN seq % 29 = 7 THEN regexp_replace(gps_text, '^[0-9]+ KM', '300 KM') ELSE gps_text END AS gps_text, clock_text, gps_score, clock_score
FROM readings, (VALUES (0), (1)) h(half)"""
CTES["steps"] = f"""
SELECT *, coalesce(NOT (epoch(time) - epoch(ptime) BETWEEN 0 AND 60), FALSE) AS gap,
  coalesce(located AND plocated AND coalesce(epoch(time) - epoch(ptime) BETWEEN 0 AND 60, TRUE), FALSE) AS joined,
  {hav('plat', 'plon', 'lat', 'lon')} AS meters
FROM (SELECT *, lag(time) OVER w AS ptime, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(located) OVER w AS plocated,
    lag(t) OVER w AS pt, lag(kmh) OVER w AS pkmh, lag(seq) OVER w AS pseq
  FROM (SELECT *, status IN ('ok', 'interpolated') AS located FROM clean) WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq))"""
CTES["stats"] = """
SELECT trip_id, min(time) AS start_time, max(time) AS end_time,
  coalesce(CAST(epoch(max(time)) - epoch(min(time)) AS BIGINT), 0) AS duration_s,
  round_even(coalesce(sum(meters) FILTER (joined), 0) / 1000, 2)::DOUBLE AS distance_km,
  CASE WHEN sum(epoch(time) - epoch(ptime)) FILTER (joined) > 0 THEN
    round_even(sum(meters) FILTER (joined) / sum(epoch(time) - epoch(ptime)) FILTER (joined) * 3.6, 1)::DOUBLE END AS avg_kmh,
  max(kmh) AS max_kmh, round_even(count(*) FILTER (located) / count(*), 3)::DOUBLE AS coverage,
  count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'spoofed') AS n_spoofed,
  min(lat) FILTER (located) AS min_lat, min(lon) FILTER (located) AS min_lon,
  max(lat) FILTER (located) AS max_lat, max(lon) FILTER (located) AS max_lon
FROM steps GROUP BY trip_id"""
CTES["route"] = """
SELECT *, CAST(sum(CASE WHEN located AND (NOT coalesce(plocated, FALSE) OR gap) THEN 1 ELSE 0 END)
  OVER (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM steps"""
CTES["runs"] = "SELECT * FROM route WHERE located"
CTES["match"] = """
SELECT * FROM (SELECT *, CASE WHEN linked THEN meters ELSE 0 END AS step_m,
  CAST(sum(CASE WHEN located AND NOT linked THEN 1 ELSE 0 END)
    OVER (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM (SELECT *, coalesce(plocated AND t - pt <= 5 AND meters <= 150, FALSE) AS linked FROM steps)) WHERE located"""
_M = "6371000.0 * pi() / 180"
CTES["heading"] = f"""
SELECT trip_id, seq, run, t, lat, lon, step_m,
  {{e}} / sqrt({{e}} * {{e}} + {{n}} * {{n}}) AS heading_east, {{n}} / sqrt({{e}} * {{e}} + {{n}} * {{n}}) AS heading_north
FROM (SELECT *, CASE {{cases}} END AS w FROM (SELECT *, {{windows}} FROM match))"""


def _heading() -> str:
    def edge(k: int, function: str, of: str) -> str:
        values = [f"{function}({of}, {i}) OVER (PARTITION BY trip_id, run ORDER BY t, seq)" for i in range(k, 0, -1)]
        return f"coalesce({', '.join(values)}, {of})"

    windows, cases = [], []
    for k in range(1, 6):
        e = f"((({edge(k, 'lead', 'lon')}) - lon) * ({_M}) * cos(radians(lat)) - (({edge(k, 'lag', 'lon')}) - lon) * ({_M}) * cos(radians(lat)))"
        n = f"((({edge(k, 'lead', 'lat')}) - lat) * ({_M}) - (({edge(k, 'lag', 'lat')}) - lat) * ({_M}))"
        windows.append(f"[{e}, {n}] AS w{k}")
        cases.append(f"WHEN sqrt(w{k}[1] * w{k}[1] + w{k}[2] * w{k}[2]) >= 10 THEN w{k}")
    return CTES["heading"].format(e="w[1]", n="w[2]", cases=" ".join(cases), windows=", ".join(windows))


CTES["heading"] = _heading()

CTES["trip_tracks"] = """
SELECT trip_id, strftime(DATE '2024-01-01' + CAST(trip_id % 3 AS INTEGER), '%Y-%m-%d') AS day,
  'Trip ' || lpad(CAST(trip_id % 24 AS VARCHAR), 2, '0') || '-' || lpad(CAST(trip_id % 60 AS VARCHAR), 2, '0') || ' ' || trip_id AS name,
  CASE WHEN trip_id % 25 = 24 THEN 'no_overlay' ELSE 'ok' END AS extraction_status FROM users"""
CTES["trips"] = """
SELECT t.day || ' ' || t.name AS id, t.*, s.* EXCLUDE (trip_id) FROM trip_tracks t
LEFT JOIN stats s ON t.trip_id = s.trip_id AND t.extraction_status = 'ok'"""

# --- library ---
CTES["library"] = """
SELECT doc_id, strftime(DATE '2024-01-01' + CAST((doc_id // 2) % 365 AS INTEGER), '%Y-%m-%d')
  || CASE WHEN doc_id % 2 = 0 THEN ' Trip ' ELSE ' TRIP ' END || lpad(CAST((doc_id // 2) % 24 AS VARCHAR), 2, '0') || '-'
  || lpad(CAST((doc_id // 2) % 60 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 3 = 0 THEN ' no ' || doc_id ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '.MOV' ELSE '.mp4' END AS name,
  CAST(strlen(text) AS BIGINT) AS size, CAST(1704067200 + doc_id % 1000 AS DOUBLE) AS mtime,
  strlen(text) || ':' || substr(sha256(text), 1, 16) AS fingerprint FROM documents"""
CTES["videos"] = f"SELECT *, {_stem('name')} AS stem, {_ext('name')} AS ext FROM library"
CTES["unreadable"] = "SELECT stem, 'invalid JSON' AS reason FROM videos WHERE doc_id % 41 = 0"
CTES["tracks"] = """
SELECT doc_id, CASE WHEN misnamed THEN stem || ' copy' ELSE declared END AS file_stem, declared AS stem, declared || ext AS video_filename,
  CASE WHEN doc_id % 23 = 0 THEN '0:changed' ELSE fingerprint END AS fingerprint,
  size + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS video_size, mtime + CASE WHEN doc_id % 19 = 0 THEN 5 ELSE 0 END AS video_mtime,
  CASE WHEN doc_id % 37 = 0 THEN 'no_overlay' ELSE 'ok' END AS extraction_status,
  CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 1 END AS extractor_version, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 2 END AS cleaning_version,
  CASE WHEN doc_id NOT IN (SELECT u.trip_id FROM users u) OR doc_id % 7 = 1 THEN 'missing' WHEN doc_id % 7 IN (2, 3) THEN 'outdated' ELSE 'current' END AS enrichment_status
FROM (SELECT *, CASE WHEN doc_id % 17 = 0 THEN stem || ' old' ELSE stem END AS declared,
    doc_id % 29 = 0 AND doc_id % 17 <> 0 AS misnamed FROM videos WHERE doc_id % 4 <> 1 AND doc_id % 41 <> 0)"""
CTES["previews"] = """
SELECT stem || CASE WHEN doc_id % 13 = 0 THEN ' gone' ELSE '' END AS stem FROM videos WHERE doc_id % 3 <> 2"""
CTES["leftovers"] = """
SELECT 'tracks/.tmp-' || doc_id || '.partial' AS path, doc_id * 20 AS age_s FROM documents WHERE doc_id % 50 = 7"""
CTES["shared"] = """
SELECT * FROM (SELECT lower(stem) AS key, count(*) OVER (PARTITION BY lower(stem)) AS videos, name FROM videos) WHERE videos > 1"""

# --- clips ---
CTES["clips"] = """
SELECT user_id AS camera_id, CASE WHEN event_type = 'error' THEN 'RO' ELSE 'Movie' END AS folder, event_id AS idx,
  event_type = 'signup' AND event_id % 10 = 0 AS parking, event_id % 1000 + 1 AS size, date_trunc('second', ts) AS start_time,
  strftime(date_trunc('second', ts), '%Y%m%d%H%M%S') || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0')
    || CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'P' ELSE '' END || '.MP4' AS name FROM events"""
CTES["driven"] = "SELECT * FROM clips WHERE NOT parking"
CTES["fresh"] = "SELECT * FROM driven WHERE idx % 4 <> 0"


def _grouped(source: str) -> str:
    return f"""
SELECT *, CAST(sum(CASE WHEN before IS NULL OR start_time > before + INTERVAL 3 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY camera_id ORDER BY start_time, idx, name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_seq
FROM (SELECT *, lag(start_time) OVER (PARTITION BY camera_id ORDER BY start_time, idx, name) AS before FROM {source})"""


CTES["grouped"] = _grouped("driven")
CTES["fresh_grouped"] = _grouped("fresh")

# --- map ---
CTES["streets_in"] = """
SELECT p_partkey AS way_id, 49800000 + p_partkey * 1000 AS lat_u, 24000000 + p_partkey * 100 AS lon_u,
  CASE WHEN p_partkey % 13 <> 0 THEN 'Street ' || p_partkey % 40 END AS name,
  CASE WHEN p_partkey % 13 = 0 THEN 'M-' || p_partkey % 10 END AS ref,
  ['trunk', 'primary', 'residential', 'footway'][p_size % 4 + 1] AS highway FROM part"""
CTES["map_roads"] = "SELECT * FROM streets_in WHERE highway <> 'footway'"
CTES["legs"] = """
SELECT way_id, name, ref, highway, (lat_u + i * 1000) / 1000000 AS lat1, (lat_u + i * 1000 + 1000) / 1000000 AS lat2,
  lon_u / 1000000 AS lon, i FROM map_roads, range(20) r(i)"""
CTES["places"] = """
SELECT s_name AS name, ['city', 'town', 'village', 'hamlet'][s_nationkey % 4 + 1] AS place,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(floor(abs(s_acctbal)) AS BIGINT) END AS population,
  (49800000 + s_suppkey * 10000) / 1000000 AS lat, (24000000 + (s_suppkey % 20) * 5000) / 1000000 AS lon FROM supplier"""
CTES["place_radii"] = """
SELECT *, least(25000.0, greatest(CASE place WHEN 'city' THEN 5000.0 WHEN 'town' THEN 2500.0 WHEN 'village' THEN 1200.0 ELSE 500.0 END,
  coalesce(10 * sqrt(population), 0))) AS radius FROM places"""
CTES["near_legs"] = f"""
SELECT s.trip_id, s.seq, s.heading_north, l.name, l.ref, l.highway,
  ({_M}) * cos(radians(s.lat)) * (l.lon - s.lon) AS x, (l.lat1 - s.lat) * ({_M}) AS y1, (l.lat2 - s.lat) * ({_M}) AS y2
FROM heading s JOIN legs l ON s.lat BETWEEN l.lat1 - 0.001 AND l.lat2 + 0.001 AND abs(l.lon - s.lon) < 0.002"""
CTES["candidates"] = """
SELECT trip_id, seq, name, ref, min(0.5 * power(d / 12, 2) + coalesce(3 * (1 - heading_north * heading_north), 0)) AS cost
FROM (SELECT *, sqrt(x * x + power(CASE WHEN y1 > 0 THEN y1 WHEN y2 < 0 THEN y2 ELSE 0 END, 2)) AS d FROM near_legs)
WHERE d <= 50 GROUP BY ALL"""
CTES["ends"] = """
SELECT trip_id, min(time) AS start_time, arg_min(lat, seq) FILTER (located) AS start_lat, arg_min(lon, seq) FILTER (located) AS start_lon,
  arg_max(lat, seq) FILTER (located) AS end_lat, arg_max(lon, seq) FILTER (located) AS end_lon FROM steps GROUP BY trip_id"""
CTES["end_points"] = """
SELECT trip_id, 'start' AS side, start_lat AS lat, start_lon AS lon FROM ends
UNION ALL SELECT trip_id, 'end', end_lat, end_lon FROM ends"""
CTES["located_places"] = f"""
SELECT e.trip_id, e.side, p.name FROM end_points e JOIN place_radii p ON {hav('e.lat', 'e.lon', 'p.lat', 'p.lon')} <= p.radius
QUALIFY row_number() OVER (PARTITION BY e.trip_id, e.side ORDER BY {hav('e.lat', 'e.lon', 'p.lat', 'p.lon')} / p.radius, p.name) = 1"""
CTES["trip_places"] = """
SELECT u.trip_id, a.name AS s, b.name AS e FROM users u
LEFT JOIN located_places a ON a.trip_id = u.trip_id AND a.side = 'start'
LEFT JOIN located_places b ON b.trip_id = u.trip_id AND b.side = 'end'"""
CTES["digests"] = """
SELECT u.trip_id, substr(sha256(coalesce(string_agg(printf('%.2f %.6f %.6f', t, lat, lon) || chr(10), '' ORDER BY t, seq) FILTER (located), '')), 1, 16) AS samples_digest
FROM users u JOIN steps s ON s.trip_id = u.trip_id GROUP BY u.trip_id"""

# --- geometry ---
CTES["points"] = """
SELECT trip_id, run, seq, round_even(lat, 5)::DOUBLE AS lat, round_even(lon, 5)::DOUBLE AS lon,
  row_number() OVER (PARTITION BY trip_id, run ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY trip_id, run) AS n FROM runs"""
CTES["thinned"] = f"""
SELECT trip_id, run, seq, i, n, lat, lon, lat AS klat, lon AS klon, TRUE AS kept FROM points WHERE i = 1
UNION ALL
SELECT p.trip_id, p.run, p.seq, p.i, p.n, p.lat, p.lon,
  CASE WHEN {hav('k.klat', 'k.klon', 'p.lat', 'p.lon')} >= 10 THEN p.lat ELSE k.klat END,
  CASE WHEN {hav('k.klat', 'k.klon', 'p.lat', 'p.lon')} >= 10 THEN p.lon ELSE k.klon END,
  {hav('k.klat', 'k.klon', 'p.lat', 'p.lon')} >= 10
FROM thinned k JOIN points p ON p.trip_id = k.trip_id AND p.run = k.run AND p.i = k.i + 1"""
# Line simplification: every open stretch is split at its farthest point beyond the tolerance.
CTES["thin_rows"] = f"""
SELECT trip_id, run, lat, lon, row_number() OVER w AS j, count(*) OVER (PARTITION BY trip_id, run) AS m,
  lon * cos(radians(first_value(lat) OVER w)) * {C.METERS_PER_DEGREE!r} AS x, lat * {C.METERS_PER_DEGREE!r} AS y
FROM thinned WHERE n > 1 AND (kept OR i = n) WINDOW w AS (PARTITION BY trip_id, run ORDER BY i)"""
CTES["splits"] = f"""
SELECT trip_id, run, CAST(1 AS BIGINT) AS a, m AS b FROM thin_rows WHERE j = 1
UNION ALL
SELECT trip_id, run, unnest([a, far]) AS a, unnest([far, b]) AS b
FROM (SELECT trip_id, run, a, b, arg_max(j, (off, -j)) AS far, max(off) AS off
  FROM (SELECT o.trip_id, o.run, o.a, o.b, p.j, CASE WHEN q.x = r.x AND q.y = r.y THEN sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))
      ELSE abs((r.y - q.y) * (p.x - q.x) - (r.x - q.x) * (p.y - q.y)) / sqrt(power(r.x - q.x, 2) + power(r.y - q.y, 2)) END AS off
    FROM splits o JOIN thin_rows q ON q.trip_id = o.trip_id AND q.run = o.run AND q.j = o.a
    JOIN thin_rows r ON r.trip_id = o.trip_id AND r.run = o.run AND r.j = o.b
    JOIN thin_rows p ON p.trip_id = o.trip_id AND p.run = o.run AND p.j > o.a AND p.j < o.b)
  GROUP BY trip_id, run, a, b) WHERE off > {C.GEOMETRY_TOLERANCE_M}"""
CTES["routes"] = """
SELECT t.trip_id, t.run, CAST(row_number() OVER (PARTITION BY t.trip_id, t.run ORDER BY t.j) - 1 AS INTEGER) AS pos, t.lat, t.lon
FROM thin_rows t JOIN (SELECT trip_id, run, a AS j FROM splits UNION SELECT trip_id, run, b FROM splits) k
  ON k.trip_id = t.trip_id AND k.run = t.run AND k.j = t.j"""
CTES["heat_scale"] = f"""
SELECT lat, CAST({C.HEAT_CELL_M} AS DOUBLE) / {C.HEAT_METERS_PER_DEGREE} AS cell_lat,
  CAST({C.HEAT_CELL_M} AS DOUBLE) / {C.HEAT_METERS_PER_DEGREE} / cos(lat * pi() / 180) AS cell_lon,
  greatest(1, CAST(floor(CAST({C.HEAT_RADIUS_PX} AS DOUBLE) / 2 * (CAST({C.EARTH_CIRCUMFERENCE_M} AS DOUBLE) * cos(lat * pi() / 180) / ({C.WORLD_WIDTH_PX} * 1024))
    / {C.HEAT_CELL_M}) AS BIGINT)) AS merge
FROM (SELECT coalesce(arg_min(lat, (trip_id, run, pos)), 0) AS lat FROM routes)"""
CTES["heat_cells"] = """
SELECT "row", "column", count(*) AS trips FROM (
  SELECT DISTINCT trip_id, CAST(floor((lat + d_lat * (k / steps)) / cell_lat) AS BIGINT) AS "row", CAST(floor((lon + d_lon * (k / steps)) / cell_lon) AS BIGINT) AS "column"
  FROM (SELECT *, unnest(range(0, steps + 1)) AS k
    FROM (SELECT *, greatest(1, CAST(ceil(greatest(abs(d_lat) / cell_lat, abs(d_lon) / cell_lon) * 2) AS BIGINT)) AS steps
      FROM (SELECT trip_id, r.lat, lon, lead(r.lat) OVER w - r.lat AS d_lat, lead(lon) OVER w - lon AS d_lon, cell_lat, cell_lon
        FROM routes r, heat_scale WINDOW w AS (PARTITION BY trip_id, run ORDER BY pos)) WHERE d_lat IS NOT NULL)))
GROUP BY ALL"""

# --- quality ---
CTES["frame_values"] = """
SELECT f.trip_id, f.seq, f.t, f.gps_text, f.clock_text, f.gps_score, f.clock_score, f.gps_text <> '' AS present,
  CASE WHEN f.gps_text <> '' THEN c.lat END AS lat, CASE WHEN f.gps_text <> '' THEN c.lon END AS lon,
  CASE WHEN f.gps_text <> '' AND c.kmh IS NOT NULL THEN TRY_CAST(regexp_extract(f.gps_text, '^([0-9]+)', 1) AS INTEGER) END AS kmh, c.clock_d AS clock, epoch(c.clock_d) - f.t AS off
FROM frames f JOIN clock_read c ON c.trip_id = f.trip_id AND c.seq = f.seq // 2"""


def _outlier(c: str, tolerance: float) -> str:
    return (
        f"coalesce(abs(lag({c}) OVER w - lead({c}) OVER w) <= {tolerance} AND abs({c} - lag({c}) OVER w) > {tolerance} "
        f"AND abs({c} - lead({c}) OVER w) > {tolerance}, FALSE)"
    )


CTES["judged"] = f"""
SELECT * FROM (SELECT *, {_outlier('off', 1.5)} AS clock_out, {_outlier('lat', 0.01)} AS lat_out, {_outlier('lon', 0.01)} AS lon_out,
  lag(present) OVER w = lead(present) OVER w AND lag(present) OVER w <> present AS flicker,
  lag(seq) OVER w AS s0, lead(seq) OVER w AS s2
FROM frame_values WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq)) WHERE s0 IS NOT NULL AND s2 IS NOT NULL"""
CTES["flagged"] = """
SELECT trip_id, seq, t, 'clock unreadable' AS reason FROM judged WHERE clock_text = ''
UNION ALL SELECT trip_id, seq, t, 'clock outlier' FROM judged WHERE clock_text <> '' AND clock_out
UNION ALL SELECT trip_id, seq, t, 'GPS presence flicker' FROM judged WHERE flicker
UNION ALL SELECT trip_id, seq, t, 'GPS text unparseable' FROM judged WHERE NOT flicker AND present AND lat IS NULL
UNION ALL SELECT trip_id, seq, t, 'lat outlier' FROM judged WHERE NOT flicker AND NOT (present AND lat IS NULL) AND lat_out
UNION ALL SELECT trip_id, seq, t, 'lon outlier' FROM judged WHERE NOT flicker AND NOT (present AND lat IS NULL) AND lon_out"""
CTES["seconds"] = """
SELECT * FROM frame_values WHERE lat IS NOT NULL AND clock IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY trip_id, clock ORDER BY t, seq) = 1"""
CTES["mismatches"] = f"""
SELECT * FROM (SELECT a.trip_id, a.seq, a.t, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 3.6 AS implied_kmh, a.kmh AS displayed_kmh,
  (a.kmh + b.kmh) / 2 AS displayed FROM seconds a JOIN seconds b ON a.trip_id = b.trip_id AND b.clock = a.clock + INTERVAL 1 SECOND)
WHERE abs(implied_kmh - displayed) > 25"""

# --- street matching ---
# Equal costs are decided by off road first, then name, then ref: the label sorts that way.
LABEL = "coalesce('1' || {c}.name, '0') || chr(1) || coalesce('1' || {c}.ref, '0')"
CTES["road_candidates"] = """
SELECT trip_id, seq, name, ref, min(cost) AS cost, arg_min(highway, cost) AS highway
FROM (SELECT *, 0.5 * power(sqrt(x * x + power(CASE WHEN y1 > 0 THEN y1 WHEN y2 < 0 THEN y2 ELSE 0 END, 2)) / 12, 2)
    + coalesce(3 * (1 - heading_north * heading_north), 0) AS cost,
    sqrt(x * x + power(CASE WHEN y1 > 0 THEN y1 WHEN y2 < 0 THEN y2 ELSE 0 END, 2)) AS d FROM near_legs)
WHERE d <= 50 GROUP BY trip_id, seq, name, ref"""
CTES["steps_of_runs"] = """
SELECT trip_id, run, seq, t, step_m, row_number() OVER (PARTITION BY trip_id, run ORDER BY t, seq) AS i FROM match"""
CTES["emissions"] = f"""
SELECT trip_id, run, i, '' AS label, CAST({C.OFF_ROAD_COST} AS DOUBLE) AS cost FROM steps_of_runs
UNION ALL SELECT s.trip_id, s.run, s.i, {LABEL.format(c='c')}, round_even(c.cost * 1073741824, 0) / 1073741824
FROM steps_of_runs s JOIN road_candidates c ON c.trip_id = s.trip_id AND c.seq = s.seq"""
CTES["paths"] = f"""
SELECT trip_id, run, i, label, cost AS total, CAST(NULL AS VARCHAR) AS prev FROM emissions WHERE i = 1
UNION ALL
SELECT e.trip_id, e.run, e.i, e.label, e.cost + least(CAST({C.SWITCH_COST} AS DOUBLE), coalesce(b.totals[e.label] - b.lowest, {C.SWITCH_COST})),
  CASE WHEN b.totals[e.label] - b.lowest <= {C.SWITCH_COST} THEN e.label ELSE b.best END
FROM (SELECT trip_id, run, i, min(total) AS lowest, arg_min(label, (total, label)) AS best, map(list(label), list(total)) AS totals
  FROM paths GROUP BY trip_id, run, i) b
JOIN emissions e ON e.trip_id = b.trip_id AND e.run = b.run AND e.i = b.i + 1"""
CTES["traced"] = """
SELECT p.trip_id, p.run, p.i, arg_min(p.label, (p.total, p.label)) AS label
FROM paths p JOIN (SELECT trip_id, run, max(i) AS i FROM steps_of_runs GROUP BY trip_id, run) z ON z.trip_id = p.trip_id AND z.run = p.run AND z.i = p.i
GROUP BY p.trip_id, p.run, p.i
UNION ALL
SELECT x.trip_id, x.run, x.i - 1, p.prev FROM traced x
JOIN paths p ON p.trip_id = x.trip_id AND p.run = x.run AND p.i = x.i AND p.label = x.label WHERE x.i > 1"""
CTES["matched"] = f"""
SELECT s.trip_id, s.run, s.seq, s.t, s.step_m, nullif(x.label, '') AS street, c.name, c.ref, c.highway
FROM traced x JOIN steps_of_runs s ON s.trip_id = x.trip_id AND s.run = x.run AND s.i = x.i
LEFT JOIN road_candidates c ON c.trip_id = s.trip_id AND c.seq = s.seq AND {LABEL.format(c='c')} = x.label"""
CTES["stretch_parts"] = f"""
SELECT trip_id, stretch, street, name, ref, highway, sum(step_m) AS m, min(t) AS a, max(t) AS z, min(t) FILTER (NOT starts) AS driven
FROM (SELECT *, brun IS DISTINCT FROM run AS starts,
    CAST(sum(CASE WHEN run = brun AND street IS NOT DISTINCT FROM bstreet THEN 0 ELSE 1 END)
      OVER (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stretch
  FROM (SELECT *, lag(run) OVER w AS brun, lag(street) OVER w AS bstreet FROM matched WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq)))
WHERE street IS NOT NULL GROUP BY trip_id, stretch, street, name, ref, highway
QUALIFY sum(sum(step_m)) OVER (PARTITION BY trip_id, stretch) >= {C.MIN_STRETCH_M}"""
CTES["street_entries"] = """
SELECT trip_id, pos, coalesce(road.name, road.ref) AS name, road.ref AS ref, road.highway AS highway, CAST(round_even(m, 0) AS BIGINT) AS distance_m,
  round(a, 2) AS start_t, round(z, 2) AS end_t
FROM (SELECT trip_id, pos, arg_max({'name': name, 'ref': ref, 'highway': highway}, (m, -driven)) FILTER (driven IS NOT NULL) AS road,
    sum(m) AS m, min(a) AS a, max(z) AS z
  FROM (SELECT trip_id, pos, name, ref, highway, sum(m) AS m, min(a) AS a, max(z) AS z, min(driven) AS driven
    FROM (SELECT *, CAST(sum(CASE WHEN street = before THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY stretch, highway ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos
      FROM (SELECT *, lag(street) OVER (PARTITION BY trip_id ORDER BY stretch, highway) AS before FROM stretch_parts))
    GROUP BY trip_id, pos, name, ref, highway) GROUP BY trip_id, pos)"""
CTES["street_labels"] = """
SELECT trip_id, pos, CASE WHEN ref IS NOT NULL THEN replace(ref, '-', '') ELSE name END AS label, distance_m FROM street_entries"""


def _same_neighbours(source: str) -> str:
    return f"""
SELECT trip_id, n AS pos, label, sum(distance_m) AS distance_m
FROM (SELECT *, CAST(sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n
  FROM (SELECT *, lag(label) OVER (PARTITION BY trip_id ORDER BY pos) AS before FROM {source})) GROUP BY trip_id, n, label"""


CTES["merged_labels"] = _same_neighbours("street_labels")
CTES["named_labels"] = _same_neighbours(f"(SELECT * FROM merged_labels WHERE distance_m >= {C.MIN_NAMED_STRETCH_M})")


def _truncated(text: str, length: str) -> str:
    return f"""(CASE WHEN length({text}) <= {length} THEN {text} ELSE regexp_replace(CASE WHEN contains(left({text}, {length}), ' ')
  THEN regexp_extract(left({text}, {length}), '(?s)^(.*) ', 1) ELSE left({text}, {length}) END, '[ ,\\-]+$', '') END)"""


def _fitted(s: str, length: str) -> str:
    """Labels of a list of ``{{label, d}}`` within a length: both ends, then the longest between them that still fit."""
    full = f"array_to_string(list_transform({s}, lambda x: x.label), '{C.STREET_SEPARATOR}')"
    ends = f"({s}[1].label || '{C.STREET_SEPARATOR}' || {s}[len({s})].label)"
    state = "{{'used': {used}, 'at': {at}, 'n': {n}, 'kept': {kept}}}"
    middle = f"""list_transform(list_sort(list_transform(range(2, CAST(len({s}) AS BIGINT)), lambda i: {{'d': -{s}[i].d, 'i': CAST(i AS INTEGER), 'n': length({s}[i].label)}})),
  lambda m: {state.format(used="CAST(0 AS BIGINT)", at="m.i", n="m.n", kept="[0]")})"""
    kept = f"""list_reduce(list_concat([{state.format(used=f"CAST(length({ends}) AS BIGINT)", at="0", n="CAST(0 AS BIGINT)", kept=f"[1, CAST(len({s}) AS INTEGER)]")}], {middle}),
  lambda a, m: CASE WHEN a.used + {len(C.STREET_SEPARATOR)} + m.n <= {length}
    THEN {state.format(used=f"a.used + {len(C.STREET_SEPARATOR)} + m.n", at="m.at", n="m.n", kept="list_append(a.kept, m.at)")} ELSE a END).kept"""
    return f"""CASE WHEN length({full}) <= {length} OR len({s}) <= 1 THEN {_truncated(full, length)} WHEN length({ends}) > {length}
  THEN {_truncated(f"{s}[1].label", length)} ELSE array_to_string(list_transform(list_sort({kept}), lambda i: {s}[i].label), '{C.STREET_SEPARATOR}') END"""


_CAR = " (Zoe 3)"
_ROOM = C.MAX_FILENAME_LENGTH - len("2024-01-01 " + _CAR + ".mp4")
CTES["label_lists"] = """
SELECT trip_id, list({'label': label, 'd': CAST(distance_m AS DOUBLE)} ORDER BY pos) AS s FROM named_labels GROUP BY trip_id"""
CTES["rename_order"] = f"""
SELECT *, row_number() OVER (PARTITION BY day ORDER BY start_time NULLS FIRST, filename) AS i FROM (
  SELECT t.trip_id, t.day, t.day || ' ' || t.name || '.mp4' AS filename, lower(t.day || ' ' || t.name) AS own, e.start_time,
    CASE WHEN l.s IS NULL THEN list_transform(range(5), lambda d: 'Trip ' || strftime(e.start_time + INTERVAL 2 HOUR, '%H-%M'))
      ELSE [{", ".join(_fitted("l.s", str(_ROOM - (d + 3 if d else 0))) for d in range(5))}] END AS texts
  FROM trip_tracks t LEFT JOIN ends e ON e.trip_id = t.trip_id LEFT JOIN label_lists l ON l.trip_id = t.trip_id) WHERE texts[1] IS NOT NULL"""
CTES["taken_names"] = """
SELECT d.day, list(n.stem) AS taken FROM (SELECT DISTINCT day FROM trip_tracks) d LEFT JOIN (
  SELECT lower(stem) AS stem FROM videos UNION SELECT lower(day || ' ' || name) FROM trip_tracks) n ON left(n.stem, 10) = d.day GROUP BY d.day"""


def _stem_of(n: str) -> str:
    return f"r.day || ' ' || r.texts[CASE WHEN {n} = 0 THEN 1 ELSE length(CAST({n} AS VARCHAR)) + 1 END] || CASE WHEN {n} > 0 THEN ' (' || {n} || ')' ELSE '' END || '{_CAR}'"


# One trip after the other takes its first free name, or its own.
CTES["name_walk"] = f"""
SELECT day, CAST(0 AS BIGINT) AS i, taken, CAST(NULL AS BIGINT) AS trip_id, CAST('' AS VARCHAR) AS filename, CAST('' AS VARCHAR) AS new_filename FROM taken_names
UNION ALL
SELECT day, i, CASE WHEN stem || '.mp4' = filename THEN taken ELSE list_append(taken, lower(stem)) END, trip_id, filename, stem || '.mp4'
FROM (SELECT r.day, r.i, w.taken, r.trip_id, r.filename, {_stem_of("list_filter(range(0, len(w.taken) + 2), lambda n: lower(" + _stem_of("n") + ") = r.own OR NOT list_contains(w.taken, lower(" + _stem_of("n") + ")))[1]")} AS stem
  FROM name_walk w JOIN rename_order r ON r.day = w.day AND r.i = w.i + 1)"""


def _with(body: str) -> str:
    """Prepend the named subqueries a query uses."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b(?!\()", sql):
                if re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
                    needed.append(name)
                    visit(CTES[name])

    visit(body)
    order = [n for n in CTES if n in needed]
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _time(column: str) -> str:
    return TIME.format(column)


SAMPLE_ROWS = (
    f"SELECT trip_id, seq, {_time('time')} AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, kmh, status, "
    f"{_f('estimated')} AS estimated FROM "
)
FLEET = (
    "count(*) AS trips, round(coalesce(sum(distance_km), 0), 2) AS distance_km, "
    "CAST(coalesce(sum(duration_s), 0) AS BIGINT) AS duration_s, "
    "round(sum(distance_km) / sum(CASE WHEN avg_kmh > 0 THEN distance_km / avg_kmh END), 3) AS avg_kmh, max(max_kmh) AS max_kmh"
)
STORED = (
    "round_even(t, 2)::DOUBLE AS t, {time} AS time, round_even(lat, 6)::DOUBLE AS lat, round_even(lon, 6)::DOUBLE AS lon, kmh, status"
)
FAULTY = "c.trip_id % 20 IN (1, 2, 4, 6, 8, 10)"


def _finding(rule, severity, subject, detail, fix, source) -> str:
    return (
        f"SELECT '{rule}' AS rule, {severity} AS severity, {subject} AS subject, {detail} AS detail, "
        f"CAST({fix} AS VARCHAR) AS fix FROM {source}"
    )


CTES["conflicts"] = "SELECT DISTINCT v.stem FROM videos v JOIN shared s ON lower(v.stem) = s.key"
CTES["checked"] = """
SELECT * FROM videos WHERE stem NOT IN (SELECT stem FROM conflicts) AND stem NOT IN (SELECT stem FROM unreadable)"""
CTES["orphans"] = "SELECT file_stem FROM tracks WHERE stem NOT IN (SELECT v.stem FROM videos v)"
CTES["known"] = """
SELECT c.*, b.old_stem, o.file_stem AS orphan FROM checked c
LEFT JOIN (SELECT fingerprint, max(file_stem) AS old_stem FROM tracks GROUP BY 1) b ON b.fingerprint = c.fingerprint
LEFT JOIN orphans o ON o.file_stem = b.old_stem
WHERE c.stem NOT IN (SELECT t.file_stem FROM tracks t) AND c.stem NOT IN (SELECT t.stem FROM tracks t)"""
CTES["renamed"] = "SELECT * FROM known WHERE orphan IS NOT NULL"
AUDIT = "\nUNION ALL ".join([
    _finding("R1", "'error'", "stem", "reason", "NULL", "unreadable"),
    _finding("R2", "'error'", "t.file_stem", "t.video_filename",
             "CASE WHEN o.file_stem IS NULL THEN 'rename to ' || t.stem || '.json' END",
             "tracks t LEFT JOIN (SELECT DISTINCT file_stem FROM tracks) o ON o.file_stem = t.stem WHERE t.file_stem <> t.stem"),
    _finding("R3", "'info'", "file_stem", "'older extractor'", "NULL", "tracks WHERE extractor_version < 1"),
    _finding("R4", "'info'", "file_stem", "'older cleaning'", "NULL",
             "tracks WHERE extractor_version >= 1 AND extraction_status = 'ok' AND cleaning_version < 2"),
    _finding("R5", "'info'", "file_stem",
             "CASE WHEN enrichment_status = 'missing' THEN 'no street list' ELSE 'outdated street list' END", "NULL",
             "tracks WHERE extraction_status = 'ok' AND enrichment_status <> 'current'"),
    _finding("R6", "'warning'", "file_stem", "'GPS text but no accepted fix'", "NULL", "tracks t WHERE t.doc_id IN (SELECT trip_id FROM readings WHERE gps_text <> '') AND t.doc_id NOT IN "
             "(SELECT trip_id FROM gps_read WHERE lat BETWEEN 49.0 AND 49.86 AND lon BETWEEN 22 AND 40.5)"),
    _finding("R7", "'warning'", "file_stem", "'shares content ' || fingerprint", "NULL",
             "(SELECT *, count(*) OVER (PARTITION BY fingerprint) AS n FROM tracks) WHERE n > 1"),
    _finding("R8", "'error'", "name", "'would share a track with another video'", "NULL", "shared"),
    _finding("R10", "'warning'", "c.name", "'changed since extraction'", "NULL",
             "checked c JOIN tracks t ON t.file_stem = c.stem WHERE (c.size <> t.video_size OR c.mtime <> t.video_mtime) AND c.fingerprint <> t.fingerprint"),
    _finding("R11", "'warning'", "name", "old_stem", "'rename its track and preview'", "renamed"),
    _finding("R12", "'warning'", "name", "old_stem", "NULL", "known WHERE old_stem IS NOT NULL AND orphan IS NULL"),
    _finding("R13", "'info'", "name", "'no track'", "NULL", "known WHERE old_stem IS NULL"),
    _finding("R14", "'info'", "o.file_stem", "'unreachable'", "NULL",
             "orphans o WHERE o.file_stem NOT IN (SELECT old_stem FROM renamed)"),
    _finding("R15", "'warning'", "'trip index'", "'missing or out of date'", "'rebuild it'",
             "(SELECT count(*) AS n FROM trip_tracks WHERE trip_id = 7) WHERE n > 0"),
    _finding("R16", "'warning'", "p.stem || '.mp4'", "'preview without a track'", "'delete it'",
             "previews p WHERE p.stem NOT IN (SELECT t.file_stem FROM tracks t)"),
    _finding("R16", "CASE WHEN age_s >= 3600 THEN 'warning' ELSE 'info' END", "path",
             "CASE WHEN age_s >= 3600 THEN 'leftover file' ELSE 'recent temporary file' END",
             "CASE WHEN age_s >= 3600 THEN 'delete it' END", "leftovers"),
])

CTES["good_tracks"] = "SELECT * FROM tracks WHERE file_stem = stem"
CTES["skipped"] = "SELECT file_stem AS stem FROM tracks WHERE file_stem <> stem UNION SELECT stem FROM unreadable"
CTES["by_content"] = """
SELECT fingerprint, max(stem) AS known, arg_max(here, stem) AS here FROM (
  SELECT t.stem, t.fingerprint, t.stem IN (SELECT v.stem FROM videos v) AS here FROM good_tracks t) GROUP BY 1"""
CTES["extraction"] = """
SELECT v.*, t.fingerprint AS tf, t.video_size, t.video_mtime, s.stem IS NOT NULL AS is_skipped, b.known, b.here,
  min(CASE WHEN t.stem IS NULL AND s.stem IS NULL AND b.known IS NOT NULL AND NOT b.here THEN v.name END)
    OVER (PARTITION BY v.fingerprint) AS heir
FROM videos v LEFT JOIN good_tracks t ON t.stem = v.stem LEFT JOIN skipped s ON s.stem = v.stem
LEFT JOIN by_content b ON b.fingerprint = v.fingerprint"""

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz#", "абцдефгґійклмнопярстувюхєз'"


def _transliterate(text: str) -> str:
    letters = ", ".join(f"'{k}': '{v}'" for k, v in C.KMU_LETTERS.items())
    initials = ", ".join(f"'{k}': '{v}'" for k, v in C.KMU_INITIAL_LETTERS.items())
    return f"""
SELECT p_partkey, array_to_string(list_transform(range(1, length(x) + 1), lambda i: (
  CASE WHEN x[i] = '''' THEN '' ELSE coalesce(
    CASE WHEN x[i] = lower(x[i]) THEN m(x, i) WHEN i < length(x) AND x[i + 1] <> lower(x[i + 1]) THEN upper(m(x, i))
      ELSE upper(m(x, i)[1]) || m(x, i)[2:] END, x[i]) END)), '') AS latin
FROM (SELECT p_partkey, {text} AS x FROM part)""".replace(
        "m(x, i)",
        f"(CASE WHEN lower(x[i]) = 'г' AND i > 1 AND lower(x[i - 1]) = 'з' THEN 'gh' "
        f"WHEN i = 1 OR NOT regexp_matches(x[i - 1], '^[\\p{{L}}'']$') "
        f"THEN coalesce((MAP {{{initials}}})[lower(x[i])], (MAP {{{letters}}})[lower(x[i])]) "
        f"ELSE (MAP {{{letters}}})[lower(x[i])] END)",
    )


def _build() -> dict[str, str]:
    q: dict[str, str] = {}
    stored = STORED.format(time="strftime(time + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00'")
    q["s1_read_tracks"] = f"""
SELECT CAST(trip_id AS VARCHAR) AS trip_id, seq, {STORED.format(time=_time('time'))}, {_f('estimated')} AS estimated,
  gps_text, clock_text, gps_score, clock_score FROM clean c
WHERE trip_id % 20 NOT IN (6, 8, 10) AND trip_id NOT IN (SELECT s.trip_id FROM clean s WHERE s.trip_id % 20 IN (1, 4) AND s.status = 'ok'
  UNION ALL SELECT s.trip_id FROM clean s WHERE s.trip_id % 20 = 4 AND s.lat IS NOT NULL
  UNION ALL SELECT s.trip_id FROM clean s WHERE s.trip_id % 20 = 2 AND s.time IS NOT NULL)"""
    q["s2_validate_tracks"] = """
SELECT CAST(trip_id AS VARCHAR) AS file_stem, CASE trip_id % 20 WHEN 10 THEN 'invalid JSON' WHEN 8 THEN 'missing field video.width'
  WHEN 6 THEN 'invalid override range'
  WHEN 1 THEN 'invalid sample #' || CAST(min(seq + 1) FILTER (status = 'ok') AS VARCHAR) || ': unknown status'
  WHEN 2 THEN 'invalid sample #' || CAST(min(seq + 1) FILTER (time IS NOT NULL) AS VARCHAR) || ': time needs a UTC offset'
  WHEN 4 THEN 'invalid sample #' || CAST(min(seq + 1) FILTER (lat IS NOT NULL) AS VARCHAR) || ': lat and lon must be numbers or null'
  END AS reason FROM clean GROUP BY trip_id"""
    q["s3_persisted_samples"] = f"""
SELECT trip_id, seq, {stored}, {_f('estimated')} AS estimated, gps_text || ' | ' || clock_text AS raw, gps_score, clock_score FROM clean"""
    q["s5_scan_clips"] = """
SELECT camera_id, name, CASE WHEN folder = 'RO' THEN 'RO/' WHEN size % 3 = 0 THEN 'Backup/' ELSE 'Movie/' END || name AS path,
  CAST(CASE WHEN size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM clips"""
    q["s6_load_map_chunks"] = """
SELECT way_id, c // 7 AS chunk, least(8, 21 - c) AS points, name, ref, highway, round((lat_u + c * 1000) / 1000000, 6) AS min_lat,
  round((lat_u + least(c + 7, 20) * 1000) / 1000000, 6) AS max_lat, round(lon_u / 1000000, 6) AS min_lon, round(lon_u / 1000000, 6) AS max_lon
FROM map_roads, (VALUES (0), (7), (14)) r(c)"""
    q["s6_load_map_localities"] = "SELECT name, place, population, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places"
    q["s7_update_encoded_log"] = """
SELECT camera_id, name, max(CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END) AS size FROM clips
WHERE idx % 4 = 0 OR size % 3 = 0 GROUP BY ALL"""
    q["s8_index_table"] = "SELECT 3 AS format_version, extraction_status, count(*) AS trips FROM trip_tracks GROUP BY ALL"
    q["s9_update_index"] = """
SELECT CASE WHEN trip_id = 7 THEN '2024-01-02 Renamed' ELSE day || ' ' || name END AS id,
  CASE WHEN trip_id = 7 THEN 'Renamed' ELSE name END AS name, trip_id FROM trip_tracks"""
    q["f1_reliable_texts"] = """
SELECT trip_id, count(*) FILTER (gps_text <> '' AND gps_score >= 0.6) AS gps, count(*) FILTER (clock_text <> '' AND clock_score >= 0.6) AS clock
FROM readings GROUP BY trip_id"""
    q["f2_allowed_positions"] = f"SELECT trip_id, count(*) AS samples FROM gps_read WHERE {AREA} GROUP BY trip_id"
    q["f3_overrides"] = f"""
SELECT * FROM (SELECT trip_id, seq, {_f('trip_id % 9 = 0 AND t BETWEEN 5 AND 7')} AS bad,
  {_f('trip_id % 10 = 3 AND t BETWEEN 30 AND 31')} AS good FROM readings) WHERE bad = 1 OR good = 1"""
    q["p3_parse_gps_text"] = "SELECT trip_id, seq, kmh, lat, lon FROM gps_read"
    q["p4_parse_clock_text"] = f"SELECT trip_id, seq, {_time('clock_d')} AS clock FROM clock_read"
    q["p5_year_last_dates"] = """
SELECT trip_id, count(*) AS dates, max(first_number) AS first, max(middle_number) AS middle FROM clock_read WHERE year_last GROUP BY trip_id"""
    q["a2_day_first_votes"] = f"""
SELECT *, {_f("CASE WHEN votes_day + votes_month > 0 THEN votes_day >= votes_month ELSE votes_date_day >= votes_date_month END")} AS day_first FROM votes"""
    q["p7_initial_status"] = "SELECT trip_id, initial AS initial_status, count(*) AS samples FROM parsed_a GROUP BY ALL"
    q["f4_plausible_clocks"] = "SELECT trip_id, count(instant) AS plausible, count(clock) AS readable FROM parsed_o GROUP BY trip_id"
    q["p6_local_clock_to_utc"] = f"SELECT trip_id, seq, {_time('instant')} AS instant FROM parsed_o"
    q["p33_clock_offset"] = "SELECT trip_id, seq, epoch(clock_d) - t AS clock_offset_s FROM clock_read"
    q["p1_haversine"] = f"SELECT trip_id, seq, round({hav('50.45', '30.52', 'lat', 'lon')}, 3) AS meters FROM gps_read WHERE lat IS NOT NULL"
    q["p2_implied_speed"] = """
SELECT l_linenumber, count(*) AS rows, count(*) FILTER (kmh >= 1e300) AS infinite, round(max(kmh) FILTER (kmh < 1e300), 3) AS max_kmh FROM (SELECT l_linenumber,
  CASE WHEN l_linenumber - 3 <= 0 THEN CASE WHEN l_quantity > 0 THEN 1e301 ELSE 0 END ELSE l_quantity / (l_linenumber - 3.0) * 3.6 END AS kmh
  FROM lineitem) GROUP BY l_linenumber"""
    m = f"({_M})"
    q["p8_p9_measure_segment"] = f"""
SELECT trip_id, seq, round(sqrt(power(x1 + f * dx, 2) + power(y1 + f * dy, 2)), 3) AS distance_m, round(dx / sqrt(dx * dx + dy * dy), 6) AS east,
  round(dy / sqrt(dx * dx + dy * dy), 6) AS north
FROM (SELECT *, least(1.0, greatest(0.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) AS f
  FROM (SELECT trip_id, seq, (24.0 - lon) * {m} * cos(radians(lat)) AS x1, (49.80 - lat) * {m} AS y1,
    (24.01 - lon) * {m} * cos(radians(lat)) - (24.0 - lon) * {m} * cos(radians(lat)) AS dx, (49.82 - lat) * {m} - (49.80 - lat) * {m} AS dy
    FROM gps_read))"""
    # A tick takes its last reliable GPS text, else that of its last frame.
    q["w1_collapse_frames"] = """
SELECT trip_id, min(seq) AS seq, min(t) AS t, coalesce(arg_max(gps_text, seq) FILTER (ok), arg_max(gps_text, seq)) AS gps_text, any_value(clock_text) AS clock_text,
  coalesce(arg_max(gps_score, seq) FILTER (ok), arg_max(gps_score, seq)) AS gps_score, any_value(clock_score) AS clock_score
FROM (SELECT *, gps_text <> '' AND gps_score >= 0.6 AS ok,
    sum(CASE WHEN clock_text IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS tick
  FROM (SELECT *, lag(clock_text) OVER (PARTITION BY trip_id ORDER BY t, seq) AS before FROM frames)) GROUP BY trip_id, tick"""
    q["w2_w3_segments_and_places"] = """
SELECT trip_id, place, segment, count(*) AS fixes, min(seq) AS first_seq, max(seq) AS last_seq FROM fixes_o GROUP BY ALL"""
    q["j8_speed_pairs"] = "SELECT trip_id, seq, round(mismatch, 3) AS mismatch_kmh FROM pairs_o"
    q["a1_a3_a4_segment_verdicts"] = f"""
SELECT trip_id, segment, place, weight, first_t, last_t, readable, implausible, speed_pairs, {_f('speed_mismatch')} AS speed_mismatch FROM segments_o"""
    q["j11_u1_segment_chain"] = "SELECT trip_id, segment FROM kept_o"
    q["w22_good_fixes"] = "SELECT trip_id, status0 AS status, count(*) AS samples FROM status_o GROUP BY ALL"
    q["w4_w5_clock_jumps"] = "SELECT trip_id, seq, jump AS jump_s FROM jumps_o WHERE jump > 0"
    q["e1_clean_tracks"] = SAMPLE_ROWS + "clean_o"
    q["w7_assigned_times"] = f"""
SELECT trip_id, {_time('min(time)')} AS first, {_time('max(time)')} AS last, count(*) FILTER (estimated) AS estimated FROM clean GROUP BY trip_id"""
    q["w8_interpolated_samples"] = SAMPLE_ROWS + "clean WHERE status = 'interpolated'"
    q["e2_reclean"] = """
SELECT trip_id, status, count(*) AS samples FROM clean_r WHERE trip_id % 24 < 10 AND trip_id <> 7 AND trip_id % 25 <> 24 GROUP BY ALL"""
    q["f5_located_samples"] = "SELECT trip_id, count(*) AS samples FROM steps WHERE located GROUP BY trip_id"
    q["a5_trip_stats"] = f"""
SELECT trip_id, {_time('start_time')} AS start_time, {_time('end_time')} AS end_time, duration_s, distance_km, avg_kmh, max_kmh, coverage, n_ok, n_spoofed,
  round(min_lat, 6) AS min_lat, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, round(max_lon, 6) AS max_lon FROM stats"""
    q["a18_trip_ends"] = f"""
SELECT trip_id, {_time('start_time')} AS start_time, round(start_lat, 6) AS start_lat, round(end_lat, 6) AS end_lat FROM ends"""
    q["a19_status_counts"] = "SELECT trip_id, " + ", ".join(
        f"count(*) FILTER (status = '{s}') AS {s}" for s in C.ALL_STATUSES
    ) + " FROM clean GROUP BY trip_id"
    q["w9_w10_route_runs"] = "SELECT trip_id, run, count(*) AS points, min(seq) AS first_seq, max(seq) AS last_seq FROM runs GROUP BY ALL"
    q["w11_route_gaps"] = """
SELECT trip_id, from_seq, to_seq FROM (SELECT trip_id, max(seq) AS from_seq, lead(min(seq)) OVER (PARTITION BY trip_id ORDER BY run) AS to_seq
  FROM runs GROUP BY trip_id, run) WHERE to_seq IS NOT NULL"""
    q["w12_match_runs"] = """
SELECT trip_id, run, count(*) AS points, min(seq) AS first_seq, round(sum(step_m), 3) AS meters FROM match GROUP BY ALL"""
    q["p29_headings"] = "SELECT trip_id, seq, round(heading_east, 6) AS east, round(heading_north, 6) AS north FROM heading"
    q["w19_speed_stretches"] = """
SELECT trip_id, bucket, min(pseq) AS from_seq, max(seq) AS to_seq, count(*) + 1 AS points FROM (
  SELECT *, sum(CASE WHEN bucket = before AND run = brun THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS stretch
  FROM (SELECT *, lag(bucket) OVER (PARTITION BY trip_id ORDER BY t, seq) AS before, lag(run) OVER (PARTITION BY trip_id ORDER BY t, seq) AS brun
    FROM (SELECT *, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 20 THEN '< 20' WHEN v < 40 THEN '20-40' WHEN v < 60 THEN '40-60'
        WHEN v < 90 THEN '60-90' WHEN v < 120 THEN '90-120' ELSE '120+' END AS bucket
      FROM (SELECT *, coalesce(lag(kmh) OVER r, kmh) AS v, lag(seq) OVER r AS prior FROM runs WINDOW r AS (PARTITION BY trip_id, run ORDER BY t, seq))
      WHERE prior IS NOT NULL))) GROUP BY trip_id, run, stretch, bucket"""
    q["j9_position_at"] = """
SELECT trip_id, second, round(CASE WHEN located THEN CASE WHEN moves THEN lat + (nlat - lat) * (second - t) / (nt - t) ELSE lat END END, 6) AS lat,
  round(CASE WHEN located THEN CASE WHEN moves THEN lon + (nlon - lon) * (second - t) / (nt - t) ELSE lon END END, 6) AS lon
FROM (SELECT *, coalesce(nlocated AND nt - t <= 3 AND coalesce(epoch(ntime) - epoch(time) BETWEEN 0 AND 60, TRUE), FALSE) AS moves
  FROM (SELECT m.second, s.* FROM (SELECT trip_id, t + 0.2 AS second FROM clean) m ASOF JOIN (
    SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(t) OVER w AS nt, lead(time) OVER w AS ntime, lead(located) OVER w AS nlocated
    FROM steps WINDOW w AS (PARTITION BY trip_id ORDER BY t, seq)) s ON m.trip_id = s.trip_id AND m.second >= s.t))"""
    q["j10_nearest_sample"] = """
SELECT trip_id, point_id, seq FROM (SELECT s.trip_id, point_id, seq, row_number() OVER (PARTITION BY s.trip_id, point_id ORDER BY
    power(s.lat - (49.8 + s.trip_id * 0.001 + point_id * 0.0041), 2) + power((s.lon - 24.001) * cos(radians(49.8 + s.trip_id * 0.001 + point_id * 0.0041)), 2), t, seq) AS r
  FROM steps s, (VALUES (0), (1)) p(point_id) WHERE located) WHERE r = 1"""
    q["e5_build_index"] = "SELECT id, trip_id, day AS date, name, extraction_status, duration_s, distance_km, coverage FROM trips"
    q["e18_import_all"] = """
SELECT t.id, t.distance_km, t.coverage, coalesce(n.streets, 0) AS streets FROM trips t
LEFT JOIN (SELECT trip_id, CAST(count(DISTINCT name) AS INTEGER) AS streets FROM street_entries GROUP BY trip_id) n ON n.trip_id = t.trip_id"""
    q["a9_fleet_stats"] = f"SELECT day, {FLEET} FROM trips GROUP BY ROLLUP (day)"
    q["a12_trip_bounds"] = """
SELECT round(min(min_lat), 6) AS min_lat, round(min(min_lon), 6) AS min_lon, round(max(max_lat), 6) AS max_lat, round(max(max_lon), 6) AS max_lon FROM trips"""
    q["a14_date_bounds"] = """
SELECT count(*) AS trips, min(day) AS first_date, max(day) AS last_date, count(DISTINCT day) AS trip_days,
  CASE WHEN left(min(day), 4) = left(max(day), 4) THEN left(min(day), 4) ELSE left(min(day), 4) || '-' || left(max(day), 4) END AS years FROM trip_tracks"""
    q["o1_newest_first"] = """
SELECT id, row_number() OVER (ORDER BY k DESC, id) AS place FROM (SELECT id, coalesce(strftime(start_time, '%Y-%m-%dT%H:%M:%S'), day) AS k FROM trips)"""
    q["f12_usable_street_lists"] = """
SELECT trip_id, CASE WHEN extraction_status <> 'ok' OR trip_id NOT IN (SELECT s.trip_id FROM steps s WHERE s.located) OR trip_id % 7 NOT IN (1, 3) THEN 1 ELSE 0 END AS usable FROM trip_tracks"""
    q["f15_date_filters"] = """
SELECT o_orderkey, CASE WHEN a <> '' AND b <> '' AND a > b THEN b ELSE a END AS start, CASE WHEN a <> '' AND b <> '' AND a > b THEN a ELSE b END AS "end"
FROM (SELECT o_orderkey, CASE WHEN s > lo THEN s ELSE '' END AS a, CASE WHEN e < hi THEN e ELSE '' END AS b
  FROM (SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS s, strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 61 - 30 AS INTEGER), '%Y-%m-%d') AS e FROM orders),
    (SELECT strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS lo, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS hi FROM orders WHERE o_orderstatus = 'F'))"""
    q["f13_search_trips"] = """
SELECT day || ' ' || name AS id FROM trip_tracks WHERE day BETWEEN '2024-01-02' AND '2024-01-03' AND contains(lower(name), 'trip') AND contains(lower(name), '-1')"""
    q["f14_preset_dates"] = """
SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d - 7, '%Y-%m-%d') AS week, strftime(d - INTERVAL 1 MONTH, '%Y-%m-%d') AS month,
  strftime(d - INTERVAL 1 YEAR, '%Y-%m-%d') AS year FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"""
    q["e15_search_summary"] = f"SELECT {FLEET} FROM trips WHERE day >= '2024-01-02' AND contains(lower(name), 'trip 0')"
    q["f16_trips_with_gps"] = "SELECT day || ' ' || name AS id FROM trip_tracks WHERE extraction_status = 'ok'"
    q["w20_neighbor_trips"] = """
SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM (SELECT id, coalesce(strftime(start_time, '%Y-%m-%dT%H:%M:%S'), day) AS k
  FROM trips WHERE extraction_status = 'ok') WINDOW w AS (ORDER BY k DESC, id)"""
    q["o5_drawn_trips"] = """
SELECT day || ' ' || name AS id FROM trip_tracks WHERE day >= '2024-01-02' AND trip_id % 2 = 0 UNION ALL SELECT 'focused trip'"""
    q["p25_p28_report_texts"] = """
SELECT id, CASE WHEN max_kmh IS NULL THEN 'unknown' WHEN max_kmh < 20 THEN '< 20' WHEN max_kmh < 40 THEN '20-40' WHEN max_kmh < 60 THEN '40-60'
    WHEN max_kmh < 90 THEN '60-90' WHEN max_kmh < 120 THEN '90-120' ELSE '120+' END AS bucket,
  CASE WHEN coverage >= 0.95 THEN 'good' WHEN coverage >= 0.7 THEN 'partial' ELSE 'poor' END AS badge,
  CASE WHEN coverage * 100 >= 90 THEN 'green' WHEN coverage * 100 >= 50 THEN 'yellow' ELSE 'red' END AS style,
  coalesce(printf('%d:%02d:%02d', duration_s // 3600, duration_s % 3600 // 60, duration_s % 60), '-') AS status_duration,
  CASE WHEN duration_s * 60 >= 3600 THEN printf('%d:%02d:%02d', duration_s * 60 // 3600, duration_s * 60 % 3600 // 60, duration_s * 60 % 60)
    ELSE coalesce(printf('%d:%02d', duration_s, 0), '-') END AS duration,
  CASE WHEN distance_km * 40 >= 100 THEN CAST(floor(distance_km * 40 + 0.5) AS INTEGER) || ' km' ELSE coalesce(printf('%.1f km', distance_km * 40), '-') END AS distance,
  coalesce(max_kmh || ' km/h', '-') AS speed,
  strftime(CAST(day AS DATE), '%a, %b ') || CAST(day(CAST(day AS DATE)) AS VARCHAR) || strftime(CAST(day AS DATE), ', %Y') AS date,
  coalesce(strftime(start_time + INTERVAL 2 HOUR, '%H:%M:%S'), '?') AS clock, printf('%.5f, %.5f', min_lat, min_lon) AS corner
FROM trips"""
    q["p28_trip_routes"] = """
SELECT t.day || ' ' || t.name AS id, CASE WHEN s IS NULL AND e IS NULL THEN NULL WHEN s = e THEN s ELSE coalesce(s, '?') || ' -> ' || coalesce(e, '?') END AS route
FROM trip_tracks t JOIN trip_places p ON p.trip_id = t.trip_id"""
    q["u2_thin_points"] = "SELECT trip_id, run, seq, lat, lon FROM thinned WHERE n > 1 AND (kept OR i = n)"
    q["u3_e6_simplified_routes"] = "SELECT trip_id, run, pos, lat, lon FROM routes"
    q["a13_coverage_dots"] = """
SELECT r.trip_id, r.lat, r.lon FROM routes r JOIN (SELECT trip_id, arg_max(run, (n, -run)) AS run, max(n) AS n
  FROM (SELECT trip_id, run, count(*) AS n FROM routes GROUP BY ALL) GROUP BY trip_id) z ON z.trip_id = r.trip_id AND z.run = r.run AND r.pos = z.n // 2"""
    q["a10_heat_cells"] = 'SELECT "row", "column", trips FROM heat_cells'
    q["a11_e16_heatmap"] = f"""
SELECT "row", "column", trips, round(1 - power(1 - ({C.HEAT_MIN_LEVEL} + (1 - {C.HEAT_MIN_LEVEL}) * (ln(trips) / ln(greatest({C.HEAT_MIN_SCALE_COUNT},
    (SELECT max(trips) FROM heat_cells))))), CAST(1 AS DOUBLE) / {C.HEAT_OVERLAP}), 6) AS opacity
FROM (SELECT CAST(floor("row" / merge) AS BIGINT) AS "row", CAST(floor("column" / merge) AS BIGINT) AS "column", max(trips) AS trips FROM heat_cells, heat_scale GROUP BY ALL)"""
    q["f9_j5_named_roads"] = "SELECT way_id, name, ref, highway, 21 AS points FROM map_roads"
    q["f10_chunks_in_box"] = """
SELECT way_id, c // 7 AS chunk FROM map_roads, (VALUES (0), (7), (14)) r(c) WHERE lat_u + least(c + 7, 20) * 1000 >= 49850000
  AND lat_u + c * 1000 <= 49870000 AND lon_u BETWEEN 24000000 AND 24010000"""
    q["p20_p22_locality_radius"] = "SELECT name, round(radius, 3) AS radius_m FROM place_radii"
    q["p21_chunk_points"] = """
SELECT way_id, i // 7 AS chunk, i % 7 AS pos, round((lat_u + i * 1000) / 1000000, 6) AS lat, round(lon_u / 1000000, 6) AS lon FROM map_roads, range(20) r(i)
UNION ALL SELECT way_id, i // 7 - 1, 7, round((lat_u + i * 1000) / 1000000, 6), round(lon_u / 1000000, 6) FROM map_roads, (VALUES (7), (14)) r(i)
UNION ALL SELECT way_id, 2, 6, round((lat_u + 20000) / 1000000, 6), round(lon_u / 1000000, 6) FROM map_roads"""
    q["j6_a20_candidates"] = "SELECT trip_id, seq, name, ref, round(cost, 4) AS cost FROM candidates"
    q["u4_match_streets"] = "SELECT trip_id, seq, coalesce(name, ref) AS street FROM matched"
    q["w13_w14_a8_e3_streets"] = "SELECT trip_id, pos, name, ref, highway, distance_m, start_t, end_t FROM street_entries"
    q["p19_street_labels"] = "SELECT trip_id, pos, label FROM street_labels"
    q["w15_named_stretches"] = "SELECT trip_id, pos, label, CAST(distance_m AS DOUBLE) AS distance_m FROM named_labels"
    q["a7_a15_street_names"] = "SELECT DISTINCT name FROM street_entries"
    q["e4_enrich_stale"] = """
SELECT trip_id, pos, name, distance_m FROM street_entries WHERE trip_id % 3 = 0 AND trip_id % 25 <> 24"""
    q["j7_localities"] = "SELECT trip_id, s AS start, e AS \"end\" FROM trip_places"
    q["a6_samples_digest"] = "SELECT trip_id, samples_digest FROM digests"
    q["j15_e12_enrichment_status"] = """
SELECT trip_id, CASE trip_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'outdated' WHEN 3 THEN 'outdated' ELSE 'current' END AS enrichment_status FROM users"""
    q["p15_transliterate"] = _transliterate(
        "array_to_string(list_transform(string_split(translate(lower(p_name), "
        f"'{_LATIN}', '{_CYRILLIC.replace(chr(39), chr(39) * 2)}'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )
    q["p16_p18_normalize_ref"] = "SELECT p_partkey, 'M' || lpad(CAST(p_partkey % 20 AS VARCHAR), 2, '0') || 'E' AS ref FROM part"
    q["p17_drop_street_types"] = """
SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace('Old ' || p_brand || ' Street,  ' || p_name || ' AVE.', '\\s+', ' ', 'g')), ' '),
  lambda w: NOT list_contains([""" + ", ".join(f"'{w}'" for w in C.ENGLISH_STREET_TYPE_WORDS) + """], regexp_replace(lower(w), '[,:;]+$', ''))), ' ') AS name FROM part"""
    q["p23_truncate_words"] = r"""
SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(
  CASE WHEN contains(left(text, 60), ' ') THEN regexp_extract(left(text, 60), '(?s)^(.*) ', 1) ELSE left(text, 60) END, '[ ,\-]+$', '') END AS short FROM documents"""
    q["f11_rename_targets"] = r"SELECT name FROM library WHERE regexp_matches(name, '^.{11}Trip \d{2}-\d{2}\.(mp4|MOV)$')"
    q["f17_long_names"] = r"""
SELECT doc_id, CASE WHEN strlen(name) > 142 THEN 'use at most 142 ' || CASE WHEN strlen(name) = length(name) THEN 'characters' ELSE 'bytes in UTF-8' END
  || ' (' || strlen(name) || ' now)' END AS problem
FROM (SELECT doc_id, '2024-01-01 ' || regexp_replace(text, '\s+', ' ', 'g') || '.mov' AS name FROM documents)"""
    q["f18_filename_problems"] = """
SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'use ASCII characters only' WHEN doc_id % 7 = 0 THEN 'do not use any of / \\ : * ? " < > |'
  WHEN length(name) > 140 THEN 'use at most 140 characters (' || length(name) || ' now)' WHEN doc_id % 5 IN (0, 1) THEN 'start with the date (YYYY-mm-dd)'
  WHEN doc_id % 3 = 0 THEN 'keep the .mp4 extension' END AS problem
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Trip ' WHEN 1 THEN '2024-02-30 ' ELSE '2024-02-03 ' END
  || CASE doc_id % 7 WHEN 0 THEN 'a:b' WHEN 1 THEN 'é' ELSE 'ab' END || repeat('x', CASE WHEN doc_id % 11 = 0 THEN 140 ELSE 3 END) || '.mp4' AS name FROM documents)"""
    q["u5_fit_street_labels"] = f"""
SELECT g, {_fitted("s", "60")} AS text FROM (SELECT p_partkey // 9 AS g, list({{'label': 'Street ' || repeat('x', CAST(p_partkey % 7 AS INTEGER)) || p_partkey,
  'd': CAST(p_size * 1000 + p_partkey AS DOUBLE)}} ORDER BY p_partkey) AS s FROM part GROUP BY 1)"""
    q["w21_u6_e11_plan_renames"] = "SELECT trip_id, filename, new_filename FROM name_walk WHERE i > 0 AND new_filename <> filename"
    q["o3_taken_names"] = "SELECT lower(stem) AS stem FROM videos UNION SELECT lower(file_stem) FROM tracks"
    q["f7_p12_parse_clips"] = f"SELECT camera_id, name, idx, {_time('start_time')} AS start_time FROM driven"
    q["j3_new_clips"] = "SELECT camera_id, name, size FROM fresh"
    q["w16_a17_group_trips"] = f"""
SELECT camera_id, trip_seq, count(*) AS clips, arg_min(idx, (start_time, idx)) AS first_idx, arg_max(idx, (start_time, idx)) AS last_idx,
  {_time('min(start_time)')} AS start_time, strftime(min(start_time), '%Y-%m-%d Trip %H-%M') AS output_name FROM grouped GROUP BY ALL"""
    q["j4_e7_plan_trips"] = """
SELECT camera_id, trip_seq, clips, output_name, CASE WHEN same > 1 THEN 'duplicate' WHEN lower(output_name) IN (SELECT lower(stem) FROM videos) THEN 'exists'
  ELSE 'encode' END AS action
FROM (SELECT *, count(*) OVER (PARTITION BY lower(output_name)) AS same FROM (SELECT camera_id, trip_seq, count(*) AS clips,
  strftime(min(start_time), '%Y-%m-%d Trip %H-%M') AS output_name FROM fresh_grouped GROUP BY ALL))"""
    q["f8_p14_e8_plan_range"] = """
SELECT camera_id, clips, first_idx, last_idx, output_name, CAST(NULL AS VARCHAR) AS problem, CASE WHEN count(*) OVER (PARTITION BY output_name) > 1 THEN 'duplicate' ELSE 'encode' END AS action
FROM (SELECT camera_id, count(*) AS clips, arg_min(idx, (start_time, idx)) AS first_idx, arg_max(idx, (start_time, idx)) AS last_idx,
  strftime(min(start_time), '%Y-%m-%d To the sea') AS output_name FROM driven WHERE idx BETWEEN 100 AND 600 GROUP BY camera_id)"""
    q["f6_globs"] = r"SELECT name FROM library WHERE (regexp_matches(name, '^2024-0[1-3]-') OR name LIKE '%.MOV') AND NOT regexp_matches(name, 'no .7\.')"
    q["f19_probe_decisions"] = """
SELECT video, clocks, missing, CASE WHEN video % 7 = 0 THEN 'no_overlay' WHEN clocks >= 3 THEN 'ok' WHEN missing > 0 THEN 'retry' ELSE 'no_overlay' END AS decision
FROM (SELECT trip_id AS video, count(*) FILTER (i < trip_id % 6 AND NOT (trip_id % 3 = 0 AND i >= 8)) AS clocks,
  count(*) FILTER (trip_id % 3 = 0 AND i >= 8) AS missing FROM users, range(10) r(i) GROUP BY trip_id)"""
    q["p11_trip_names"] = "SELECT name, left(stem, 10) AS date, substr(stem, 12) AS trip FROM videos"
    q["p30_fingerprints"] = "SELECT doc_id, fingerprint FROM library"
    q["p32_resolve_stems"] = "SELECT doc_id, stem || CASE WHEN doc_id % 3 = 2 THEN '.v2' ELSE '' END AS stem FROM videos"
    q["j1_match_library"] = """
SELECT coalesce(v.stem, t.file_stem) AS stem, v.name AS video, t.doc_id AS track FROM videos v FULL JOIN tracks t ON v.stem = t.file_stem"""
    q["a16_same_content"] = """
SELECT * FROM (SELECT fingerprint, count(*) OVER (PARTITION BY fingerprint) AS copies, name FROM library) WHERE copies > 1"""
    q["a16_shared_names"] = "SELECT key, videos, name FROM shared"
    q["e10_without_shared_names"] = "SELECT doc_id, name FROM videos WHERE lower(stem) NOT IN (SELECT key FROM shared)"
    q["j2_e9_plan_extraction"] = """
SELECT name, CASE WHEN is_skipped THEN 'skip_unreadable' WHEN tf IS NOT NULL AND size = video_size AND mtime = video_mtime THEN 'up_to_date'
  WHEN tf = fingerprint THEN 'touch' WHEN tf IS NOT NULL THEN 'changed' WHEN heir = name THEN 'renamed' WHEN known IS NOT NULL THEN 'duplicate' ELSE 'new' END AS action,
  CASE WHEN tf IS NULL AND NOT is_skipped THEN CASE WHEN heir <> name THEN regexp_replace(heir, '\\.[^.]*$', '') ELSE known END END AS known_as FROM extraction"""
    q["j13_with_files"] = f"""
SELECT t.stem AS id, {_f('t.video_filename IN (SELECT name FROM library)')} AS has_video, {_f('t.stem IN (SELECT p.stem FROM previews p)')} AS has_preview FROM tracks t"""
    q["o4_tracks_without_videos"] = """
SELECT file_stem AS stem, 'track' AS kind FROM tracks WHERE file_stem NOT IN (SELECT v.stem FROM videos v)
UNION ALL SELECT v.stem, 'video' FROM videos v WHERE v.stem NOT IN (SELECT file_stem FROM tracks)"""
    none = "CAST(NULL AS VARCHAR) AS duration, CAST(NULL AS VARCHAR) AS distance, CAST(NULL AS VARCHAR) AS coverage_percent, CAST(NULL AS VARCHAR) AS coverage_color"
    q["e13_library_status"] = f"""
SELECT 'trip' AS section, t.file_stem AS name, printf('%d:%02d:%02d', coalesce(duration_s, 0) // 3600, coalesce(duration_s, 0) % 3600 // 60, coalesce(duration_s, 0) % 60) AS duration,
  printf('%.1f km', coalesce(distance_km, 0.0)) AS distance, CAST(CAST(round_even(coalesce(coverage * 100, 0), 0) AS INTEGER) AS VARCHAR) AS coverage_percent,
  CASE WHEN coalesce(coverage * 100, 0) >= 90 THEN 'green' WHEN coalesce(coverage * 100, 0) >= 50 THEN 'yellow' ELSE 'red' END AS coverage_color
FROM tracks t LEFT JOIN stats s ON s.trip_id = t.doc_id WHERE extraction_status <> 'no_overlay'
UNION ALL SELECT 'not extracted', v.name, {none} FROM videos v WHERE v.stem NOT IN (SELECT file_stem FROM tracks) AND v.stem NOT IN (SELECT u.stem FROM unreadable u)
UNION ALL SELECT 'no overlay', video_filename, {none} FROM tracks WHERE extraction_status = 'no_overlay'
UNION ALL SELECT 'unreachable', video_filename, {none} FROM tracks WHERE file_stem NOT IN (SELECT v.stem FROM videos v)
UNION ALL SELECT 'unreadable', stem, {none} FROM unreadable"""
    q["e14_audit"] = AUDIT
    q["e19_forget"] = """
SELECT file_stem AS stem, CASE WHEN file_stem IN (SELECT v.stem FROM videos v WHERE v.doc_id % 10 = 2) THEN 'archived' ELSE 'kept' END AS what FROM tracks
UNION ALL SELECT v.stem, 'unknown' FROM videos v WHERE v.doc_id % 10 = 2 AND v.stem NOT IN (SELECT file_stem FROM tracks)"""
    q["e20_missing_previews"] = """
SELECT v.name FROM videos v WHERE v.stem IN (SELECT file_stem FROM tracks WHERE extraction_status = 'ok') AND v.stem NOT IN (SELECT p.stem FROM previews p)"""
    q["e21_index_freshness"] = f"""
SELECT 0 AS other_version, {_f('max(video_mtime) > 1704067900')} AS newer_track, {_f('max(video_mtime) > 1704067900 OR count(*) FILTER (doc_id % 9 = 0) > 0')} AS is_stale,
  count(*) FILTER (doc_id % 9 = 0) AS set_differences FROM tracks"""
    q["w17_w18_flagged_readings"] = "SELECT trip_id, seq, t, reason FROM flagged"
    q["j12_speed_mismatches"] = "SELECT trip_id, seq, round(implied_kmh, 2) AS implied_kmh, displayed_kmh FROM mismatches"
    q["o2_reported_mismatches"] = """
SELECT trip_id, seq, rank FROM (SELECT trip_id, seq, row_number() OVER (PARTITION BY trip_id ORDER BY t, seq) AS rank FROM mismatches) WHERE rank <= 15"""
    q["a19_e17_quality_report"] = """
SELECT f.trip_id, f.frames, coalesce(g.n, 0) AS flagged, f.unreliable, f.reliable_gps, coalesce(m.n, 0) AS speed_mismatches
FROM (SELECT trip_id, count(*) AS frames, count(*) FILTER ((gps_text <> '' AND gps_score < 0.6) OR clock_score < 0.6) AS unreliable,
    count(*) FILTER (gps_text <> '' AND gps_score >= 0.6) AS reliable_gps FROM frames GROUP BY trip_id) f
LEFT JOIN (SELECT trip_id, count(*) AS n FROM flagged GROUP BY 1) g ON g.trip_id = f.trip_id
LEFT JOIN (SELECT trip_id, count(*) AS n FROM mismatches GROUP BY 1) m ON m.trip_id = f.trip_id"""
    q["a21_u7_p31_compose_readings"] = """
SELECT trip_id, t, gps_text, clock_text, CASE WHEN trip_id % 4 <> 0 AND gps_score < 0.65 THEN least(gps_score, 0.65) ELSE gps_score END AS gps_score,
  0.9 AS clock_score FROM readings WHERE gps_text <> ''"""
    q["t1_t6_live_trips"] = f"""
SELECT camera_id, count(*) AS clips, arg_min(idx, (start_time, idx)) AS first_idx, arg_max(idx, (start_time, idx)) AS last_idx,
  {_time('min(start_time)')} AS start_time FROM grouped GROUP BY camera_id, trip_seq"""
    q["t2_unseen_clips"] = "SELECT camera_id, name, size FROM fresh"
    q["t3_live_segments"] = "SELECT trip_id, segment, count(*) AS fixes, min(seq) AS first_seq, max(seq) AS last_seq FROM fixes_o GROUP BY ALL"
    q["t4_cleaned_closed_trips"] = SAMPLE_ROWS + "clean"
    q["t5_trip_activity"] = """
SELECT trip_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS fixes, max(kmh) AS max_kmh, round(sum(CASE WHEN joined THEN meters ELSE 0 END), 2) AS distance_m
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, time) - to_minutes(15 * i) AS w FROM steps, range(4) r(i) WHERE time IS NOT NULL) GROUP BY trip_id, w"""
    q["t5_live_activity"] = q["t5_trip_activity"]
    return {name: _with(sql.strip()) for name, sql in q.items()}


ORACLES = _build()
