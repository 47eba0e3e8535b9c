"""DuckDB SQL of the metadata queries."""

_ZONES = "['Europe/Paris','America/New_York','Asia/Tokyo','Australia/Sydney','Europe/Budapest','America/Denver','Asia/Kolkata','Africa/Nairobi']"
_POINTS = "points AS (SELECT event_id, ts, (event_id * 7919 % 17000) / 100.0::DOUBLE - 85 AS lat, (event_id * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon FROM events)"
_EDGES = """rings0 AS (SELECT pos, centroid_lon, unnest(rings) AS ring FROM tz_zone),
edges AS (SELECT pos, centroid_lon, e.a.lon AS x0, e.a.lat AS y0, e.b.lon AS x1, e.b.lat AS y1
 FROM (SELECT pos, centroid_lon, unnest(list_transform(range(1, len(ring)), lambda i: {'a': ring[i], 'b': ring[i + 1]})) AS e FROM rings0))"""
_INSIDE = """inside AS (SELECT event_id, min(pos) AS pos FROM (
 SELECT event_id, pos FROM points JOIN edges ON least(x0, x1) <= lon AND lon < greatest(x0, x1)
 WHERE y0 + (lon - x0) * ((y1 - y0) / (x1 - x0)) < lat GROUP BY event_id, pos HAVING count(*) % 2 = 1) GROUP BY event_id)"""
_NEAREST = """outside AS (SELECT event_id, lat, lon FROM points WHERE event_id NOT IN (SELECT event_id FROM inside)),
along AS (SELECT event_id, pos, centroid_lon, lon, sqrt((lon - x0 - t * (x1 - x0)) ** 2 + (lat - y0 - t * (y1 - y0)) ** 2) AS d FROM (
 SELECT *, greatest(0, least(1, ((lon - x0) * (x1 - x0) + (lat - y0) * (y1 - y0)) / CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 = 0 THEN 1 ELSE (x1 - x0) ** 2 + (y1 - y0) ** 2 END)) AS t FROM outside CROSS JOIN edges)),
near AS (SELECT event_id, pos, min(d) AS d, any_value(least(abs(lon - centroid_lon), 360 - abs(lon - centroid_lon)) > 7.5) AS beyond FROM along GROUP BY event_id, pos),
nearest AS (SELECT event_id, arg_min(pos, (beyond, d, pos)) AS pos FROM near GROUP BY event_id)"""
_FOUND = f"WITH {_POINTS}, {_EDGES}, {_INSIDE}, {_NEAREST}, found AS (SELECT event_id, tz_name AS tz FROM (SELECT * FROM inside UNION ALL SELECT * FROM nearest) JOIN tz_zone USING (pos))"
_WALL = f"SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey % 96) * 15) AS wall, {_ZONES}[o_custkey % 8 + 1] AS tz FROM orders"
_SECONDS = "(o_orderkey * 37 % 100000 - 50000)"


def _offset(tz: str, wall: str) -> str:
    utc = f"timezone('UTC', timezone({tz}, {wall}))"
    return f"CAST(epoch(timezone({tz}, timezone({tz}, {wall}))) - epoch({utc}) AS BIGINT)"


def _hhmm(minutes: str, negative: str) -> str:
    return f"(CASE WHEN {negative} THEN '-' ELSE '+' END || lpad(CAST(abs({minutes}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({minutes}) % 60 AS VARCHAR), 2, '0'))"


_FLOOR = f"CAST(floor({_SECONDS} / 60) AS BIGINT)"
_DROP = f"CAST(floor(abs({_SECONDS}) / 60) AS BIGINT)"
_PHOTO = "(SELECT DISTINCT * EXCLUDE (received_at) FROM photo_record)"
_LONG = f"""long AS (SELECT rec_id, unnest([
 {{'tag': 'SourceFile', 'v': source_file}}, {{'tag': 'ExifIFD:DateTimeOriginal', 'v': exififd_date_time_original}}, {{'tag': 'ExifIFD:OffsetTimeOriginal', 'v': exififd_offset_time_original}}, {{'tag': 'EXIF:GPSDateStamp', 'v': exif_gps_date_stamp}},
 {{'tag': 'EXIF:GPSTimeStamp', 'v': exif_gps_time_stamp}}, {{'tag': 'XMP:DateCreated', 'v': xmp_date_created}}, {{'tag': 'IPTC:Keywords', 'v': iptc_keywords}}, {{'tag': 'XMP:Subject', 'v': xmp_subject}}, {{'tag': 'Composite:GPSLatitude', 'v': composite_gps_latitude}},
 {{'tag': 'Composite:GPSLongitude', 'v': composite_gps_longitude}}, {{'tag': 'File:ImageWidth', 'v': CAST(file_image_width AS VARCHAR)}}, {{'tag': 'ExifIFD:ExposureCompensation', 'v': exififd_exposure_compensation}},
 {{'tag': 'XMP-xmp:Rating', 'v': CAST(xmp_rating AS VARCHAR)}}, {{'tag': 'System:FileModifyDate', 'v': system_file_modify_date}}], recursive := true) FROM {_PHOTO})"""
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NUMBER = "CASE WHEN regexp_matches(trim({0}), '" + _FLOAT + "') THEN TRY_CAST(trim({0}) AS DOUBLE) END"


def _parse(column: str) -> str:
    """As parse_naive: EXIF, ISO and basic ISO texts as wall times, text with six decimals."""
    zone = "(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?(?::?[0-9]{2})?)?"
    forms = (
        "^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})()$",
        f"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:.([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,]([0-9]+))?)?{zone})?$",
        f"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:.([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)?{zone})?$",
    )
    whens = []
    for form in forms:
        p = lambda i, form=form: f"regexp_extract({column}, '{form}', {i})"
        n = lambda i: f"coalesce(TRY_CAST(nullif({p(i)}, '') AS INTEGER), 0)"
        day = f"TRY_CAST({p(1)} || '-' || {p(2)} || '-' || {p(3)} AS DATE)"
        text = f"strftime({day}, '%Y-%m-%d') || ' ' || lpad(CAST({n(4)} AS VARCHAR), 2, '0') || ':' || lpad(CAST({n(5)} AS VARCHAR), 2, '0') || ':' || lpad(CAST({n(6)} AS VARCHAR), 2, '0') || '.' || rpad(left({p(7)}, 6), 6, '0')"
        whens.append(f"WHEN regexp_matches({column}, '{form}') THEN CASE WHEN {n(4)} < 24 AND {n(5)} < 60 AND {n(6)} < 60 AND {n(1)} > 0 AND {day} IS NOT NULL THEN {text} END")
    return "CASE " + " ".join(whens) + " END"


def _normal(column: str) -> str:
    t = f"trim({column})"
    named, plain = "(?i)^(?:UTC|GMT)\\s*([+-]?)([0-9]{1,2})(?::?([0-9]{2}))?$", "^([+-]?)([0-9]{1,2})(?::([0-9]{2}))?$"
    part = lambda form, i: f"regexp_extract({t}, '{form}', {i})"
    two = lambda form, i: f"lpad(coalesce(nullif({part(form, i)}, ''), '0'), 2, '0')"
    whole = lambda form, sign: f"{sign} || {two(form, 2)} || ':' || {two(form, 3)}"
    return (
        f"CASE WHEN regexp_matches({t}, '^[+-][0-9]{{2}}:[0-9]{{2}}$') THEN {t} WHEN regexp_matches({t}, '^[+-][0-9]{{4}}$') THEN left({t}, 3) || ':' || right({t}, 2) "
        f"WHEN regexp_matches({t}, '{named}') THEN " + whole(named, f"CASE WHEN {part(named, 1)} = '-' THEN '-' ELSE '+' END") + f" WHEN regexp_matches({t}, '{plain}') THEN " + whole(plain, f"CASE WHEN {part(plain, 1)} = '-' AND TRY_CAST({part(plain, 2)} AS INTEGER) > 0 THEN '-' ELSE '+' END") + " END"
    )


_RINGS = "rings1 AS (SELECT pos, unnest(rings) AS ring, generate_subscripts(rings, 1) - 1 AS ring_no FROM tz_zone)"

_WHOLE = r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})([.][0-9]*)?([+-][0-9]{2}:[0-9]{2}|Z)?$"
_A = "ExifIFD:DateTimeOriginal"


def _exif_of(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT)), '%Y:%m:%d %H:%M:%S')"


def _versus(tag: str, name: str, x: str, y: str, tolerance: int) -> str:
    return f"'{tag} {name}=' || {_exif_of(x)} || ' vs. {_A} ' || {_exif_of(y)} || ' diff_secs=' || abs({x} - {y}) || ' tolerance_secs={tolerance}'"


def _unfit(names: str, text: str) -> str:
    return f"'DateTimeParseError: Cannot parse ' || {names} || ' DateTimeParseError: ''' || {text} || ''' does not match the form of a date and time'"


def _read_sql(x: str, fits: str) -> str:
    """Columns of a joined text: whether it fits, seconds and zone."""
    clock = f"CASE WHEN substr({x}_t, 12, 2) < '24' AND substr({x}_t, 15, 2) < '60' AND substr({x}_t, 18, 2) < '60' THEN CAST(substr({x}_t, 12, 2) AS BIGINT) * 3600 + CAST(substr({x}_t, 15, 2) AS BIGINT) * 60 + CAST(substr({x}_t, 18, 2) AS BIGINT) END"
    day = f"TRY_CAST(replace(substr({x}_t, 1, 10), ':', '-') AS DATE) - DATE '1970-01-01'"
    zone = f"regexp_extract(substr({x}_t, 20), '(?:[+-][0-9]{{2}}:[0-9]{{2}}|Z)$')"
    return f"coalesce({fits}, false) AS {x}_fits, CASE WHEN {x}_fits AND substr({x}_t, 1, 4) <> '0000' THEN ({day}) * 86400 + {clock} END AS {x}_s, CASE WHEN {x}_fits THEN {zone} END AS {x}_z"


def _zone_seconds(z: str) -> str:
    return f"CASE WHEN {z} = 'Z' THEN 0 WHEN {z} <> '' THEN CASE WHEN {z}[1] = '-' THEN -1 ELSE 1 END * (CAST(substr({z}, 2, 2) AS BIGINT) * 3600 + CAST(substr({z}, 5, 2) AS BIGINT) * 60) END"


_OFFSET_TEXT = "(CASE WHEN {0} < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs({0}) // 3600, abs({0}) % 3600 // 60))"
_MATCHES = "regexp_matches({0}_t, '" + _WHOLE.replace("{", "{{").replace("}", "}}") + "')"
_O_NAME = f"'{_A}' || CASE WHEN o <> '' THEN '+ExifIFD:OffsetTimeOriginal' ELSE '' END"
_T_NAME = "'EXIF:GPSDateStamp' || CASE WHEN t <> '' THEN '+EXIF:GPSTimeStamp' ELSE '' END"
_FINDINGS = f"""joined AS (SELECT rec_id, source_file AS f, exififd_date_time_original AS a, exififd_offset_time_original AS o, xmp_date_created AS x, exif_gps_date_stamp AS g, exif_gps_time_stamp AS t,
 a || coalesce(o, '') AS a_t, x AS x_t, g || coalesce(' ' || nullif(t, ''), '') AS g_t FROM {_PHOTO} WHERE coalesce(exififd_date_time_original, exififd_offset_time_original, xmp_date_created, exif_gps_date_stamp, exif_gps_time_stamp) IS NOT NULL),
parsed AS (SELECT *, {_read_sql('a', _MATCHES.format('a'))}, {_read_sql('x', _MATCHES.format('x'))}, {_read_sql('g', _MATCHES.format('g') + " AND length(g_t) = 19")} FROM joined),
zoned AS (SELECT *, {_zone_seconds('a_z')} AS a_o, {_zone_seconds('x_z')} AS x_o FROM parsed),
instants AS (SELECT *, coalesce(a_o, CASE WHEN x_s IS NOT NULL THEN x_o END) AS off, coalesce(a_s - a_o, x_s - x_o, g_s) AS utc FROM zoned),
events AS (SELECT rec_id, f, unnest(CASE
 WHEN NOT a_fits AND (a IS NULL OR a = repeat(' ', 19)) AND regexp_matches(f, 'photos/(....)/(..)/(..)') THEN [{{'n': 0, 'severity': 'fixable', 'tag': '{_A}', 'detail': regexp_extract(f, 'photos/(....)/(..)/(..)', 1) || ':' || regexp_extract(f, 'photos/(....)/(..)/(..)', 2) || ':' || regexp_extract(f, 'photos/(....)/(..)/(..)', 3) || ' 00:00:00'}}]
 WHEN NOT a_fits THEN [{{'n': 0, 'severity': 'fatal', 'tag': '{_A}' || CASE WHEN o IS NOT NULL THEN '+ExifIFD:OffsetTimeOriginal' ELSE '' END,
  'detail': CASE WHEN a IS NULL THEN 'DateTimeParseError: Cannot parse {_A} KeyError: ''{_A}''' ELSE {_unfit(_O_NAME, 'a_t')} END}}]
 WHEN a_s IS NULL OR x_fits AND x_s IS NULL OR g_fits AND g_s IS NULL THEN [{{'n': 0, 'severity': 'error', 'tag': '{_A}', 'detail': 'ValueError'}}]
 ELSE [{{'n': 1, 'severity': 'deletable', 'tag': 'XMP:DateCreated', 'detail': CASE WHEN x IS NOT NULL AND NOT x_fits THEN {_unfit("'XMP:DateCreated'", 'x_t')} END}},
  {{'n': 2, 'severity': 'deletable', 'tag': 'EXIF:GPSDateStamp', 'detail': CASE WHEN g IS NOT NULL AND NOT g_fits THEN {_unfit(_T_NAME, 'g_t')} END}},
  {{'n': 3, 'severity': 'deletable', 'tag': 'EXIF:GPSTimeStamp', 'detail': CASE WHEN t IS NOT NULL AND g IS NULL THEN 'Missing EXIF:GPSDateStamp' END}},
  {{'n': 4, 'severity': 'deletable', 'tag': 'XMP:DateCreated', 'detail': CASE WHEN abs(x_s - a_s) > 0 THEN {_versus('XMP:DateCreated', 'dt_naive', 'x_s', 'a_s', 0)} END}},
  {{'n': 5, 'severity': 'fixable', 'tag': 'XMP:DateCreated', 'detail': CASE WHEN x_s IS NOT NULL AND x_o <> off THEN CASE WHEN suffix(x, {_OFFSET_TEXT.format('x_o')}) THEN left(x, -6) ELSE x END || {_OFFSET_TEXT.format('off')} WHEN x_s IS NOT NULL AND x_o IS NULL AND utc IS NOT NULL THEN x || {_OFFSET_TEXT.format('off')} END}},
  {{'n': 6, 'severity': 'deletable', 'tag': 'XMP:DateCreated', 'detail': CASE WHEN abs(x_s - x_o - utc) > 0 THEN {_versus('XMP:DateCreated', 'utc', '(x_s - x_o)', 'utc', 0)} WHEN x_s IS NOT NULL AND x_o IS NULL AND utc IS NOT NULL AND off IS NULL THEN 'could not determine UTC datetime for comparison' END}},
  {{'n': 7, 'severity': 'deletable', 'tag': 'EXIF:GPSDateStamp', 'detail': CASE WHEN abs(g_s - utc) > 1799 THEN {_versus('EXIF:GPSDateStamp', 'utc', 'g_s', 'utc', 1799)} END}}] END, recursive := true) FROM instants),
findings AS (SELECT rec_id, f, severity, tag, min(n) AS n, string_agg(detail, '; ' ORDER BY n) AS detail FROM events WHERE detail IS NOT NULL GROUP BY rec_id, f, severity, tag)"""

ORACLES = {
    "zone_offsets": f"{_FOUND} SELECT tz, {_hhmm('m', 'm < 0')} AS utc_offset, count(*) AS events FROM (SELECT tz, CAST(floor({_offset('tz', 'ts')} / 60) AS BIGINT) AS m FROM found JOIN points USING (event_id)) GROUP BY ALL",
    "tz_from_point": f"{_FOUND} SELECT event_id, tz FROM found",
    "tz_exact_only": f"WITH {_POINTS}, {_EDGES}, {_INSIDE} SELECT points.event_id, tz_name AS tz FROM points LEFT JOIN inside USING (event_id) LEFT JOIN tz_zone USING (pos)",
    "local_offset": f"SELECT o_orderkey, {_offset('tz', 'wall')} AS offset_s FROM ({_WALL})",
    "local_time": f"SELECT event_id, strftime(timezone({_ZONES}[event_id % 8 + 1], timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local FROM events",
    "offset_format": f"SELECT o_orderkey, {_hhmm(_FLOOR, _FLOOR + ' < 0')} AS rounded_down, {_hhmm(_DROP, _SECONDS + ' < 0')} AS seconds_dropped FROM orders",
    "offset_parse": f"SELECT o_orderkey, CASE WHEN {_SECONDS} < 0 THEN -{_DROP} * 60 ELSE {_DROP} * 60 END AS offset_s FROM orders",
    "offset_normalize": f"SELECT rec_id, raw, {_normal('raw')} AS normal FROM (SELECT DISTINCT rec_id, exififd_offset_time_original AS raw FROM photo_record)",
    "exif_parse": f"SELECT rec_id, raw, {_parse('raw')} AS wall FROM (SELECT DISTINCT rec_id, exififd_date_time_original AS raw FROM photo_record)",
    "to_utc": f"SELECT o_orderkey, strftime(wall - to_seconds({_SECONDS}), '%Y-%m-%d %H:%M:%S') AS utc FROM ({_WALL})",
    "stringify_dt": """SELECT event_id, iso, replace(iso, '-', ':') AS exif, strftime(ts, '%Y-%m-%d') AS "day", strftime(ts, '%Y:%m:%d') AS exif_day,
        strftime(ts, '%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS clock
        FROM (SELECT event_id, ts, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS iso FROM events)""",
    "path_date": "SELECT rec_id, CASE WHEN regexp_matches(source_file, 'photos/(....)/(..)/(..)') THEN regexp_extract(source_file, 'photos/(....)/(..)/(..)', 1) || ':' || regexp_extract(source_file, 'photos/(....)/(..)/(..)', 2) || ':' || regexp_extract(source_file, 'photos/(....)/(..)/(..)', 3) || ' 00:00:00' END AS proposed FROM (SELECT DISTINCT rec_id, source_file FROM photo_record)",
    "zone_bounds": "SELECT CAST(pos AS BIGINT) AS pos, list_min(list_transform(flatten(rings), lambda p: p.lon)) AS min_lon, list_min(list_transform(flatten(rings), lambda p: p.lat)) AS min_lat, list_max(list_transform(flatten(rings), lambda p: p.lon)) AS max_lon, list_max(list_transform(flatten(rings), lambda p: p.lat)) AS max_lat FROM tz_zone",
    "ring_centroids": f"WITH {_RINGS} SELECT CAST(pos AS BIGINT) AS pos, CAST(ring_no AS BIGINT) AS ring_no, round(sum((e.a.lon + e.b.lon) * (e.a.lon * e.b.lat - e.b.lon * e.a.lat)) / (3 * sum(e.a.lon * e.b.lat - e.b.lon * e.a.lat)), 4) AS centroid_lon FROM (SELECT pos, ring_no, unnest(list_transform(range(1, len(ring)), lambda i: {{'a': ring[i], 'b': ring[i + 1]}})) AS e FROM rings1) GROUP BY ALL",
    "zone_edges": f"WITH {_RINGS} SELECT CAST(pos AS BIGINT) AS region, CAST(sum(len(ring) - 1) AS BIGINT) AS edges FROM rings1 GROUP BY pos",
    "lon_deltas": f"WITH {_POINTS} SELECT event_id, round(least(abs(lon + lat * 2), 360 - abs(lon + lat * 2)), 6) AS delta FROM points",
    "neighbour_points": f"""WITH {_POINTS}, sides AS (SELECT unnest([{{'k': 0, 'a': 1, 'b': 0}}, {{'k': 1, 'a': -1, 'b': 0}}, {{'k': 2, 'a': 0, 'b': 1}}, {{'k': 3, 'a': 0, 'b': -1}}, {{'k': 4, 'a': 1, 'b': 1}}, {{'k': 5, 'a': 1, 'b': -1}}, {{'k': 6, 'a': -1, 'b': 1}}, {{'k': 7, 'a': -1, 'b': -1}}], recursive := true))
        SELECT event_id, CAST(k AS BIGINT) AS k, round(lat + a * (200.0 / 111320.0::DOUBLE), 6) AS lat, round(lon + b * (200.0 / greatest(1e-6, 111320.0::DOUBLE * cos(radians(lat)))), 6) AS lon FROM points CROSS JOIN sides""",
    "offset_check": f"""WITH photo AS (SELECT DISTINCT rec_id, composite_gps_latitude AS a, composite_gps_longitude AS b, exififd_date_time_original AS t, exififd_offset_time_original AS o FROM photo_record),
 numbers AS (SELECT rec_id, {_NUMBER.format('a')} AS la, {_NUMBER.format('b')} AS lo, nullif(t, '') AS taken, TRY_CAST({_parse('t')} AS TIMESTAMP) AS wall, coalesce({_normal('o')}, {_normal('a')}, {_normal('b')}, {_normal('t')}) AS declared FROM photo),
 facts AS (SELECT rec_id, CASE WHEN lo IS NOT NULL THEN la END AS lat, CASE WHEN la IS NOT NULL THEN lo END AS lon, taken, wall, declared FROM numbers),
 sides AS (SELECT unnest([{{'k': 0, 'a': 0, 'b': 0}}, {{'k': 1, 'a': -1, 'b': 0}}, {{'k': 2, 'a': 0, 'b': 1}}, {{'k': 3, 'a': 0, 'b': -1}}, {{'k': 4, 'a': 1, 'b': 1}}, {{'k': 5, 'a': 1, 'b': -1}}, {{'k': 6, 'a': -1, 'b': 1}}, {{'k': 7, 'a': -1, 'b': -1}}, {{'k': 8, 'a': 1, 'b': 0}}], recursive := true)),
 points AS (SELECT rec_id * 10 + k AS event_id, wall AS ts, lat + a * (200.0 / 111320.0::DOUBLE) AS lat, lon + b * (200.0 / greatest(1e-6, 111320.0::DOUBLE * cos(radians(lat)))) AS lon FROM facts CROSS JOIN sides WHERE lat IS NOT NULL AND wall IS NOT NULL AND declared IS NOT NULL),
 {_EDGES}, {_INSIDE}, {_NEAREST}, found AS (SELECT event_id, tz_name AS tz FROM (SELECT * FROM inside UNION ALL SELECT * FROM nearest) JOIN tz_zone USING (pos)),
 minutes AS (SELECT event_id // 10 AS rec_id, event_id % 10 AS k, CAST(floor({_offset('tz', 'ts')} / 60) AS BIGINT) AS m FROM found JOIN points USING (event_id)),
 offsets AS (SELECT rec_id, k, {_hhmm('m', 'm < 0')} AS o FROM minutes)
 SELECT f.rec_id, e.o AS expected, declared, CASE WHEN lat IS NULL THEN 'NoGpsError' WHEN declared IS NULL THEN 'TzMismatchError' WHEN wall IS NULL AND taken IS NULL THEN 'NoCaptureDateTimeError'
 WHEN wall IS NULL AND regexp_matches(taken, '^[0-9]{{4}}(:[0-9]{{2}}){{2}} [0-9]{{2}}(:[0-9]{{2}}){{2}}$') THEN 'ValueError' WHEN wall IS NULL OR e.o IS NULL THEN 'TzMismatchError'
 WHEN e.o <> declared AND NOT EXISTS (SELECT 1 FROM offsets n WHERE n.rec_id = f.rec_id AND n.k > 0 AND n.o = f.declared) THEN 'TzMismatchError' END AS error_class
 FROM facts f LEFT JOIN offsets e ON e.rec_id = f.rec_id AND e.k = 0""",
    "datetime_check": f"WITH {_FINDINGS} SELECT rec_id, severity, tag, detail FROM findings",
    "any_failure": f"WITH {_FINDINGS} SELECT count(*) > 0 AS failed FROM findings",
    "failing_files": f"""WITH {_FINDINGS}, by_severity AS (SELECT rec_id, severity, min(n) AS n, '{{' || string_agg(CAST(to_json(tag) AS VARCHAR) || ':' || CAST(to_json(detail) AS VARCHAR), ',' ORDER BY n) || '}}' AS m FROM findings WHERE f LIKE '%.jpg' GROUP BY rec_id, severity)
 SELECT rec_id, '{{' || string_agg(CAST(to_json(severity) AS VARCHAR) || ':' || m, ',' ORDER BY n) || '}}' AS findings FROM by_severity GROUP BY rec_id""",
    "iso_parse": f"""WITH dates AS (SELECT DISTINCT rec_id, regexp_replace(exififd_date_time_original, '^([0-9]{{4}}):([0-9]{{2}}):([0-9]{{2}}) ', '\\1-\\2-\\3T') AS raw FROM photo_record),
 walls AS (SELECT rec_id, raw, {_parse('raw')} AS wall, regexp_extract(substr(raw, 9), '(Z|[+-][0-9]{{2}}(?::?[0-9]{{2}})?(?::?[0-9]{{2}})?)$', 1) AS z FROM dates),
 digits AS (SELECT *, regexp_replace(z, '[^0-9]', '', 'g') AS d FROM walls)
 SELECT rec_id, raw, wall, CASE WHEN wall IS NOT NULL AND z <> '' THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (coalesce(TRY_CAST(d[1:2] AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(d[3:4] AS BIGINT), 0) * 60 + coalesce(TRY_CAST(d[5:6] AS BIGINT), 0)) END AS offset_s FROM digits""",
    "assemble_datetime": f"""WITH {_FINDINGS} SELECT rec_id, '{_A}' AS tag, {_O_NAME} AS names, a_t AS text FROM joined WHERE a IS NOT NULL
 UNION ALL SELECT rec_id, 'XMP:DateCreated', 'XMP:DateCreated', x_t FROM joined WHERE x IS NOT NULL UNION ALL SELECT rec_id, 'EXIF:GPSDateStamp', {_T_NAME}, g_t FROM joined WHERE g IS NOT NULL""",
    "local_at_point": f"""{_FOUND}, walls AS (SELECT event_id, tz, ts, timezone(tz, timezone('UTC', ts)) AS local FROM found JOIN points USING (event_id))
 SELECT event_id, tz, CAST(epoch(local) - epoch(ts) AS BIGINT) AS offset_s, strftime(local, '%Y-%m-%d %H:%M:%S') AS local FROM walls""",
    "path_get": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS missing FROM events",
    "path_set": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":{"b":' || user_id || ',"c":1}}' ELSE '{"a":{"b":' || user_id || '},"k":' || (props ->> '$.k') || '}' END AS made,
 CASE WHEN event_id % 2 = 0 THEN '{"a":{"c":1},"k":"' || event_type || '"}' ELSE '{"k":"' || event_type || '"}' END AS replaced FROM events""",
    "path_pop": """SELECT event_id, '{"l":[{"id":' || event_id || '},{"id":1,"t":"' || event_type || '"}]' || CASE WHEN event_id % 3 = 0 THEN '}' ELSE ',"m":{"y":2}}' END AS pruned,
 '{"l":[{"t":"' || event_type || '"}],"m":{"x":' || user_id || CASE WHEN event_id % 3 = 0 THEN '}}' ELSE ',"y":2}}' END AS fanned, '[' || event_id || ',1]' AS taken FROM events""",
    "listify": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '[' || n_nationkey || ']' WHEN 1 THEN '[' || n_nationkey || ',' || n_regionkey || ']' ELSE '[null]' END AS items FROM nation",
    "map_values_keys": """SELECT event_id, '{"K": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS VARCHAR) || '}' AS props FROM events""",
    "keyword_split": r"SELECT rec_id, array_to_string(list_filter(list_transform(regexp_split_to_array(iptc_keywords, '[\s\p{Z}]*[,;][\s\p{Z}]*'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> ''), '|') AS keywords FROM (SELECT DISTINCT rec_id, iptc_keywords FROM photo_record WHERE iptc_keywords IS NOT NULL)",
    "position_split": f"""WITH t AS (SELECT rec_id, regexp_split_to_array(concat_ws('; ', composite_gps_latitude, composite_gps_longitude), '\\s*[,;]\\s*') AS p FROM {_PHOTO}),
        n AS (SELECT rec_id, CASE WHEN len(p) = 2 THEN {_NUMBER.format('p[1]')} END AS lat, CASE WHEN len(p) = 2 THEN {_NUMBER.format('p[2]')} END AS lon FROM t)
        SELECT rec_id, CASE WHEN lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon FROM n""",
    "x_join": f"SELECT rec_id, concat_ws('x', file_image_width, file_image_height) AS size FROM (SELECT DISTINCT rec_id, file_image_width, file_image_height FROM {_PHOTO})",
    "signed8": f"WITH {_POINTS} SELECT event_id, printf('%+.8f', CAST(printf('%.2f', lat) AS DOUBLE)) || ', ' || printf('%+.8f', CAST(printf('%.2f', lon) AS DOUBLE)) AS position FROM points",
    "flatten_singleton": "SELECT n_regionkey, CAST(min(n_nationkey) AS VARCHAR) AS first, CASE WHEN count(*) = 1 THEN CAST(min(n_nationkey) AS VARCHAR) ELSE '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' END AS all_keys FROM nation GROUP BY n_regionkey",
    "typed_cast": f"SELECT rec_id, {_NUMBER.format('exififd_exposure_compensation')} AS compensation, {_NUMBER.format('composite_gps_latitude')} AS lat, CAST(xmp_rating AS BIGINT) AS rating FROM {_PHOTO}",
    "delete_tags": f"WITH {_LONG} SELECT tag, count(*) AS records FROM long WHERE v IS NOT NULL AND tag NOT IN ('SourceFile', 'System:FileModifyDate', 'IPTC:Keywords') GROUP BY tag",
    "rename_group": f"WITH {_LONG} SELECT CASE WHEN tag LIKE 'ExifIFD:%' THEN replace(tag, 'ExifIFD:', 'EXIF:') WHEN tag LIKE 'System:%' THEN replace(tag, 'System:', 'File:') ELSE tag END AS tag, count(*) AS records FROM long WHERE v IS NOT NULL GROUP BY 1",
    "equality_groups": f"SELECT rec_id, CAST(1 AS BIGINT) AS unequal FROM {_PHOTO} WHERE iptc_keywords <> xmp_subject",
    "pipeline_all": f"""WITH {_LONG} SELECT tag, CASE WHEN tag IN ('IPTC:Keywords', 'XMP:Subject') THEN 'list' WHEN tag IN ('ExifIFD:ExposureCompensation', 'Composite:GPSLatitude') AND regexp_matches(trim(v), '{_FLOAT}') THEN 'number' WHEN tag IN ('XMP-xmp:Rating', 'File:ImageWidth') THEN 'number' ELSE 'text' END AS kind, count(*) AS records
        FROM long WHERE v IS NOT NULL AND tag NOT IN ('SourceFile', 'System:FileModifyDate') GROUP BY ALL""",
    "missing_ids": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') ORDER BY 1",
    "distinct_ids": "SELECT DISTINCT geo_id FROM tz_zone WHERE geo_id <> '' ORDER BY 1",
    "needs_rebuild": """SELECT d.station_id, bool_or(d.station_id % 5 = 0 OR d.received_at > i.mtime) AS stale FROM dump_file d
 JOIN (SELECT station_id, arg_min(received_at, (line_count, dump_id)) AS mtime FROM dump_file GROUP BY station_id) i USING (station_id) GROUP BY d.station_id""",
    "id_lookup": "SELECT geo_id, tz_name, min_lon, max_lat FROM (SELECT geo_id, tz_name, list_min(list_transform(flatten(rings), lambda p: p.lon)) AS min_lon, list_max(list_transform(flatten(rings), lambda p: p.lat)) AS max_lat FROM tz_zone)",
    "merge_maps": """SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_custkey % 2 = 0 THEN 'of ' || o_custkey ELSE o_orderpriority END AS priority, CASE WHEN o_custkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS customer,
 CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS entries FROM orders""",
    "positional_zip": f"WITH {_RINGS} SELECT CAST(pos AS BIGINT) AS pos, CAST(ring_no AS BIGINT) AS ring_no, CAST(k AS BIGINT) AS k, p.lon AS lon, p.lat AS lat FROM (SELECT pos, ring_no, unnest(ring) AS p, generate_subscripts(ring, 1) - 1 AS k FROM rings1) WHERE k < 5",
    "severity_messages": "SELECT l_orderkey, l_linestatus, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey) AS messages FROM lineitem GROUP BY ALL",
}
