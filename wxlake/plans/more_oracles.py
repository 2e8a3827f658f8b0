"""SQL for more_queries, straight from the facts of `events` and the fixed code tables."""

from __future__ import annotations

from ..functions import codes
from .oracles import FACTS, FAMILY, HEADING, RECORDS, when
from .oracles import ORACLES as FIRST

STAMP = "'%y%m%dT%H%MZ'"
AWIPS = "CASE WHEN event_id % 13 <> 0 THEN nnn || office[2:4] END"
SEQUENCE = "CASE WHEN event_id % 2 = 0 THEN (event_id % 1000)::INTEGER END"
SEGMENTS = "((bad NOT IN (2, 3))::INTEGER + (event_id % 7 = 0)::INTEGER)"
SNAKE = f"replace({FAMILY}, '-', '_')"
PURGE = "strftime(valid_end, '%d%H%M')"
NR = "lpad(nr::VARCHAR, 3, '0')"
FIRST_UGC = f"""state || CASE WHEN etn % 5 = 0 THEN 'Z' || {NR} || '>' || lpad((nr + many + 1)::VARCHAR, 3, '0') || '-' ELSE 'C' || array_to_string(list_transform(range(0, many), lambda i: lpad((nr + 2 * i)::VARCHAR, 3, '0') || '-'), '') END || {PURGE} || '-'"""
FIRST_CODE = f"""'/O.' || action || '.' || office || '.' || phenomenon || '.W.' || lpad(etn::VARCHAR, 4, '0') || '.' || CASE WHEN step = 0 THEN strftime(issue, {STAMP}) ELSE '000000T0000Z' END || '-' || strftime(valid_end, {STAMP}) || '/'"""
SECOND = "state || 'C' || lpad((nr + 50)::VARCHAR, 3, '0')"
SECOND_CODE = f"""'/O.NEW.' || office || '.WI.Y.' || lpad(etn::VARCHAR, 4, '0') || '.' || strftime(issue, {STAMP}) || '-' || strftime(valid_end, {STAMP}) || '/'"""
SECOND_AT = "CASE WHEN bad IN (2, 3) THEN 1 ELSE 2 END"
ACTION = "CASE action WHEN 'NEW' THEN 'new' WHEN 'CON' THEN 'continue' WHEN 'EXT' THEN 'extend_time' WHEN 'CAN' THEN 'cancel' ELSE 'expire' END"
STREAMS = "streams AS (SELECT event_id // 20 AS stream, count(*) AS n, count(*) FILTER (bad = 4) AS broken FROM facts GROUP BY 1)"


def _families() -> str:
    rows = [(c, f) for f, own in codes.PRODUCT_FAMILIES.items() for c in own.split()] + [(f"{p}Q", f) for p, f in codes.PREFIX_FAMILIES.items()] + [("QQQ", "unknown")]
    rows += [(None, f) for f in codes.TITLE_FAMILIES.values()] + [(None, "unknown")]
    listed = ", ".join(f"({i}, {'NULL' if c is None else repr(c)}, '{f}')" for i, (c, f) in enumerate(rows))
    return f"SELECT 'p/' || lpad(event_id::VARCHAR, 9, '0') AS path, nnn::VARCHAR AS nnn, family, replace(family, '-', '_') AS snake FROM events JOIN (VALUES {listed}) v(kind, nnn, family) ON event_id % {len(rows)} = kind"


def _archived(columns: str, rest: str) -> str:
    return f"WITH {FACTS} SELECT {columns} FROM facts WHERE bad <> 4 {rest}"


#: What is known of each shape: area, corners, crossing, convex, near, far and border point, and the shared area.
RINGS = {"square": "160, 4, false, true, true, true, true, 40", "bend": "120, 6, false, false, true, false, true, NULL", "crossed": "NULL, 4, true, false, NULL, NULL, NULL, NULL", "triangle": "80, 3, false, true, true, false, true, 0", "line": "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"}
_SHAPES = ", ".join(f"({i}, '{name}', {known})" for i, (name, known) in enumerate(RINGS.items()))

ORACLES: dict[str, str] = {
    "message_summaries": f"""WITH {FACTS} SELECT path, 'bare' AS frame_kind, {SEQUENCE} AS sequence_number, {HEADING} AS heading, 'WUUS53' AS ttaaii, office AS cccc, office, strftime(issue, '%d%H%M') AS yygggg,
  CASE WHEN event_id % 5 = 0 THEN 'AAA' END AS bbb, {AWIPS} AS awips_id, {FAMILY} AS family, {SEGMENTS} AS segment_count, {SEGMENTS} AS segments, 64 AS fingerprint_digits, 16 AS digest_digits, true AS bare FROM facts WHERE bad <> 4""",
    "segment_summaries": f"""WITH {FACTS}
SELECT path, 1 AS segment_index, {FIRST_UGC} AS ugc_raw, ugcs, CASE WHEN bad = -1 THEN {FIRST_CODE} ELSE '' END AS pvtec, (bad = -1 AND phenomenon = 'FL')::INTEGER AS hvtec, CASE WHEN bad = -1 THEN {ACTION} ELSE '' END AS actions, 4 AS corners, 1 AS locations
FROM coded WHERE bad NOT IN (2, 3, 4)
UNION ALL SELECT path, {SECOND_AT}, {SECOND} || '-' || {PURGE} || '-', {SECOND}, {SECOND_CODE}, 0, 'new', NULL, NULL FROM coded WHERE bad <> 4 AND event_id % 7 = 0""",
    "replay_records": f"WITH {FACTS} SELECT path, 1 AS message_index, {SEQUENCE} AS sequence_number, 'WUUS53' AS ttaaii, office AS cccc, {AWIPS} AS awips_id, {FAMILY} AS family, {SEGMENTS} AS segment_count FROM facts WHERE bad <> 4",
    "action_tags": f"""WITH {FACTS} SELECT path, 1 AS segment_index, action, {ACTION} AS normalized_action, 1 AS vtec_index FROM facts WHERE bad = -1
UNION ALL SELECT path, {SECOND_AT}, 'NEW', 'new', 1 FROM facts WHERE bad <> 4 AND event_id % 7 = 0""",
    "hydrologic_pairs": f"""WITH {FACTS} SELECT path, 1 AS segment_index, phenomenon, office[2:4] || 'I2' AS nwsli, {when("issue")} AS "begin", CASE WHEN step = 0 THEN strftime(issue, {STAMP}) ELSE '000000T0000Z' END || '-' || strftime(valid_end, {STAMP}) AS times
FROM facts WHERE bad = -1 AND phenomenon = 'FL'""",
    "line_shapes": f"""WITH {FACTS} SELECT path, 1::BIGINT AS headings, (event_id % 13 <> 0)::BIGINT AS identifiers, (bad NOT IN (0, 1))::BIGINT + (event_id % 7 = 0)::BIGINT AS event_codes, (phenomenon = 'FL')::BIGINT AS hydrologic_codes FROM facts""",
    "product_families": _families(),
    "wrapped_messages": f"""WITH {FACTS}, rows AS (SELECT *, event_id % 23 = 0 AS lost FROM facts)
SELECT replace(path, '.txt', '.xml') AS path, 'xml_stanza' AS input_kind, 'open_interface' AS transport, CASE WHEN NOT lost THEN '7.' || event_id END AS wrapper_id, CASE WHEN NOT lost THEN {when("issue + INTERVAL 90 SECOND")} END AS wrapper_issue,
  '<' || event_id || '> & ''more''' AS summary, CASE WHEN NOT lost THEN '7' END AS process_id, CASE WHEN NOT lost THEN event_id::VARCHAR END AS sequence, CASE WHEN NOT lost THEN {AWIPS} END AS awips_id,
  CASE WHEN lost THEN 'Input' WHEN bad = 4 THEN 'InvalidField' WHEN event_id % 19 = 0 THEN 'Mismatch' END AS error_kind, CASE WHEN lost THEN 'MissingField: nwws-oi payload' WHEN bad = 4 THEN 'LAT...LON' WHEN event_id % 19 = 0 THEN 'cccc' END AS error_field FROM rows""",
    "wrapped_timeline": f"WITH {FACTS} SELECT event_id_ AS event_id, replace(path, '.txt', '.xml') AS path, '7.' || event_id AS wrapper_id, {when('issue + INTERVAL 90 SECOND')} AS issued_at FROM coded WHERE bad = -1 AND event_id % 23 <> 0",
    "scan_totals": f"""WITH {FACTS}, {STREAMS}, a AS (SELECT count(*) AS n, count(*) FILTER (bad = 4) AS broken FROM facts), s AS (SELECT count(*) AS n, count(*) FILTER (broken > 0) AS broken, coalesce(sum(n) FILTER (broken = 0), 0) AS messages FROM streams)
SELECT a.n + s.n AS scanned_files, a.n - a.broken + s.n - s.broken AS parsed_files, (a.n - a.broken + s.messages)::BIGINT AS messages, a.broken + s.broken AS failures FROM a, s""",
    "scan_errors": f"""WITH {FACTS}, {STREAMS} SELECT path, 'InvalidField: LAT...LON' AS error FROM facts WHERE bad = 4 UNION ALL SELECT 'streams/' || lpad(stream::VARCHAR, 9, '0') || '.sbn', 'InvalidField: LAT...LON' FROM streams WHERE broken > 0""",
    "error_histogram": f"""WITH {FACTS}, {STREAMS} SELECT 'InvalidField' AS error_kind, 'LAT...LON' AS error_field, 2 * count(*) AS messages FROM facts WHERE bad = 4 HAVING count(*) > 0
UNION ALL SELECT 'Rejected', 'another frame of the file', sum(n - broken)::BIGINT FROM streams WHERE broken > 0 HAVING count(*) > 0""",
    "counters_json": f"""WITH {FACTS}, n AS (SELECT {FAMILY} AS family, count(*) AS n FROM facts WHERE bad <> 4 GROUP BY 1) SELECT '{{' || string_agg('"' || family || '":' || n, ',' ORDER BY family) || '}}' AS value FROM n""",
    "split_names": f"""WITH {FACTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id)::INTEGER AS i FROM facts)
SELECT 'streams/' || lpad((event_id // 20)::VARCHAR, 9, '0') || '.sbn' AS path, i AS message_index, lpad(i::VARCHAR, 5, '0') || '_' || coalesce({SEQUENCE}, 0) || '_WUUS53_' || coalesce({AWIPS}, 'NO-AWIPS') || '.txt' AS name FROM placed WHERE bad <> 4""",
    "import_counts": f"""WITH {FACTS}, good AS (SELECT *, {FAMILY} AS own FROM facts WHERE bad <> 4)
SELECT 'scanned_inputs' AS name, NULL::VARCHAR AS value, 2 * count(*) AS n FROM facts UNION ALL SELECT 'parsed_inputs', NULL, 2 * count(*) FROM good UNION ALL SELECT 'failures', NULL, 2 * count(*) FROM facts WHERE bad = 4
UNION ALL SELECT 'archived_records', NULL, count(*) FROM good UNION ALL SELECT 'duplicate_records', NULL, count(*) FROM good UNION ALL SELECT 'transports', 'plain_text', 2 * count(*) FROM good UNION ALL SELECT 'families', own, 2 * count(*) FROM good GROUP BY own""",
    "manifest": _archived(f"path AS source_path, 'bulletin' AS input_kind, 'plain_text' AS transport, ({SEQUENCE})::VARCHAR AS sequence, 'WUUS53' AS ttaaii, office AS cccc, coalesce({AWIPS}, '') AS awips_id, {FAMILY} AS family, {SEGMENTS} AS segments, 'records/' || office || '/WUUS53/' || coalesce({AWIPS}, 'NO-AWIPS') AS folder", ""),
    "archived_import": _archived("path, CASE WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'archived' END AS action", ""),
    "verified": _archived(f"path, CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, {FAMILY} AS family", ""),
    "verify_counts": f"""WITH {FACTS}, good AS (SELECT *, {FAMILY} AS own FROM facts WHERE bad <> 4) SELECT 'verified_records' AS name, NULL::VARCHAR AS value, count(*) FILTER (event_id % 17 <> 0) AS n FROM good
UNION ALL SELECT 'failures', NULL, count(*) FILTER (event_id % 17 = 0) FROM good UNION ALL SELECT 'families', own, count(*) FROM good WHERE event_id % 17 <> 0 GROUP BY own""",
    "first_fingerprints": _archived(f"path, {HEADING} AS heading, 'bare' AS frame_kind", ""),
    "timeline_first": f"WITH {RECORDS} SELECT record_key, {when('issued')} AS issued_at FROM records ORDER BY issued NULLS FIRST, path LIMIT 100",
    "overlapping_pairs": f"""WITH {RECORDS},
spans AS (SELECT *, coalesce(valid_start, issued) AS s, CASE WHEN action = 'CAN' THEN least(valid_end, issued) ELSE valid_end END AS z FROM records), timed AS (SELECT * FROM spans WHERE z > s)
SELECT a.record_key AS left_record_key, b.record_key AS right_record_key, (epoch(least(a.z, b.z)) - epoch(greatest(a.s, b.s)))::BIGINT AS time_overlap_seconds,
  ((least(a.lat + a.size, b.lat + b.size) - greatest(a.lat, b.lat)) * (least(a.lon + a.size, b.lon + b.size) - greatest(a.lon, b.lon)))::BIGINT AS shared
FROM timed a JOIN timed b ON a.s < b.z AND b.s < a.z AND a.record_key < b.record_key AND a.event_id_ <> b.event_id_ AND a.lat <= b.lat + b.size AND b.lat <= a.lat + a.size AND a.lon <= b.lon + b.size AND b.lon <= a.lon + a.size""",
    "ring_facts": f"""SELECT event_id, shape, area::BIGINT AS area, corners::INTEGER AS corners, crosses::BOOLEAN AS crosses, convex::BOOLEAN AS convex, near::BOOLEAN AS holds_near, far::BOOLEAN AS holds_far, border::BOOLEAN AS holds_border, shared::BIGINT AS shared
FROM events JOIN (VALUES {_SHAPES}) v(i, shape, area, corners, crosses, convex, near, far, border, shared) ON event_id % 5 = i""",
    "recent_products": _archived(f"{when('issue')} AS captured_at, 64 AS digits", f"AND {FAMILY} = 'severe-thunderstorm' ORDER BY issue DESC LIMIT 50"),
    "office_products": _archived(f"path AS source_path, {AWIPS} AS awips_id, {FAMILY} AS family_name", "AND office = 'KAAB' AND event_id % 13 <> 0 AND nnn = 'SVR'"),
    "day_products": _archived(f"strftime(issue, '%Y-%m-%d') AS capture_date, {SNAKE} AS family, count(*) AS products", "AND issue::DATE BETWEEN '2024-01-18' AND '2024-01-22' GROUP BY 1, 2"),
    "prune_plan": _archived("strftime(issue, '%Y-%m-%d') AS capture_date, count(*) AS records, strftime(issue, '%Y-%m-%d') < '2024-01-15' AS removed", "GROUP BY 1, 3"),
    "pruned_archive": _archived("strftime(issue, '%Y-%m-%d') AS capture_date, count(*) AS records", "AND issue >= '2024-01-15' GROUP BY 1"),
    "sql_functions": f"""WITH {FACTS} SELECT path, ugcs, office, phenomenon, action, etn, {when("valid_end")} AS valid_end FROM coded WHERE bad = -1
UNION ALL SELECT path, {SECOND}, office, 'WI', 'NEW', etn, {when("valid_end")} FROM coded WHERE bad <> 4 AND event_id % 7 = 0""",
    "lateral_segments": f"""WITH {FACTS} SELECT path, 1 AS segment_index, ugcs, CASE WHEN bad = -1 THEN phenomenon END AS phenomenon, CASE WHEN bad = -1 THEN etn END AS etn, CASE WHEN bad = -1 THEN 'WARNING ' || event_id || ' IN EFFECT' END AS headline,
  4 AS corners, lat::BIGINT AS lat, -lon::BIGINT AS lon FROM coded WHERE bad NOT IN (2, 3, 4)
UNION ALL SELECT path, {SECOND_AT}, {SECOND}, 'WI', etn, 'WIND ADVISORY', NULL, NULL, NULL FROM coded WHERE bad <> 4 AND event_id % 7 = 0""",
    "text_digests": """WITH lines AS (SELECT event_id, 'event ' || event_id || ' of ' || user_id || ' ' || event_type AS line FROM events)
SELECT event_id, lpad(lower(to_hex(list_reduce(list_transform(range(1, length(line) + 1), lambda i: ord(line[i])::HUGEINT), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616, 14695981039346656037::HUGEINT)::UBIGINT)), 16, '0') AS digest,
  CASE WHEN event_id % 3 = 0 THEN 'cbf29ce484222325' END AS digest_of_nothing FROM lines""",
    "sniffed_kinds": """SELECT 'm/' || event_id AS path, 'auto' AS hint, kind AS input_kind, CASE kind WHEN 'xml_stanza' THEN 'open_interface' WHEN 'framed_stream' THEN 'pid201' ELSE 'plain_text' END AS transport
FROM events JOIN (VALUES (0, 'bulletin'), (1, 'xml_stanza'), (2, 'xml_stanza'), (3, 'xml_stanza'), (4, 'bulletin'), (5, 'framed_stream'), (6, 'framed_stream'), (7, 'bulletin'), (8, 'framed_stream'), (9, 'bulletin')) v(i, kind) ON event_id % 10 = i""",
    "measurements": """SELECT event_id::VARCHAR AS path, floor(((event_id % 4000 / 1000)::FLOAT * 100::FLOAT)::DOUBLE + 0.5)::BIGINT AS hail, (CASE WHEN event_id % 5 = 0 THEN event_id % 90 ELSE event_id % 65536 END)::INTEGER AS wind_mph FROM events""",
    "compacted_archive": _archived(f"strftime(issue, '%Y-%m-%d') AS capture_date, {SNAKE} AS family, count(*) AS records, count(*) AS paths", "GROUP BY 1, 2"),
    "stream_frames": """SELECT 'streams/' || lpad((event_id // 20)::VARCHAR, 9, '0') || '.sbn' AS stream, count(*) AS frames, 3 + count(*) FILTER (event_id % 20 % 5 = 0) AS junk_bytes, 8 AS pending_bytes, 0::BIGINT AS errors FROM events GROUP BY event_id // 20""",
    "stream_archive": _archived(f"strftime(issue, '%Y-%m-%d') AS capture_date, {SNAKE} AS family, count(*) AS records", "GROUP BY 1, 2"),
    "stream_routes": FIRST["routes"],
    "stream_fragments": """SELECT 'xmpp/' || lpad((event_id // 50)::VARCHAR, 9, '0') AS stream, 1 + count(*) + count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 11 = 0) AS fragments,
  1 + count(*) + count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 11 = 0) AS last, 0::BIGINT AS errors, count(*) FILTER (event_id % 23 <> 0) AS messages, count(*) FILTER (event_id % 23 <> 0) AS wrapper_ids FROM events GROUP BY event_id // 50""",
    "stream_status": f"""WITH {FACTS}, n AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS k FROM facts)
SELECT 'feed' AS feed, 3::BIGINT AS batches, sum(k)::BIGINT AS received, sum(k) FILTER (bad <> 4)::BIGINT AS parsed, coalesce(sum(k) FILTER (bad = 4), 0)::BIGINT AS rejected, count(*) FILTER (bad <> 4) AS archived,
  (sum(k) FILTER (bad <> 4) - count(*) FILTER (bad <> 4))::BIGINT AS duplicates FROM n""",
    "repeated_import": f"""WITH {FACTS}, good AS (SELECT path FROM facts WHERE bad <> 4)
SELECT path, 'archived' AS action, 1::BIGINT AS rows FROM good UNION ALL SELECT path, 'duplicate', 1 FROM good UNION ALL SELECT 'zz/' || path, 'duplicate', 1 FROM good""",
    "colliding_digests": f"""WITH {FACTS}, good AS (SELECT *, 'records/' || office || '/WUUS53/' || coalesce({AWIPS}, 'NO-AWIPS') AS folder FROM facts WHERE bad <> 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY event_id % 2 DESC, path) - 1 AS k FROM good)
SELECT path, 'archived' AS action, folder || '/00' || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.txt' AS relative_path FROM placed""",
    "stored_streams": """SELECT event_id // 50000 AS stream, count(*)::INTEGER AS frames, (min(event_id) % 5 = 0)::BIGINT AS junk_bytes, 0::BIGINT AS pending_bytes, true AS follow, true AS in_order, true AS whole FROM events GROUP BY event_id // 50000""",
    "stream_recognised": _archived(f"path, {FAMILY} AS family", ""),
}
