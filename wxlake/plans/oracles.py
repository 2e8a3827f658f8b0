"""SQL for the queries, straight from the facts of `events`: it sees neither the rendered texts nor the parser."""

from __future__ import annotations

AT = "TIMESTAMP '2024-01-20 12:00:00'"

FACTS = r"""
e AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS n FROM events),
f AS (SELECT *, (n // 4 + 1)::INTEGER AS etn, n % 4 AS step, date_trunc('minute', ts) AS issue FROM e),
facts AS (SELECT *,
  'K' || chr((65 + (user_id // 676) % 26)::INTEGER) || chr((65 + (user_id // 26) % 26)::INTEGER) || chr((65 + user_id % 26)::INTEGER) AS office,
  CASE event_type WHEN 'error' THEN 'TO' WHEN 'click' THEN 'SV' WHEN 'purchase' THEN 'FF' WHEN 'view' THEN 'FL' ELSE 'MA' END AS phenomenon,
  CASE event_type WHEN 'error' THEN 'TOR' WHEN 'click' THEN 'SVR' WHEN 'purchase' THEN 'FFW' WHEN 'view' THEN 'FLS' ELSE 'MWW' END AS nnn,
  CASE event_type WHEN 'error' THEN 'tornado' WHEN 'click' THEN 'severe-thunderstorm' WHEN 'purchase' THEN 'flash-flood' WHEN 'view' THEN 'flood' ELSE 'marine' END AS family,
  CASE step WHEN 0 THEN 'NEW' WHEN 1 THEN 'CON' WHEN 2 THEN 'EXT' ELSE CASE WHEN etn % 2 = 0 THEN 'CAN' ELSE 'EXP' END END AS action,
  issue + to_minutes(30 + event_id % 90) AS valid_end, CASE WHEN step = 0 THEN issue END AS valid_start,
  CASE user_id % 4 WHEN 0 THEN 'IL' WHEN 1 THEN 'TX' WHEN 2 THEN 'KS' ELSE 'OK' END AS state,
  (user_id * 7 + etn * 3) % 400 + 1 AS nr, CASE WHEN etn % 4 = 0 AND step = 3 THEN 1 ELSE etn % 4 + 1 END AS many,
  3000 + user_id % 150 * 10 AS lat, 8000 + user_id % 200 * 10 AS lon, 5 + event_id % 40 AS size,
  CASE WHEN event_id % 11 = 0 THEN event_id // 11 % 5 ELSE -1 END AS bad, 'src/' || lpad(event_id::VARCHAR, 9, '0') || '.txt' AS path FROM f),
coded AS (SELECT *, office || '.O.' || phenomenon || '.W.' || lpad(etn::VARCHAR, 4, '0') AS event_id_,
  CASE WHEN etn % 5 = 0 THEN array_to_string(list_transform(range(0, many + 2), lambda i: state || 'Z' || lpad((nr + i)::VARCHAR, 3, '0')), ',')
       ELSE array_to_string(list_transform(range(0, many), lambda i: state || 'C' || lpad((nr + 2 * i)::VARCHAR, 3, '0')), ',') END AS ugcs FROM facts)"""


def when(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"


def near(anchor: str) -> str:
    """The heading's day and time in the month before, of or after the anchor, whichever is nearest, the past first."""
    month = lambda k: f"(date_trunc('month', {anchor}) + INTERVAL ({k}) MONTH)"
    time = lambda k: f"CASE WHEN day(issue) <= day(last_day({month(k)})) THEN ({month(k)} + to_days((day(issue) - 1)::INTEGER) + (issue - date_trunc('day', issue))) END"
    listed = ", ".join(f"{{'d': abs(epoch({time(k)}) - epoch({anchor})), 'later': {time(k)} > {anchor}, 't': {time(k)}}}" for k in (-1, 0, 1))
    return f"list_min(list_filter([{listed}], lambda x: x.t IS NOT NULL)).t"


RECORDS = f"""{FACTS},
records AS (SELECT *, {near(AT)} AS issued, event_id_ || '|source=' || path || '|message=1|segment=1|vtec=1' AS record_key FROM coded WHERE bad = -1)"""
UNDATED = f"""{FACTS},
records AS (SELECT *, coalesce({near("valid_start")}, {near("valid_end")}) AS issued, event_id_ || '|source=' || path || '|message=1|segment=1|vtec=1' AS record_key FROM coded WHERE bad = -1)"""
ACTIVE = f"""{RECORDS},
keyed AS (SELECT *, 'office=' || office || '|vtec=O.' || phenomenon || '.W.' || lpad(etn::VARCHAR, 4, '0') || '|ugc=' || ugcs || '|family=' || family AS key FROM records
  WHERE NOT issued > {AT} AND (step = 3 OR ((valid_start IS NULL OR valid_start <= {AT}) AND valid_end > {AT}))),
best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY issued DESC, path DESC) = 1),
active AS (SELECT * FROM best WHERE step <> 3)"""
#: Products with an identifier take their family from it, the others from their first good code, if there is one.
FAMILY = "CASE WHEN event_id % 13 <> 0 OR bad = -1 THEN family ELSE 'unknown' END"
DAMAGE = "NULL::VARCHAR"
TORNADO = "CASE WHEN phenomenon = 'TO' THEN CASE WHEN event_id % 2 = 0 THEN 'OBSERVED' ELSE 'RADAR INDICATED' END END"
HEADING = "'WUUS53 ' || office || ' ' || strftime(issue, '%d%H%M') || CASE WHEN event_id % 5 = 0 THEN ' AAA' ELSE '' END"

ORACLES: dict[str, str] = {
    "active_at": f"""WITH {ACTIVE}
SELECT key, path, action, office, etn, family AS event_family, {FAMILY} AS product_family, {when("issued")} AS issued_at, {when("valid_start")} AS start_time, {when("valid_end")} AS end_time,
  'WARNING ' || event_id || ' IN EFFECT' AS headline, ugcs, {TORNADO} AS tornado_tag, {DAMAGE} AS damage_threat FROM active""",
    "active_families": f"""WITH {ACTIVE},
good AS (SELECT *, {near(AT)} > {AT} AS later FROM facts)
SELECT 'scanned' AS name, NULL::VARCHAR AS family, count(*) AS n FROM good UNION ALL
SELECT 'messages', NULL, count(*) FROM good WHERE bad <> 4 UNION ALL
SELECT 'future_messages', NULL, count(*) FROM good WHERE bad <> 4 AND later UNION ALL
SELECT 'failures', NULL, count(*) FROM good WHERE bad = 4 UNION ALL
SELECT 'warning_vtec_segments', NULL, count(*) FROM records WHERE NOT issued > {AT} UNION ALL
SELECT 'families', family, count(*) FROM active GROUP BY family""",
    "timeline_status": f"""WITH {RECORDS},
ranked AS (SELECT *, issued > {AT} AS later, row_number() OVER (PARTITION BY event_id_, issued > {AT} ORDER BY issued DESC, path DESC) AS r FROM records)
SELECT record_key, event_id_ AS event_id, CASE WHEN later THEN 'future' WHEN r > 1 THEN 'superseded' WHEN action = 'CAN' THEN 'canceled' WHEN action = 'EXP' THEN 'expired'
  WHEN valid_start > {AT} THEN 'pending' WHEN valid_end <= {AT} THEN 'expired' ELSE 'active' END AS lifecycle_status,
  {when("issued")} AS issued_at, CASE WHEN action = 'CAN' THEN {when("issued")} END AS canceled_at, CASE WHEN action IN ('CON', 'EXT') THEN {when("issued")} END AS updated_at,
  {when("valid_end")} AS expires_at, family AS event_family, strftime(valid_end, '%d%H%M') AS ugc_purge_time FROM ranked""",
    "timeline_without_time": f"WITH {UNDATED} SELECT record_key, NULL::VARCHAR AS lifecycle_status, {when('issued')} AS issued_at FROM records",
    "lead_time": f"""WITH {RECORDS},
points AS (SELECT user_id AS event, date_trunc('second', max(ts)) - INTERVAL 1 HOUR AS t, (any_value(lat) * 10 + 35) AS y, (any_value(lon) * 10 + 35) AS x FROM facts GROUP BY user_id),
spans AS (SELECT *, coalesce(valid_start, issued) AS s, valid_end AS z FROM records WHERE step <> 3),
hits AS (SELECT event, t, record_key, s, z, issued FROM points JOIN spans ON z > s AND y BETWEEN lat * 10 AND (lat + size) * 10 AND x BETWEEN lon * 10 AND (lon + size) * 10),
counted AS (SELECT event, count(*) AS n, count(*) FILTER (s <= t AND t < z AND issued <= t) AS m, bool_or(s <= t AND t < z AND issued > t) AS late,
  min({{'i': issued, 'k': record_key, 's': s, 'z': z}}) FILTER (s <= t AND t < z AND issued <= t) AS f FROM hits GROUP BY event),
flagged AS (SELECT event, t, s, z, CASE WHEN s <= max(z) OVER (PARTITION BY event ORDER BY s, z, record_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, record_key FROM hits),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY event ORDER BY s, z, record_key) AS island FROM flagged),
merged AS (SELECT event, t, island, min(s) AS s, max(z) AS z FROM islands GROUP BY event, t, island),
summed AS (SELECT event, count(*) AS c, sum(epoch(z) - epoch(s))::BIGINT AS d, count(*) FILTER (NOT (s <= t AND t < z)) AS fc, coalesce(sum(epoch(z) - epoch(s)) FILTER (NOT (s <= t AND t < z)), 0)::BIGINT AS fd FROM merged GROUP BY event),
missing AS (SELECT bool_or(NOT coalesce(z > s, false)) AS b FROM spans)
SELECT event, (SELECT count(*) FROM records) AS warning_records, coalesce(n, 0) AS point_warning_records, coalesce(m, 0) AS event_warning_records, coalesce(c, 0) AS point_warning_interval_count, coalesce(d, 0) AS point_warning_duration_seconds,
  f.k AS first_valid_warning_record_key, {when("f.i")} AS first_valid_warning_lead_start, {when("f.s")} AS first_valid_warning_interval_start, {when("f.z")} AS first_valid_warning_interval_end,
  (epoch(t) - epoch(f.i))::BIGINT AS lead_time_seconds, f IS NULL AS missed_event, coalesce(fc, 0) AS false_alarm_interval_count, coalesce(fd, 0) AS false_alarm_duration_seconds,
  array_to_string(list_filter([CASE WHEN (SELECT b FROM missing) THEN 'missing-warning-interval' END, CASE WHEN coalesce(c, 0) = 0 THEN 'no-point-warning-intervals' END, CASE WHEN c > 0 AND f IS NULL THEN 'event-outside-point-warning-intervals' END,
    CASE WHEN late THEN 'warning-issued-after-event' END, CASE WHEN f IS NULL THEN 'missed-event' END, CASE WHEN fc > 0 THEN 'false-alarm-intervals-present' END], lambda x: x IS NOT NULL), ',') AS quality_flags
FROM points LEFT JOIN counted USING (event) LEFT JOIN summed USING (event)""",
    "pair_metrics": f"""WITH {UNDATED},
spans AS (SELECT *, coalesce(valid_start, issued) AS s, CASE WHEN action = 'CAN' THEN least(valid_end, issued) ELSE valid_end END AS z FROM records),
timed AS (SELECT record_key, event_id_, issued, path, size, CASE WHEN z > s THEN s END AS s, CASE WHEN z > s THEN z END AS z FROM spans),
pairs AS (SELECT *, lag(record_key) OVER w AS k, lag(s) OVER w AS s0, lag(z) OVER w AS z0, lag(size) OVER w AS size0 FROM timed WINDOW w AS (PARTITION BY event_id_ ORDER BY issued NULLS FIRST, path)),
told AS (SELECT *, (epoch(z0) - epoch(s0))::BIGINT AS d0, (epoch(z) - epoch(s))::BIGINT AS d1, CASE WHEN s IS NOT NULL AND s0 IS NOT NULL THEN greatest(0, epoch(least(z, z0)) - epoch(greatest(s, s0)))::BIGINT END AS o FROM pairs WHERE k IS NOT NULL)
SELECT k AS left_record_key, record_key AS right_record_key, d0 AS left_duration_seconds, d1 AS right_duration_seconds, o AS time_overlap_seconds, d0 + d1 - o AS time_union_seconds, round(o / (d0 + d1 - o), 6) AS time_overlap_ratio,
  size0 * size0 AS left_area, size * size AS right_area, least(size, size0) * least(size, size0) AS polygon_overlap_area, greatest(size, size0) * greatest(size, size0) AS polygon_union_area FROM told""",
    "headings": f"""WITH {FACTS}
SELECT path, CASE WHEN event_id % 2 = 0 THEN (event_id % 1000)::INTEGER END AS sequence_number, {HEADING} AS heading, 'WUUS53' AS ttaaii, office AS cccc, strftime(issue, '%d%H%M') AS yygggg, CASE WHEN event_id % 5 = 0 THEN 'AAA' END AS bbb,
  CASE WHEN event_id % 13 <> 0 THEN nnn || office[2:4] END AS awips_id, CASE WHEN event_id % 13 <> 0 THEN nnn END AS nnn, CASE WHEN event_id % 13 <> 0 THEN office[2:4] END AS xxx, {FAMILY} AS family,
  ((bad NOT IN (2, 3))::INTEGER + (event_id % 7 = 0)::INTEGER) AS segments FROM facts WHERE bad <> 4""",
    "rejects": f"WITH {FACTS} SELECT path, 'InvalidField' AS error_kind, 'LAT...LON' AS error_field FROM facts WHERE bad = 4",
    "family_histogram": f"WITH {FACTS} SELECT {FAMILY} AS family, count(*) AS messages FROM facts WHERE bad <> 4 GROUP BY 1",
    "event_codes": f"""WITH {FACTS}
SELECT path, 1 AS segment_index, 1 AS vtec_index, action, office, phenomenon, 'W' AS significance, etn, {when("valid_start")} AS valid_start, {when("valid_end")} AS valid_end, ugcs FROM coded WHERE bad = -1
UNION ALL SELECT path, CASE WHEN bad IN (2, 3) THEN 1 ELSE 2 END, 1, 'NEW', office, 'WI', 'Y', etn, {when("issue")}, {when("valid_end")}, state || 'C' || lpad((nr + 50)::VARCHAR, 3, '0') FROM coded WHERE bad <> 4 AND event_id % 7 = 0""",
    "hydrologic_codes": f"""WITH {FACTS} SELECT path, office[2:4] || 'I2' AS nwsli, '2' AS severity, 'ER' AS cause, {when("issue")} AS "begin", NULL::VARCHAR AS crest, {when("valid_end")} AS "end", 'NO' AS record FROM facts WHERE phenomenon = 'FL' AND bad = -1""",
    "tags_and_geometry": f"""WITH {FACTS}
SELECT path, 1 AS segment_index, {TORNADO} AS tornado_tag, (bad = -1 AND phenomenon = 'FF' AND event_id % 2 = 0) AS flash_flood_emergency, CASE WHEN event_id % 3 = 0 THEN event_id % 400 END AS hail,
  CASE WHEN event_id % 3 = 0 THEN (40 + event_id % 60)::INTEGER END AS wind_mph, CASE WHEN bad <> -1 AND phenomenon = 'FF' AND event_id % 2 = 0 THEN 'CATASTROPHIC' END AS damage_threat,
  ((phenomenon = 'TO')::INTEGER + (phenomenon = 'FF' AND event_id % 2 = 0)::INTEGER + 2 * (event_id % 3 = 0)::INTEGER) AS text_tags, 4 AS points, lat, -lon AS lon, strftime(issue, '%H%M') || 'Z' AS time,
  (event_id % 361)::INTEGER AS direction_degrees, (event_id % 60)::INTEGER AS speed_knots, true AS separated_by_dollars, false AS contains_andand FROM facts WHERE bad NOT IN (2, 3, 4)
UNION ALL SELECT path, CASE WHEN bad IN (2, 3) THEN 1 ELSE 2 END, NULL, false, NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, true, true FROM facts WHERE bad <> 4 AND event_id % 7 = 0""",
    "scan_counts": f"""WITH {FACTS}, streams AS (SELECT event_id // 20 AS stream, count(*) AS n, bool_or(bad = 4) AS spoilt FROM facts GROUP BY 1)
SELECT 'bulletin' AS input_kind, 'plain_text' AS transport, count(*) AS files, count(*) AS messages FROM facts WHERE bad <> 4
UNION ALL SELECT 'framed_stream', 'pid201', count(*), sum(n)::BIGINT FROM streams WHERE NOT spoilt HAVING count(*) > 0""",
    "frame_scan": """SELECT 'streams/' || lpad((event_id // 20)::VARCHAR, 9, '0') || '.sbn' AS path, count(*)::INTEGER AS frames, 3 + max((event_id % 20 % 5 = 0)::BIGINT) FILTER (event_id = first_id) AS junk_bytes, 8 AS pending_bytes
FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_id // 20) AS first_id FROM events) GROUP BY event_id // 20""",
    "import_actions": f"""WITH {FACTS}, rows AS (SELECT *, 'records/' || office || '/WUUS53/' || CASE WHEN event_id % 13 <> 0 THEN nnn || office[2:4] ELSE 'NO-AWIPS' END AS folder FROM facts WHERE bad <> 4)
SELECT path, 'archived' AS action, folder FROM rows UNION ALL SELECT 'zz/' || path, 'duplicate', folder FROM rows""",
    "routes": f"""WITH {FACTS}, rows AS (SELECT *, {FAMILY} AS own, CASE WHEN event_id % 13 <> 0 THEN nnn || office[2:4] ELSE '' END AS awips FROM facts WHERE bad <> 4),
hits AS (SELECT own = 'tornado' AS a, starts_with(awips, 'MWW') AS b, own = 'tornado' AND starts_with(awips, 'TORAA') AS c FROM rows),
named AS (SELECT 'tornado' AS route FROM hits WHERE a UNION ALL SELECT 'marine' FROM hits WHERE b UNION ALL SELECT 'both' FROM hits WHERE c UNION ALL SELECT 'rest' FROM hits WHERE NOT (a OR b OR c))
SELECT route, count(*) AS messages FROM named GROUP BY route""",
}
