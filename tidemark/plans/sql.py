"""The track queries in SQL, over the same tables."""

from __future__ import annotations

from tidemark.config import PERSISTENCE_K, REPORT_K, TOP_K

POINTS = """points AS (
  SELECT user_id AS mmsi, ts, epoch_us(ts) AS us,
    CASE WHEN value > 250 THEN CAST(21.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * CAST(event_id % 97 AS DOUBLE) + CAST(0.01 AS DOUBLE)
      ELSE CAST(19.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * CAST(k // 10 AS DOUBLE) + CAST(0.01 AS DOUBLE) END AS lat,
    CAST(-158.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * CAST(k % 2 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS lon,
    value / CAST(10 AS DOUBLE) AS sog, CAST(3.6 AS DOUBLE) * CAST(k AS DOUBLE) AS cog,
    'V' || user_id AS vessel_name, 'C' || (user_id % 7) AS vessel_class,
    CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN CAST(5 AS DOUBLE) ELSE round(value / CAST(50 AS DOUBLE)) END AS draft, event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

CELLS = """cells AS (
  SELECT CAST(floor(us / 3.6e9) AS BIGINT) AS tbin, CAST(floor(lat / CAST(0.02 AS DOUBLE)) AS BIGINT) AS ci, CAST(floor(lon / CAST(0.02 AS DOUBLE)) AS BIGINT) AS cj, mmsi,
    CAST(floor(us / 4.32e11) AS BIGINT) AS period,
    bool_or(coalesce(sog < 0.5, false)) AS stopped, bool_or(coalesce(sog > 2.0, false)) AS moving
  FROM points WHERE CAST(mmsi AS VARCHAR) NOT LIKE '98%' GROUP BY ALL)"""

EDGES = """edges AS (
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, count(*) AS n_windows, count(*) FILTER (WHERE a.stopped AND b.stopped) AS n_both_stopped,
    count(*) FILTER (WHERE a.moving AND b.moving) AS n_both_moving
  FROM cells a JOIN cells b ON a.tbin = b.tbin AND a.ci = b.ci AND a.cj = b.cj AND a.mmsi < b.mmsi GROUP BY 1, 2)"""

NAMES = """names AS (SELECT mmsi, 'V' || mmsi AS name, 'C' || (mmsi % 7) AS class FROM (SELECT DISTINCT mmsi FROM points))"""

VOYAGES = """gaps0 AS (
  SELECT *, (us - lag(us) OVER w) / CAST(3.6e9 AS DOUBLE) AS gap_hours FROM points WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon, sog)),
voyages0 AS (
  SELECT *, CAST(sum(CASE WHEN gap_hours IS NULL OR gap_hours > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY ts, lat, lon, sog ROWS UNBOUNDED PRECEDING) AS BIGINT) AS voyage_seq FROM gaps0),
voyages AS (SELECT *, mmsi || '_' || voyage_seq AS voyage_id FROM voyages0)"""

KINEMATICS = """kin AS (
  SELECT voyage_id, min(mmsi) AS mmsi, min(vessel_name) AS vessel_name, min(vessel_class) AS vessel_class, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n_points,
    (max(us) - min(us)) / CAST(3.6e9 AS DOUBLE) AS duration_hours, avg(sog) AS avg_sog, stddev_samp(sog) AS std_sog, max(sog) AS max_sog,
    first(lat ORDER BY ts, lat, lon, sog) AS lat_start, first(lon ORDER BY ts, lat, lon, sog) AS lon_start,
    last(lat ORDER BY ts, lat, lon, sog) AS lat_end, last(lon ORDER BY ts, lat, lon, sog) AS lon_end,
    avg(CASE WHEN sog < 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS stopped_ratio
  FROM voyages GROUP BY voyage_id)"""

COURSE = """turns AS (
  SELECT voyage_id, cog - lag(cog) OVER (PARTITION BY voyage_id ORDER BY ts, lat, lon, sog) AS d FROM voyages),
course AS (
  SELECT voyage_id, stddev_samp(d + 180 - 360 * floor((d + 180) / CAST(360 AS DOUBLE)) - 180) AS course_std FROM turns GROUP BY voyage_id)"""

COVERAGE = """coverage AS (
  SELECT CAST(floor(lat / CAST(0.05 AS DOUBLE)) AS BIGINT) AS ci, CAST(floor(lon / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cj, count(*) AS n_points,
    count(DISTINCT mmsi) AS n_vessels, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT mmsi) >= 5 AND count(DISTINCT CAST(ts AS DATE)) >= 3 AS coverage_ok
  FROM points GROUP BY 1, 2)"""

GAPS = """lags AS (
  SELECT mmsi, lag(voyage_id) OVER w AS voyage_id_before, voyage_id AS voyage_id_after, lag(ts) OVER w AS gap_start, ts AS gap_end, gap_hours,
    (lag(lat) OVER w + lat) / 2 AS lat_mid, (lag(lon) OVER w + lon) / 2 AS lon_mid, lag(sog) OVER w AS sog_before
  FROM voyages WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon, sog)),
gaps1 AS (
  SELECT *, CAST(floor(lat_mid / CAST(0.05 AS DOUBLE)) AS BIGINT) AS ci, CAST(floor(lon_mid / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cj FROM lags WHERE gap_hours >= 0.5),
gaps AS (
  SELECT g.*, coalesce(c.coverage_ok, false) AS coverage_ok, coalesce(c.n_vessels, 0) AS n_vessels, coalesce(sog_before > 2.0, false) AS was_underway,
    coalesce(sog_before < 0.5, false) AS was_stopped,
    CASE WHEN NOT coalesce(c.coverage_ok, false) THEN 'MISSING' WHEN sog_before > 2.0 THEN 'CONFLICT' ELSE 'MISSING_MOORED' END AS signal_class
  FROM gaps1 g LEFT JOIN coverage c ON c.ci = g.ci AND c.cj = g.cj)"""

ROLLUP = """rollup AS (
  SELECT voyage_id_before AS voyage_id, count(*) FILTER (WHERE signal_class = 'CONFLICT') AS n_signal_conflict, max(gap_hours) AS max_gap_hours, count(*) AS n_gaps
  FROM gaps GROUP BY 1)"""

DRAFT = """reliable AS (SELECT mmsi, count(DISTINCT draft) >= 2 AS ok FROM voyages WHERE draft IS NOT NULL GROUP BY mmsi),
draft AS (
  SELECT voyage_id, count(draft) AS draft_n, min(draft) AS draft_min, max(draft) AS draft_max, avg(draft) AS draft_mean, stddev_samp(draft) AS draft_std,
    coalesce(any_value(r.ok), false) AS draft_reliable_vessel, max(draft) - min(draft) AS draft_range,
    CASE WHEN count(draft) = 0 THEN 'NO_DRAFT' WHEN NOT coalesce(any_value(r.ok), false) THEN 'STATIC_DRAFT' WHEN max(draft) - min(draft) > 0.2 THEN 'CHANGED' ELSE 'UNCHANGED' END AS draft_class
  FROM voyages v LEFT JOIN reliable r ON r.mmsi = v.mmsi GROUP BY voyage_id)"""

FEATURES = """features AS (
  SELECT k.*, c.course_std, coalesce(r.n_signal_conflict, 0) AS n_signal_conflict, r.max_gap_hours, coalesce(r.n_gaps, 0) AS n_gaps, d.* EXCLUDE (voyage_id)
  FROM kin k LEFT JOIN course c USING (voyage_id) LEFT JOIN rollup r USING (voyage_id) LEFT JOIN draft d USING (voyage_id))"""

YEARLY = """by_period AS (
  SELECT a.period, a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, count(*) AS w, count(*) FILTER (WHERE a.stopped AND b.stopped) AS s, count(*) FILTER (WHERE a.moving AND b.moving) AS m
  FROM cells a JOIN cells b ON a.tbin = b.tbin AND a.ci = b.ci AND a.cj = b.cj AND a.mmsi < b.mmsi GROUP BY ALL),
yearly AS (
  SELECT mmsi_a, mmsi_b, CAST(sum(w) AS BIGINT) AS n_windows, CAST(sum(s) AS BIGINT) AS n_both_stopped, CAST(sum(m) AS BIGINT) AS n_both_moving, count(DISTINCT period) AS n_months,
    'V' || mmsi_a AS name_a, 'V' || mmsi_b AS name_b, 'C' || (mmsi_a % 7) AS class_a, 'C' || (mmsi_b % 7) AS class_b
  FROM by_period GROUP BY mmsi_a, mmsi_b)"""

SCORED = """raw AS (
  SELECT *, least(class_a, class_b) || '/' || greatest(class_a, class_b) AS class_pair, CAST(n_both_moving AS DOUBLE) AS s_raw,
    n_both_moving * sqrt(CAST(1 + n_months AS DOUBLE)) AS s_pers_sqrt, n_both_moving / CAST(1 + n_months AS DOUBLE) AS s_per_month FROM yearly),
scored0 AS (
  SELECT *, CASE WHEN stddev_samp(s_per_month) OVER g > 0 THEN (s_per_month - avg(s_per_month) OVER g) / stddev_samp(s_per_month) OVER g ELSE CAST(0 AS DOUBLE) END AS s_class_z,
    (rank() OVER (PARTITION BY class_pair ORDER BY s_per_month) + (count(*) OVER (PARTITION BY class_pair, s_per_month) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER g AS s_class_pct
  FROM raw WINDOW g AS (PARTITION BY class_pair)),
scored AS (
  SELECT s.*, s_class_pct * ln(1 + CAST(n_both_moving AS DOUBLE)) AS s_class_pct_w, t.mmsi_a IS NOT NULL AS is_truth
  FROM scored0 s LEFT JOIN truth t ON t.mmsi_a = s.mmsi_a AND t.mmsi_b = s.mmsi_b)"""

INCIDENTS = """errors AS (SELECT *, CAST(floor(us / 2.16e10) AS BIGINT) AS incident_num FROM points WHERE event_type = 'error' AND sog > 8),
spans AS (SELECT incident_num, min(ts) AS t_start, max(ts) AS t_end FROM errors GROUP BY 1),
incidents AS (
  SELECT DISTINCT e.incident_num, e.mmsi, s.t_start, s.t_end, 'error' AS incident_type, CASE WHEN e.mmsi % 2 = 0 THEN 'High' ELSE 'Some' END AS evidence
  FROM errors e JOIN spans s USING (incident_num)),
ipairs AS (SELECT a.incident_num, a.mmsi AS mmsi_a, b.mmsi AS mmsi_b FROM incidents a JOIN incidents b ON a.incident_num = b.incident_num AND a.mmsi < b.mmsi),
truth AS (SELECT mmsi_a, mmsi_b, max(incident_num) AS incident_num FROM ipairs GROUP BY 1, 2)"""

LABELS = """labels_v AS (
  SELECT f.*, EXISTS (SELECT 1 FROM incidents i WHERE i.mmsi = f.mmsi AND f.t_start <= i.t_end + INTERVAL 30 MINUTE AND f.t_end >= i.t_start - INTERVAL 30 MINUTE) AS is_incident FROM features f)"""

PORTS = """ports0 AS (
  SELECT CAST(floor(lat / CAST(0.03 AS DOUBLE)) AS BIGINT) AS ci, CAST(floor(lon / CAST(0.03 AS DOUBLE)) AS BIGINT) AS cj, count(DISTINCT mmsi) AS n_vessels, count(*) AS n_points, avg(lat) AS lat, avg(lon) AS lon
  FROM points WHERE sog < 0.5 GROUP BY 1, 2 HAVING count(DISTINCT mmsi) >= 3),
ports AS (SELECT *, 'P' || lpad(CAST(row_number() OVER (ORDER BY n_vessels DESC, ci, cj) - 1 AS VARCHAR), 2, '0') AS port_id FROM ports0)"""

DECLARATIONS = """ends AS (
  SELECT voyage_id, min(mmsi) AS mmsi, min(vessel_name) AS vessel_name, min(ts) AS t0, max(ts) AS t1, first(lat ORDER BY ts, lat, lon) AS alat, first(lon ORDER BY ts, lat, lon) AS alon,
    last(lat ORDER BY ts, lat, lon) AS blat, last(lon ORDER BY ts, lat, lon) AS blon FROM voyages GROUP BY voyage_id HAVING count(*) >= 5),
near AS (
  SELECT e.*, (SELECT first(port_id ORDER BY sqrt((p.lat - alat) ^ 2 + (p.lon - alon) ^ 2), port_id) FROM ports p WHERE sqrt((p.lat - alat) ^ 2 + (p.lon - alon) ^ 2) <= 0.05) AS dep,
    (SELECT first(port_id ORDER BY sqrt((p.lat - blat) ^ 2 + (p.lon - blon) ^ 2), port_id) FROM ports p WHERE sqrt((p.lat - blat) ^ 2 + (p.lon - blon) ^ 2) <= 0.05) AS arr FROM ends e),
cand AS (SELECT *, row_number() OVER (ORDER BY voyage_id) - 1 AS k FROM near WHERE dep <> arr ORDER BY voyage_id LIMIT 10),
other AS (
  SELECT c.*, (SELECT list(port_id ORDER BY CAST(substr(port_id, 2) AS BIGINT)) FROM ports p WHERE port_id <> c.dep AND port_id <> c.arr) AS others, CAST('0x' || substr(md5(voyage_id), 1, 6) AS BIGINT) AS h FROM cand c),
picked AS (SELECT *, coalesce(others[1 + h % greatest(len(others), 1)], dep) AS alt FROM other),
decl AS (
  SELECT 'D' || lpad(CAST(k AS VARCHAR), 3, '0') || tag AS decl_id, voyage_id, mmsi, vessel_name, CASE WHEN tag = 'F1' THEN alt ELSE dep END AS declared_departure,
    CASE WHEN tag = 'F0' THEN alt ELSE arr END AS declared_arrival,
    CASE WHEN tag = 'F2' THEN t0 - INTERVAL 3 DAY WHEN tag = 'F3' THEN t0 + INTERVAL 1 HOUR ELSE t0 END AS declared_start,
    CASE WHEN tag = 'F2' THEN t0 - INTERVAL 1 DAY WHEN tag = 'F3' THEN t0 + INTERVAL 4 HOUR ELSE t1 END AS declared_end,
    tag <> '' AS is_fraud, CASE tag WHEN 'F0' THEN 'FAKE_ROUTE' WHEN 'F1' THEN 'FAKE_CALL' WHEN 'F2' THEN 'BACKDATED' WHEN 'F3' THEN 'GAP_PERIOD' END AS fraud_type,
    CASE tag WHEN '' THEN 'taken from a real voyage, agrees with its track' WHEN 'F0' THEN 'declared arrival isn''t the real one' WHEN 'F1' THEN 'never called at the declared departure'
      WHEN 'F2' THEN 'declared time is before the voyage' ELSE 'declared time is in a silent or still part' END AS note
  FROM picked CROSS JOIN (SELECT unnest(['', 'F0', 'F1', 'F2', 'F3']) AS tag) WHERE tag = '' OR k < 3)"""

RULES = """track0 AS (
  SELECT d.decl_id, d.declared_departure, d.declared_arrival, v.ts, v.us, v.lat, v.lon, v.sog, v.ts BETWEEN d.declared_start AND d.declared_end AS inside
  FROM decl d JOIN voyages v USING (voyage_id)),
track1 AS (
  SELECT *, row_number() OVER o AS rn, count(*) OVER (PARTITION BY decl_id) AS n, count(*) OVER (PARTITION BY decl_id, inside) AS wn, row_number() OVER i AS wr,
    CASE WHEN inside THEN (us - lag(us) OVER i) / CAST(3.6e9 AS DOUBLE) END AS gap, CASE WHEN inside THEN lag(sog) OVER i END AS sog_before
  FROM track0 WINDOW o AS (PARTITION BY decl_id ORDER BY ts, lat, lon, sog), i AS (PARTITION BY decl_id, inside ORDER BY ts, lat, lon, sog)),
track2 AS (
  SELECT t.*, inside AND wr <= greatest(1, wn // 20) AS head, inside AND wn - wr + 1 <= greatest(1, wn // 20) AS tail,
    (SELECT first(port_id ORDER BY sqrt((p.lat - t.lat) ^ 2 + (p.lon - t.lon) ^ 2), port_id) FROM ports p) AS pid,
    (SELECT min(sqrt((p.lat - t.lat) ^ 2 + (p.lon - t.lon) ^ 2)) FROM ports p) AS pd FROM track1 t),
seen AS (
  SELECT decl_id, max(CASE WHEN rn = 1 THEN pid END) AS fp, max(CASE WHEN rn = n THEN pid END) AS lp, count(*) FILTER (WHERE inside) AS ni,
    coalesce(bool_or(head AND pd <= 0.05 AND pid = declared_departure), false) AS lft, coalesce(bool_or(tail AND pd <= 0.05 AND pid = declared_arrival), false) AS came,
    max(gap) AS gap, first(sog_before ORDER BY gap DESC NULLS LAST, wr) AS sb FROM track2 GROUP BY decl_id),
hits AS (
  SELECT d.*, s.gap AS max_gap_hours, list_filter([
    CASE WHEN s.decl_id IS NULL THEN 'R0_NO_TRACK' END,
    CASE WHEN s.decl_id IS NOT NULL AND fp <> declared_departure THEN 'R1_ROUTE' END, CASE WHEN s.decl_id IS NOT NULL AND lp <> declared_arrival THEN 'R1_ROUTE' END,
    CASE WHEN ni = 0 THEN 'R2_NO_RECORD' END, CASE WHEN ni > 0 AND NOT lft THEN 'R2_CALL' END, CASE WHEN ni > 0 AND NOT came THEN 'R2_CALL' END,
    CASE WHEN ni >= 2 AND coalesce(s.gap, 0) >= 2 AND sb > 2.0 THEN 'R3_SIGNAL' END], lambda x: x IS NOT NULL) AS triggered,
    list_filter([
    CASE WHEN s.decl_id IS NULL THEN 'no track of ' || mmsi END,
    CASE WHEN s.decl_id IS NOT NULL AND fp <> declared_departure THEN 'declared departure ' || declared_departure || ', port nearest to the first point ' || fp END,
    CASE WHEN s.decl_id IS NOT NULL AND lp <> declared_arrival THEN 'declared arrival ' || declared_arrival || ', port nearest to the last point ' || lp END,
    CASE WHEN ni = 0 THEN 'no report from ' || strftime(declared_start, '%Y-%m-%d %H:%M') || ' to ' || strftime(declared_end, '%Y-%m-%d %H:%M') END,
    CASE WHEN ni > 0 AND NOT lft THEN 'not near declared departure ' || declared_departure || ' when it should leave' END,
    CASE WHEN ni > 0 AND NOT came THEN 'not near declared arrival ' || declared_arrival || ' when it should arrive' END,
    CASE WHEN ni >= 2 AND coalesce(s.gap, 0) >= 2 THEN printf('silent for %.1f hours of the declared time', round(s.gap, 1)) || CASE WHEN sb > 2.0
      THEN printf(', under way before at %.1f knots', round(sb, 1)) ELSE ', not under way before: missing evidence, not counted' END END], lambda x: x IS NOT NULL) AS texts
  FROM decl d LEFT JOIN seen s USING (decl_id)),
results AS (
  SELECT decl_id, mmsi, voyage_id, vessel_name, declared_departure || '→' || declared_arrival AS declared, is_fraud AS truth_fraud, fraud_type, len(triggered) > 0 AS pred_fraud,
    CASE WHEN len(triggered) = 0 THEN 'LOW' WHEN len(triggered) = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk, CAST(len(triggered) AS BIGINT) AS n_rules,
    coalesce(array_to_string(triggered, ';'), '') AS triggered, substr(coalesce(array_to_string(texts, ' | '), ''), 1, 220) AS evidence, max_gap_hours FROM hits)"""

FUSION = """sides AS (
  SELECT mmsi_a AS mmsi, * EXCLUDE (mmsi_a), mmsi_a AS x, name_b AS o FROM yearly UNION ALL SELECT mmsi_b AS mmsi, * EXCLUDE (mmsi_a), mmsi_a AS x, name_a AS o FROM yearly),
best AS (
  SELECT mmsi, first(n_both_moving ORDER BY n_both_moving DESC, x, mmsi_b) AS mv, first(n_months ORDER BY n_both_moving DESC, x, mmsi_b) AS mo, first(o ORDER BY n_both_moving DESC, x, mmsi_b) AS o
  FROM sides GROUP BY mmsi),
ev AS (
  SELECT r.*, f.voyage_id IS NOT NULL AS space_ok, (SELECT count(*) > 0 FROM yearly) AS graph_ok,
    CASE WHEN f.voyage_id IS NULL THEN 'MISSING' WHEN f.n_gaps = 0 THEN 'SUPPORT' WHEN f.n_signal_conflict = 0 THEN 'MISSING' ELSE 'CONFLICT' END AS space_direction,
    CASE WHEN f.voyage_id IS NULL THEN 'no features of this voyage' WHEN f.n_gaps = 0 THEN 'no signal gap above the threshold'
      WHEN f.n_signal_conflict = 0 THEN f.n_gaps || printf(' signal gaps (longest %.1f hours), all moored or in weak coverage: not counted', round(coalesce(f.max_gap_hours, 0), 1))
      ELSE f.n_signal_conflict || printf(' signal gaps under way in good coverage (longest %.1f hours)', round(coalesce(f.max_gap_hours, 0), 1)) END AS space_text,
    CASE WHEN n_rules > 0 THEN 'CONFLICT' ELSE 'SUPPORT' END AS text_direction,
    CASE WHEN n_rules > 0 THEN substr(n_rules || ' rules triggered: ' || triggered, 1, 150) ELSE 'the declaration agrees with what can be checked' END AS text_text,
    CASE WHEN NOT (SELECT count(*) > 0 FROM yearly) THEN 'MISSING' WHEN mv IS NULL THEN 'SUPPORT' WHEN mo >= 11 AND mv > 1000 THEN 'MISSING' WHEN mv >= 50 THEN 'CONFLICT' ELSE 'SUPPORT' END AS graph_direction,
    CASE WHEN NOT (SELECT count(*) > 0 FROM yearly) THEN 'no co-occurrence graph' WHEN mv IS NULL THEN 'no stable co-occurrence'
      WHEN mo >= 11 AND mv > 1000 THEN 'long-standing co-occurrence with ' || o || ' (' || mo || '/12 months, ' || mv || ' windows under way): usual operation'
      WHEN mv >= 50 THEN 'unusual co-occurrence with ' || o || ': ' || mv || ' windows under way in ' || mo || ' months' ELSE 'weak co-occurrence, ' || mv || ' windows at most' END AS graph_text,
    least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE) * least(coalesce(f.max_gap_hours, 0) / CAST(6 AS DOUBLE), CAST(1 AS DOUBLE))) AS ss,
    least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * n_rules) AS st,
    least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE) * least(mv / CAST(800 AS DOUBLE), CAST(1 AS DOUBLE))) AS sg
  FROM results r LEFT JOIN features f USING (voyage_id) LEFT JOIN best b ON b.mmsi = r.mmsi),
sums AS (
  SELECT *, (CASE WHEN space_direction = 'CONFLICT' THEN CAST(0.3 AS DOUBLE) * ss ELSE 0 END + CASE WHEN text_direction = 'CONFLICT' THEN CAST(0.25 AS DOUBLE) * st ELSE 0 END
    + CASE WHEN graph_direction = 'CONFLICT' THEN CAST(0.45 AS DOUBLE) * sg ELSE 0 END)
    / (CASE WHEN space_ok THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CAST(0.25 AS DOUBLE) + CASE WHEN graph_ok THEN CAST(0.45 AS DOUBLE) ELSE 0 END) AS raw,
    CAST((space_direction = 'CONFLICT') AS BIGINT) + CAST((text_direction = 'CONFLICT') AS BIGINT) + CAST((graph_direction = 'CONFLICT') AS BIGINT) AS nc FROM ev)"""

REACH = """pairs2 AS (SELECT mmsi_a AS x, mmsi_b AS y FROM strong UNION SELECT mmsi_b, mmsi_a FROM strong),
reach AS (SELECT x, x AS r FROM pairs2 UNION SELECT p.y, q.r FROM reach q JOIN pairs2 p ON p.x = q.x)"""


TRADE = """real AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS BIGINT) AS i, CAST(m AS VARCHAR) AS dst, count(*) OVER () AS n FROM (SELECT mmsi_a AS m FROM edges UNION SELECT mmsi_b FROM edges)),
firms AS (
  SELECT 'ENT_' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, i, i >= 300 AS is_fraud, CASE WHEN i >= 300 THEN (i - 300) // 4 END AS ring_id,
    CASE WHEN i >= 300 THEN 'ring' || (i - 300) // 4 ELSE 'ENT_' || lpad(CAST(i AS VARCHAR), 4, '0') END AS seed FROM (SELECT unnest(range(0, 320)) AS i)),
codes AS (
  SELECT *, CAST('0x' || substr(md5(seed || 'k'), 1, 6) AS BIGINT) AS ck, CAST('0x' || substr(md5(seed || 'q'), 1, 6) AS BIGINT) AS cq, CAST('0x' || substr(md5(seed || 'v0'), 1, 6) AS BIGINT) AS v0,
    CAST('0x' || substr(md5(seed || 'v1'), 1, 6) AS BIGINT) AS v1, CAST('0x' || substr(md5(seed || 'p0'), 1, 6) AS BIGINT) AS p0, CAST('0x' || substr(md5(seed || 'p1'), 1, 6) AS BIGINT) AS p1 FROM firms),
slots AS (SELECT *, unnest([0, 1]) AS slot FROM codes),
edges2 AS (
  SELECT s.id AS src, r.dst, 'declares' AS type FROM slots s JOIN real r ON r.i = (v0 % r.n + slot * (1 + v1 % greatest(r.n // 4 - 1, 1))) % r.n WHERE slot <= CASE WHEN is_fraud THEN 1 ELSE ck % 2 END
  UNION ALL SELECT id, 'PORT_' || lpad(CAST((p0 % 30 + slot * (1 + p1 % 6)) % 30 AS VARCHAR), 3, '0'), 'ships_to' FROM slots WHERE slot <= CASE WHEN is_fraud THEN 1 ELSE cq % 2 END
  UNION ALL SELECT id, 'ENT_' || lpad(CAST(300 + ring_id * 4 + (i - 300 + 1) % 4 AS VARCHAR), 4, '0'), 'trades_with' FROM firms WHERE is_fraud),
trades AS (SELECT src AS a, dst AS b FROM edges2 WHERE type = 'trades_with' UNION SELECT dst, src FROM edges2 WHERE type = 'trades_with')"""

def sql(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def r6(*names: str, table: str = "") -> str:
    t = f"{table}." if table else ""
    return ", ".join(f"round({t}{n}, 6) + CAST(0 AS DOUBLE) AS {n}" for n in names)


RATIOS = "round(n_both_stopped / CAST(n_windows AS DOUBLE), 6) AS mooring_ratio, round(n_both_moving / CAST(n_windows AS DOUBLE), 6) AS moving_ratio"
VOYAGE_PARTS = (POINTS, VOYAGES, KINEMATICS, COURSE, COVERAGE, GAPS, ROLLUP, DRAFT, FEATURES)
SCORE_NAMES = ("s_raw", "s_pers_sqrt", "s_per_month", "s_class_z", "s_class_pct_w")
SCORE_PARTS = (POINTS, CELLS, YEARLY, INCIDENTS, SCORED)
REPORT = (
    "base AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_truth) AS t FROM scored)",
    "long AS (" + " UNION ALL ".join(f"SELECT '{s}' AS score, is_truth, row_number() OVER (ORDER BY {s} DESC, mmsi_a, mmsi_b) AS r FROM scored" for s in SCORE_NAMES) + ")",
    f"ks AS (SELECT CAST(unnest({list(REPORT_K)}) AS BIGINT) AS K)",
    """report AS (
  SELECT score, K, count(*) FILTER (WHERE r <= K AND is_truth) AS hits, count(*) FILTER (WHERE r <= K AND is_truth) / CAST(any_value(t) AS DOUBLE) AS recall,
    count(*) FILTER (WHERE r <= K AND is_truth) / CAST(K AS DOUBLE) AS precision,
    count(*) FILTER (WHERE r <= K AND is_truth) / CAST(K AS DOUBLE) / (any_value(t) / CAST(any_value(n) AS DOUBLE)) AS lift
  FROM long CROSS JOIN ks CROSS JOIN base GROUP BY score, K)""",
)
EVALUATED = (
    POINTS, CELLS, YEARLY, INCIDENTS, "s AS (SELECT *, n_both_moving * ln(1 + CAST(n_months AS DOUBLE)) AS score FROM yearly)",
    "q AS (SELECT *, row_number() OVER (ORDER BY score DESC, mmsi_a, mmsi_b) AS rank FROM s)", "found AS (SELECT rank FROM q JOIN truth USING (mmsi_a, mmsi_b))",
)
STRONG = "strong AS (SELECT mmsi_a, mmsi_b, n_windows FROM edges WHERE n_windows >= 2)"
DEGREE = "(SELECT x, count(*) AS d FROM (SELECT mmsi_a AS x FROM {0} UNION ALL SELECT mmsi_b FROM {0}) GROUP BY x)"
KIN_COLUMNS = (
    "voyage_id, mmsi, vessel_name, vessel_class, t_start, t_end, n_points, "
    + r6("duration_hours", "avg_sog", "std_sog", "max_sog", "lat_start", "lon_start", "lat_end", "lon_end", "stopped_ratio")
)
DRAFT_COLUMNS = "draft_n, " + r6("draft_min", "draft_max", "draft_mean", "draft_std", "draft_range") + ", draft_reliable_vessel, draft_class"

ORACLE: dict[str, str] = {
    "vessel_cells": sql(POINTS, CELLS, "SELECT tbin, ci, cj, mmsi, stopped, moving FROM cells"),
    "cooccurrence_edges": sql(POINTS, CELLS, EDGES, f"SELECT *, {RATIOS} FROM edges"),
    "edge_lift": sql(
        POINTS, CELLS, EDGES, NAMES, "deg AS (SELECT mmsi, count(*) AS n FROM cells GROUP BY 1)", "tot AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM (SELECT DISTINCT tbin, ci, cj FROM cells))",
        f"""SELECT e.*, {RATIOS}, round(CAST(n_windows AS DOUBLE) * t / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE)), 6) AS lift, x.name AS name_a, y.name AS name_b, x.class AS class_a, y.class AS class_b
        FROM edges e JOIN deg a ON a.mmsi = mmsi_a JOIN deg b ON b.mmsi = mmsi_b CROSS JOIN tot JOIN names x ON x.mmsi = mmsi_a JOIN names y ON y.mmsi = mmsi_b WHERE n_windows >= 2""",
    ),
    "voyages": sql(POINTS, VOYAGES, f"SELECT mmsi, ts, voyage_seq, voyage_id, {r6('gap_hours')} FROM voyages"),
    "voyage_kinematics": sql(POINTS, VOYAGES, KINEMATICS, f"SELECT {KIN_COLUMNS} FROM kin"),
    "course_std": sql(POINTS, VOYAGES, COURSE, f"SELECT voyage_id, {r6('course_std')} FROM course"),
    "coverage_grid": sql(POINTS, COVERAGE, "SELECT * FROM coverage"),
    "signal_gaps": sql(
        POINTS, VOYAGES, COVERAGE, GAPS,
        f"SELECT ci, cj, mmsi, voyage_id_before, voyage_id_after, gap_start, gap_end, {r6('gap_hours', 'lat_mid', 'lon_mid', 'sog_before')}, coverage_ok, n_vessels, was_underway, was_stopped, signal_class FROM gaps",
    ),
    "gap_rollup": sql(POINTS, VOYAGES, COVERAGE, GAPS, ROLLUP, f"SELECT voyage_id, n_signal_conflict, {r6('max_gap_hours')}, n_gaps FROM rollup"),
    "draft_usability": sql(POINTS, VOYAGES, DRAFT, f"SELECT voyage_id, {DRAFT_COLUMNS} FROM draft"),
    "voyage_features": sql(*VOYAGE_PARTS, f"SELECT {KIN_COLUMNS}, {r6('course_std', 'max_gap_hours')}, n_signal_conflict, n_gaps, {DRAFT_COLUMNS} FROM features"),
    "edge_accumulate": sql(POINTS, CELLS, YEARLY, f"SELECT *, {RATIOS} FROM yearly"),
    "edge_scores": sql(
        POINTS, CELLS, YEARLY, "s AS (SELECT *, n_both_moving * ln(1 + CAST(n_months AS DOUBLE)) AS score FROM yearly)",
        f"SELECT mmsi_a, mmsi_b, n_both_moving, n_months, {r6('score')}, row_number() OVER (ORDER BY score DESC, mmsi_a, mmsi_b) AS rank FROM s",
    ),
    "class_scores": sql(*SCORE_PARTS, f"SELECT mmsi_a, mmsi_b, class_pair, {r6(*SCORE_NAMES, 's_class_pct', table='scored')} FROM scored"),
    "class_baseline": sql(
        *SCORE_PARTS,
        """SELECT class_pair, count(*) AS n_edges, CAST(quantile_cont(n_both_moving, 0.5) AS DOUBLE) AS median_moving, max(n_both_moving) AS max_moving, count(*) FILTER (WHERE is_truth) AS n_truth
        FROM scored GROUP BY class_pair ORDER BY n_edges DESC, class_pair LIMIT 12""",
    ),
    "incident_pairs": sql(POINTS, INCIDENTS, "SELECT * FROM ipairs"),
    "validate_incidents": sql(
        POINTS, CELLS, EDGES, INCIDENTS,
        """SELECT p.incident_num, p.mmsi_a, p.mmsi_b, k.incident_type, k.evidence, e.n_windows IS NOT NULL AS detected, coalesce(e.n_windows, 0) AS n_windows
        FROM ipairs p LEFT JOIN edges e ON e.mmsi_a = p.mmsi_a AND e.mmsi_b = p.mmsi_b
        JOIN (SELECT incident_num, min(incident_type) AS incident_type, min(evidence) AS evidence FROM incidents GROUP BY 1) k ON k.incident_num = p.incident_num""",
    ),
    "topk_curve": sql(*SCORE_PARTS, *REPORT, f"SELECT score, K, hits, {r6('recall', 'precision', 'lift')} FROM report"),
    "best_score": sql(*SCORE_PARTS, *REPORT, "SELECT score, round(avg(lift), 6) AS mean_lift FROM report WHERE K IN (20, 50, 100, 200) GROUP BY score ORDER BY mean_lift DESC, score LIMIT 1"),
    "persistence": sql(
        *SCORE_PARTS,
        """SELECT count(*) AS n_edges, count(*) FILTER (WHERE n_months = 2) AS n_full, round(count(*) FILTER (WHERE n_months = 2) / CAST(count(*) AS DOUBLE), 6) AS full_share,
        count(*) FILTER (WHERE n_months = 2 AND is_truth) AS n_full_truth, CAST(quantile_cont(n_months, 0.5) AS DOUBLE) AS median_months,
        CAST(quantile_cont(n_months, 0.5) FILTER (WHERE is_truth) AS DOUBLE) AS median_months_truth, CAST(quantile_cont(n_both_moving, 0.5) AS DOUBLE) AS median_moving,
        CAST(quantile_cont(n_both_moving, 0.5) FILTER (WHERE is_truth) AS DOUBLE) AS median_moving_truth FROM scored""",
    ),
    "persistence_curve": sql(
        *SCORE_PARTS,
        "placed AS (SELECT is_truth, row_number() OVER (ORDER BY s_pers_sqrt DESC, mmsi_a, mmsi_b) AS b, row_number() OVER (ORDER BY s_per_month DESC, mmsi_a, mmsi_b) AS p FROM scored)",
        f"""SELECT K, count(*) FILTER (WHERE b <= K AND is_truth) AS base_hits, count(*) FILTER (WHERE p <= K AND is_truth) AS pers_hits
        FROM placed CROSS JOIN (SELECT CAST(unnest({list(PERSISTENCE_K)}) AS BIGINT) AS K) GROUP BY K""",
    ),
    "persistence_ranks": sql(
        *SCORE_PARTS,
        f"""SELECT mmsi_a, mmsi_b, n_both_moving, n_months, {r6('s_per_month', table='q')}, rank_pers
        FROM (SELECT *, row_number() OVER (ORDER BY s_per_month DESC, mmsi_a, mmsi_b) AS rank_pers FROM scored) q WHERE is_truth""",
    ),
    "edge_evaluation": sql(
        *EVALUATED, f"ks AS (SELECT least(CAST(unnest({list(TOP_K)}) AS BIGINT), (SELECT count(*) FROM q)) AS K UNION ALL SELECT count(*) FROM q)",
        """SELECT K, (SELECT count(*) FROM found WHERE rank <= K) AS hits, round((SELECT count(*) FROM found WHERE rank <= K) / CAST((SELECT count(*) FROM truth) AS DOUBLE), 6) AS recall,
        round((SELECT count(*) FROM found WHERE rank <= K) / CAST(K AS DOUBLE), 6) AS precision FROM ks""",
    ),
    "truth_summary": sql(
        *EVALUATED,
        """SELECT (SELECT count(*) FROM truth) AS n_truth, count(*) AS n_found, CAST(quantile_cont(rank, 0.5) AS DOUBLE) AS median_rank, min(rank) AS best_rank, max(rank) AS worst_rank,
        round(count(*) / CAST((SELECT count(*) FROM truth) AS DOUBLE), 6) AS recall FROM found""",
    ),
    "truth_by_name": sql(
        *SCORE_PARTS,
        "known AS (SELECT DISTINCT least(name_a, name_b) AS x, greatest(name_a, name_b) AS y FROM scored WHERE is_truth)",
        "SELECT mmsi_a, mmsi_b, name_a, name_b, k.x IS NOT NULL AS is_truth FROM yearly LEFT JOIN known k ON k.x = least(name_a, name_b) AND k.y = greatest(name_a, name_b)",
    ),
    "validate_month": sql(
        POINTS, CELLS, EDGES, INCIDENTS,
        """SELECT p.incident_num, p.mmsi_a, p.mmsi_b, 'error' AS incident_type, k.evidence, e.n_windows IS NOT NULL AS detected, coalesce(e.n_windows, 0) AS n_windows
        FROM ipairs p LEFT JOIN edges e ON e.mmsi_a = p.mmsi_a AND e.mmsi_b = p.mmsi_b
        JOIN (SELECT incident_num, min(evidence) AS evidence, min(t_start) + INTERVAL 20 DAY AS t FROM incidents GROUP BY 1) k ON k.incident_num = p.incident_num
        WHERE t >= TIMESTAMP '2024-02-01' AND t < TIMESTAMP '2024-03-01'""",
    ),
    "moored_pairs": sql(POINTS, CELLS, EDGES, f"SELECT *, {RATIOS} FROM edges WHERE n_windows >= 1 AND n_both_stopped / CAST(n_windows AS DOUBLE) >= 0.6"),
    "moving_pairs": sql(POINTS, CELLS, EDGES, f"SELECT *, {RATIOS} FROM edges WHERE n_both_moving >= 2"),
    "truth_hits": sql(
        POINTS, CELLS, YEARLY, INCIDENTS, "s AS (SELECT *, n_both_moving * ln(1 + CAST(n_months AS DOUBLE)) AS score FROM yearly)",
        "q AS (SELECT *, row_number() OVER (ORDER BY score DESC, mmsi_a, mmsi_b) AS rank FROM s)",
        "SELECT incident_num, rank, round(score, 6) AS score, n_both_moving, mmsi_a, mmsi_b, name_a, name_b, class_a, class_b FROM q JOIN truth USING (mmsi_a, mmsi_b)",
    ),
    "voyage_labels": sql(*VOYAGE_PARTS, INCIDENTS, LABELS, "SELECT voyage_id, mmsi, is_incident FROM labels_v"),
    "incident_tracks": sql(
        POINTS, INCIDENTS,
        f"SELECT i.incident_num, p.mmsi, p.ts, {r6('lat', 'lon', 'sog', table='p')} FROM points p JOIN incidents i ON i.mmsi = p.mmsi AND p.ts BETWEEN i.t_start - INTERVAL 30 MINUTE AND i.t_end + INTERVAL 30 MINUTE",
    ),
    "incident_months": sql(
        POINTS, INCIDENTS,
        """SELECT DISTINCT CAST(unnest(generate_series(date_trunc('month', t_start - INTERVAL 60 DAY), date_trunc('month', t_end + INTERVAL 60 DAY), INTERVAL 1 MONTH)) AS TIMESTAMP) AS month FROM incidents""",
    ),
    "pruned_points": sql(
        POINTS, INCIDENTS,
        """SELECT mmsi, count(*) AS n FROM points WHERE date_trunc('month', ts) IN (SELECT unnest(generate_series(date_trunc('month', t_start - INTERVAL 30 MINUTE),
        date_trunc('month', t_end + INTERVAL 30 MINUTE), INTERVAL 1 MONTH)) FROM incidents) GROUP BY mmsi""",
    ),
    "stored_points": sql(
        POINTS, INCIDENTS,
        """SELECT mmsi, count(*) AS n FROM points WHERE date_trunc('day', ts) IN (SELECT unnest(generate_series(date_trunc('day', t_start - INTERVAL 30 MINUTE),
        date_trunc('day', t_end + INTERVAL 30 MINUTE), INTERVAL 1 DAY)) FROM incidents WHERE evidence = 'High') GROUP BY mmsi""",
    ),
    "stored_edges": sql(POINTS, CELLS.replace("4.32e11", "8.64e10"), YEARLY, f"SELECT *, {RATIOS} FROM yearly"),
    "auc_exact": sql(
        *VOYAGE_PARTS, INCIDENTS, LABELS,
        "ranked AS (SELECT is_incident, rank() OVER (ORDER BY max_sog) + (count(*) OVER (PARTITION BY max_sog) - 1) / CAST(2 AS DOUBLE) AS r FROM labels_v)",
        "c AS (SELECT count(*) FILTER (WHERE is_incident) AS p, count(*) FILTER (WHERE NOT is_incident) AS n, sum(r) FILTER (WHERE is_incident) AS s FROM ranked)",
        "SELECT CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, round((s - p * (p + 1) / CAST(2 AS DOUBLE)) / (CAST(p AS DOUBLE) * CAST(n AS DOUBLE)), 6) AS auc FROM c",
    ),
    "feature_contribution": sql(
        *VOYAGE_PARTS, INCIDENTS, LABELS,
        "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, is_incident FROM labels_v" for c in ("n_points", "duration_hours", "avg_sog", "max_sog", "stopped_ratio")) + ")",
        "m AS (SELECT feature, quantile_cont(x, 0.5) FILTER (WHERE is_incident) AS median_event, quantile_cont(x, 0.5) FILTER (WHERE NOT is_incident) AS median_normal FROM long GROUP BY feature)",
        f"SELECT feature, {r6('median_event', 'median_normal', table='m')}, round(m.median_event / CASE WHEN m.median_normal <> 0 THEN m.median_normal END, 6) AS ratio FROM m",
    ),
    "ports": sql(POINTS, PORTS, f"SELECT ci, cj, n_vessels, n_points, {r6('lat', 'lon')}, port_id FROM ports"),
    "nearest_port": sql(
        POINTS, PORTS, "places AS (SELECT mmsi, last(lat ORDER BY ts, lat, lon) AS lat, last(lon ORDER BY ts, lat, lon) AS lon FROM points GROUP BY mmsi)",
        """SELECT mmsi, round(x.lat, 6) AS lat, round(x.lon, 6) AS lon, (SELECT first(port_id ORDER BY sqrt((p.lat - x.lat) ^ 2 + (p.lon - x.lon) ^ 2), port_id) FROM ports p) AS port_id,
        (SELECT round(min(sqrt((p.lat - x.lat) ^ 2 + (p.lon - x.lon) ^ 2)), 6) FROM ports p) AS port_distance FROM places x""",
    ),
    "declarations": sql(POINTS, VOYAGES, PORTS, DECLARATIONS, "SELECT * FROM decl"),
    "rule_checks": sql(POINTS, VOYAGES, PORTS, DECLARATIONS, RULES, f"SELECT * EXCLUDE (max_gap_hours), {r6('max_gap_hours')} FROM results"),
    "confusion": sql(
        POINTS, VOYAGES, PORTS, DECLARATIONS, RULES,
        """SELECT count(*) FILTER (WHERE truth_fraud AND pred_fraud) AS tp, count(*) FILTER (WHERE truth_fraud AND NOT pred_fraud) AS fn,
        count(*) FILTER (WHERE NOT truth_fraud AND pred_fraud) AS fp, count(*) FILTER (WHERE NOT truth_fraud AND NOT pred_fraud) AS tn FROM results""",
    ),
    "fusion": sql(
        *VOYAGE_PARTS, CELLS, YEARLY, PORTS, DECLARATIONS, RULES, FUSION,
        """SELECT decl_id, vessel_name, truth_fraud, space_direction, space_text, text_direction, text_text, graph_direction, graph_text, round(raw, 4) AS fusion_score, nc AS n_modality_conflict,
        CASE WHEN nc >= 2 OR raw >= 0.5 THEN 'RED' WHEN nc = 1 THEN 'YELLOW' ELSE 'GREEN' END AS intercept_level,
        CASE WHEN nc >= 2 OR raw >= 0.5 THEN 'review by hand and hold payment' WHEN nc = 1 THEN 'ask for documents, then review' ELSE 'no conflict with physical evidence' END AS suggested_action FROM sums""",
    ),
    "components": sql(POINTS, CELLS, EDGES, STRONG, REACH, "SELECT x AS node, min(r) AS component FROM reach GROUP BY x", recursive=True),
    "degree_core": sql(
        POINTS, CELLS, EDGES, STRONG.replace("strong AS", "strong0 AS"), f"deg AS {DEGREE.format('strong0')}",
        "strong AS (SELECT * FROM strong0 WHERE mmsi_a IN (SELECT x FROM deg WHERE d >= 3) AND mmsi_b IN (SELECT x FROM deg WHERE d >= 3))", REACH,
        "comp AS (SELECT x, min(r) AS c FROM reach GROUP BY x)", "top AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)",
        "big AS (SELECT s.* FROM strong s JOIN comp ON comp.x = s.mmsi_a WHERE comp.c = (SELECT c FROM top))",
        f"SELECT x AS node, d AS degree FROM {DEGREE.format('big')} ORDER BY d DESC, x LIMIT 34", recursive=True,
    ),
    "ego_network": sql(
        POINTS, CELLS, EDGES, STRONG,
        "SELECT * FROM (SELECT mmsi_a AS node, mmsi_b AS other, n_windows FROM strong UNION ALL SELECT mmsi_b, mmsi_a, n_windows FROM strong) WHERE node = 5 ORDER BY n_windows DESC, other LIMIT 14",
    ),
    "trade_layer": sql(POINTS, CELLS, EDGES, TRADE, "SELECT src, dst, type FROM edges2"),
    "ring_communities": sql(
        POINTS, CELLS, EDGES, TRADE, "hop AS (SELECT a, a AS r FROM trades UNION SELECT t.b, h.r FROM hop h JOIN trades t ON t.a = h.a)", "part AS (SELECT a AS id, min(r) AS c FROM hop GROUP BY a)",
        "uses AS (SELECT DISTINCT c, type, dst FROM edges2 JOIN part ON id = src WHERE type <> 'trades_with')",
        """SELECT c AS community, count(*) AS size, round((SELECT count(*) FROM trades JOIN part q ON q.id = a WHERE q.c = p.c AND a < b) / (count(*) * (count(*) - 1) / CAST(2 AS DOUBLE)), 3) AS internal_density,
        (SELECT count(*) FROM uses u WHERE u.c = p.c AND type = 'declares') AS n_shared_vessels, (SELECT count(*) FROM uses u WHERE u.c = p.c AND type = 'ships_to') AS n_shared_ports,
        string_agg(p.id, ',' ORDER BY p.id) AS members, (SELECT string_agg(dst, ',' ORDER BY dst) FROM uses u WHERE u.c = p.c AND type = 'declares') AS vessels,
        count(*) FILTER (WHERE f.is_fraud) AS n_fraud_true, count(*) FILTER (WHERE f.is_fraud) / CAST(count(*) AS DOUBLE) AS precision
        FROM part p JOIN firms f ON f.id = p.id GROUP BY c HAVING count(*) >= 4""",
        recursive=True,
    ),
    "ring_cycles": sql(
        POINTS, CELLS, EDGES, TRADE,
        "walk AS (SELECT [a, b] AS path FROM trades WHERE b > a UNION ALL SELECT list_append(path, b) FROM walk JOIN trades ON a = path[-1] WHERE b > path[1] AND NOT list_contains(path, b) AND len(path) < 6)",
        """SELECT len(path) AS length, array_to_string(path, '→') || '→' || path[1] AS members FROM walk WHERE len(path) >= 3 AND path[2] < path[-1] AND EXISTS (SELECT 1 FROM trades WHERE a = path[-1] AND b = path[1])
        AND (SELECT count(*) FROM trades WHERE list_contains(path, a) AND list_contains(path, b)) = 2 * len(path)""",
        recursive=True,
    ),
    "snapshot_union": sql(
        POINTS, CELLS, EDGES, STRONG,
        "SELECT * FROM (SELECT * FROM strong ORDER BY n_windows DESC, mmsi_a, mmsi_b LIMIT 20) UNION SELECT * FROM strong WHERE mmsi_a < 4 OR mmsi_b < 4",
    ),
    "snapshot_declared": sql(
        POINTS, VOYAGES, CELLS, EDGES, STRONG, PORTS, DECLARATIONS,
        "SELECT * FROM (SELECT * FROM strong ORDER BY n_windows DESC, mmsi_a, mmsi_b LIMIT 500) UNION SELECT * FROM strong WHERE mmsi_a IN (SELECT mmsi FROM decl) OR mmsi_b IN (SELECT mmsi FROM decl)",
    ),
    "snapshot_tracks": sql(POINTS, VOYAGES, PORTS, DECLARATIONS, f"SELECT mmsi, ts, {r6('lat', 'lon', 'sog', 'cog')}, voyage_id FROM voyages WHERE mmsi IN (SELECT mmsi FROM decl)"),
    "snapshot_features": sql(*VOYAGE_PARTS, PORTS, DECLARATIONS, f"SELECT {KIN_COLUMNS}, {r6('course_std', 'max_gap_hours')}, n_signal_conflict, n_gaps, {DRAFT_COLUMNS} FROM features WHERE mmsi IN (SELECT mmsi FROM decl)"),
    "csv_points": sql(POINTS, f"SELECT mmsi, ts, {r6('lat', 'lon', 'sog', 'cog')}, CASE WHEN mmsi % 3 = 0 THEN NULL ELSE CAST(90 AS DOUBLE) END AS heading, vessel_name FROM points"),
    "zipped_points": sql(POINTS, f"SELECT mmsi, ts, {r6('lat', 'lon', 'sog', 'cog')}, CAST(CASE WHEN mmsi % 3 = 0 THEN 511 ELSE 90 END AS DOUBLE) AS heading, vessel_name FROM points"),
    "track_of": sql(POINTS, f"SELECT mmsi, ts, {r6('lat', 'lon', 'sog', 'cog')} FROM points WHERE mmsi = 5"),
    "top_edges": sql(POINTS, CELLS, EDGES, STRONG, "SELECT * FROM strong ORDER BY n_windows DESC, mmsi_a, mmsi_b LIMIT 100"),
    "largest_component": sql(
        POINTS, CELLS, EDGES, STRONG, REACH, "comp AS (SELECT x, min(r) AS c FROM reach GROUP BY x)", "top AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)",
        "SELECT s.* FROM strong s JOIN comp ON comp.x = s.mmsi_a WHERE comp.c = (SELECT c FROM top)", recursive=True,
    ),
    "degrees": sql(POINTS, CELLS, EDGES, STRONG, "SELECT x AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM (SELECT mmsi_a AS x, n_windows AS w FROM strong UNION ALL SELECT mmsi_b, n_windows FROM strong) GROUP BY x"),
    "eda_value_counts": sql(
        POINTS, INCIDENTS,
        """SELECT vessel_class AS value, count(*) AS n, 'class' AS what FROM points GROUP BY 1 UNION ALL
        SELECT o.value, count(i.evidence) AS n, 'evidence' FROM (SELECT unnest(['High', 'Good', 'Some', 'No obvious evidence']) AS value) o LEFT JOIN incidents i ON i.evidence = o.value GROUP BY 1""",
    ),
    "showcase": sql(
        POINTS, INCIDENTS, "strong AS (SELECT * FROM incidents WHERE evidence = 'High' AND t_start IS NOT NULL AND t_end IS NOT NULL)",
        "sized AS (SELECT incident_num, count(*) AS k, min(incident_type) AS kind FROM strong GROUP BY 1)",
        "two AS (SELECT incident_num, CASE WHEN row_number() OVER (ORDER BY incident_num) <= 2 THEN 0 ELSE 2 END AS turn FROM sized WHERE k = 2)",
        "picked AS (SELECT incident_num FROM (SELECT * FROM two UNION ALL SELECT min(incident_num), 1 FROM sized WHERE k = 1 GROUP BY kind) ORDER BY turn, incident_num LIMIT 4)",
        "SELECT * FROM strong WHERE incident_num IN (SELECT incident_num FROM picked)",
    ),
    "null_rates": sql(
        POINTS,
        """SELECT vessel_class AS value, round(avg(CAST((draft IS NOT NULL) AS INTEGER)), 6) AS rate, count(*) AS n FROM points GROUP BY 1 UNION ALL
        SELECT 'all', round(avg(CAST((draft IS NOT NULL) AS INTEGER)), 6), count(*) FROM points""",
    ),
    "quantiles": sql(POINTS, "SELECT CAST(q AS DOUBLE) AS q, round((SELECT quantile_cont(sog, [0.5, 0.75, 0.9, 0.99]) FROM points)[i], 6) AS value FROM (SELECT unnest([0.5, 0.75, 0.9, 0.99]) AS q, unnest([1, 2, 3, 4]) AS i)"),
    "overview": sql(
        POINTS, INCIDENTS,
        """SELECT count(*) AS n_points, count(DISTINCT mmsi) AS n_vessels, min(ts) AS first_ts, max(ts) AS last_ts, (SELECT count(DISTINCT incident_num) FROM incidents) AS n_incidents,
        (SELECT count(DISTINCT mmsi) FROM incidents) AS n_incident_vessels FROM points""",
    ),
    "supplier_cooccurrence": sql(
        """cells AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS tbin, l_partkey % 50 AS ci, 0 AS cj, l_suppkey AS mmsi, bool_or(l_quantity < 10) AS stopped, bool_or(l_quantity > 25) AS moving
        FROM lineitem GROUP BY ALL)""",
        EDGES, f"SELECT *, {RATIOS} FROM edges WHERE n_windows >= 3",
    ),
}
