"""What the registered queries must return, in DuckDB SQL over the same tables; written from the rows' integers, not from bytes."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

PLOTS = """
WITH e AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id, event_type, value FROM events),
i AS (
  SELECT *, CAST(us % 86400000000 AS BIGINT) * 128 // 1000000 AS stamp128, CAST(floor(value * 128) AS BIGINT) % 1280 - 128 AS late128,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 48 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 20 WHEN 'error' THEN 34 END AS cat FROM e),
q AS (
  SELECT seq, us, us / 1000000.0::DOUBLE AS ts, CAST(user_id % 3 + 1 AS INTEGER) AS sac, CAST(user_id % 7 + 1 AS INTEGER) AS sic, cat,
    stamp128 / 128.0::DOUBLE AS tod_stamp, ((stamp128 - late128 + 11059200) % 11059200) / 128.0::DOUBLE AS tod,
    (seq * 7919 % 65536) * 360.0::DOUBLE / 65536.0::DOUBLE AS theta, (seq * 104729 % 65536) / 128.0::DOUBLE AS rho, CAST(seq % 4096 AS INTEGER) AS modea, seq % 50 = 0 AS flag_test, seq * 17 % 900 + 40 AS n_bytes
  FROM i),
p AS (
  SELECT *, CASE WHEN tod_stamp - tod <= -86000 THEN tod_stamp - tod + 86400 WHEN tod_stamp - tod >= 85888 THEN tod_stamp - tod - 86400 ELSE tod_stamp - tod END AS delay,
    CAST(us // 1000000 AS BIGINT) AS sec FROM q)
"""


def _stats(keys: str, rows: str) -> str:
    """CTEs ending in s: (keys, cuenta, max, min, media, stdev, mode, p99); rows: a relation with keys and delay."""
    return f"""
, d AS (SELECT *, CAST(floor((delay + 8) * 10000 / 50) AS INTEGER) AS bin FROM {rows} WHERE abs(delay) < 8),
h AS (SELECT {keys}, bin, count(*) AS n FROM d GROUP BY {keys}, bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {keys}) AS total, min(bin) OVER (PARTITION BY {keys}) AS first_bin,
  row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, bin) AS rank FROM h),
m AS (SELECT {", ".join("c." + k.strip() for k in keys.split(","))}, c.bin, c.n, coalesce(u.n, 0) AS under, coalesce(o.n, 0) AS over_
  FROM c LEFT JOIN h u ON {" AND ".join(f"c.{k.strip()} = u.{k.strip()}" for k in keys.split(","))} AND u.bin = c.bin - 1
  LEFT JOIN h o ON {" AND ".join(f"c.{k.strip()} = o.{k.strip()}" for k in keys.split(","))} AND o.bin = c.bin + 1 WHERE rank = 1),
mode AS (SELECT {keys}, bin * 0.005::DOUBLE - 8 + CASE WHEN 2 * n - under - over_ = 0 THEN 0 ELSE (n - under) / (2 * n - under - over_)::DOUBLE END * 0.005::DOUBLE AS mode FROM m),
p99 AS (SELECT {keys}, min(bin) * 0.005::DOUBLE - 8 AS p99 FROM c WHERE seen >= total * 0.99::DOUBLE GROUP BY {keys}),
g AS (SELECT {keys}, count(*) AS cuenta, max(delay) AS max, min(delay) AS min, avg(delay) AS media, sqrt(greatest(avg(delay * delay) - avg(delay) * avg(delay), 0)) AS stdev FROM d GROUP BY {keys}),
s AS (SELECT g.*, CASE WHEN mode.mode BETWEEN -7.994 AND 7.996 THEN mode.mode ELSE 0 END AS mode, p99.p99 FROM g JOIN mode USING ({keys}) JOIN p99 USING ({keys}))
"""


WINDOW = "sac, sic, cat, window_start"


def _windows(seconds: int, where: str = "TRUE") -> str:
    return f", w AS (SELECT *, sec // {seconds} * {seconds} AS window_start FROM p WHERE {where})" + _stats(WINDOW, "w")


# Delays are multiples of 1/128 s: their sums, and so all of these, are the same in any order of summing.
R = "max, min, media, stdev, p99"
ORACLES["delay_windows_5min"] = PLOTS + _windows(300) + f"SELECT {WINDOW}, cuenta, {R} FROM s"
ORACLES["delay_windows_mode"] = PLOTS + ", w AS (SELECT *, sec // 86400 * 86400 AS window_start FROM p)" + _stats("cat, window_start", "w") + "SELECT cat, window_start, cuenta, mode, p99 FROM s"
ORACLES["delay_histogram"] = PLOTS + "SELECT sac, sic, cat, CAST(floor((delay + 8) * 10000 / 50) AS INTEGER) AS bin, count(*) AS n FROM p WHERE abs(delay) < 8 GROUP BY ALL"
ORACLES["delay_windows_complete_only"] = PLOTS + _windows(86400) + f"SELECT {WINDOW}, cuenta, media FROM s WHERE window_start + 86400 <= (SELECT max(ts) FROM p)"
ORACLES["delay_windows_compat"] = (
    PLOTS + _stats("sac, sic, cat", "p")
    + """, x AS (SELECT sac, sic, cat, min(bin) AS b, min(first_bin) AS f FROM c WHERE (cat = 1 AND seen >= total * 0.99::DOUBLE) OR (cat <> 1 AND seen > total * 0.99::DOUBLE) GROUP BY ALL)
SELECT sac, sic, cat, cuenta, CASE WHEN b IS NULL OR b = f THEN 0 ELSE b * 0.005::DOUBLE - 8 END AS p99 FROM g LEFT JOIN x USING (sac, sic, cat)"""
)
ORACLES["delay_day_wrap"] = PLOTS + "SELECT seq, tod_stamp, tod, delay FROM p WHERE abs(tod_stamp - tod) > 43200"
ORACLES["delay_over_midnight"] = """WITH x AS (SELECT event_id AS seq, event_id * 331 % 256 - 128 AS s, event_id * 17 % 1024 - 512 AS l FROM events)
SELECT seq, (s + 11059200) % 11059200 / 128.0::DOUBLE AS tod_stamp, (s - l + 11059200) % 11059200 / 128.0::DOUBLE AS tod, l / 128.0::DOUBLE AS delay FROM x"""
ORACLES["delay_sane"] = PLOTS + "SELECT seq, delay FROM p WHERE NOT flag_test AND abs(delay) < 8"
ORACLES["availability_upsert"] = (
    PLOTS + _windows(3600)
    + f"SELECT printf('%03d_%03d_%03d', sac, sic, cat) AS sac_sic_cat, 'north' AS region, window_start AS timestamp, cuenta, {R} FROM s WHERE cat IN (1, 48, 10, 19, 20)"
)
ORACLES["archive_update"] = (
    PLOTS + _windows(3600)
    + f"SELECT {WINDOW}, cuenta, CASE WHEN abs(mode) >= 8 THEN 0 ELSE mode END AS mode, CASE WHEN abs(min) >= 8 THEN 0 ELSE min END AS min, CASE WHEN abs(max) >= 8 THEN 0 ELSE max END AS max FROM s"
)
ORACLES["availability_rollup"] = (
    PLOTS + _windows(300)
    + """, k AS (SELECT * FROM (VALUES (1, 600), (6, 700), (24, 775), (288, 797)) t(steps, kept)),
r AS (SELECT steps, kept, sac, sic, cat, window_start // (steps * 300) * (steps * 300) AS slot_start, count(*) AS n_windows, avg(media) AS a, max(media) AS b, min(media) AS c FROM s, k GROUP BY ALL)
SELECT CAST(steps AS INTEGER) AS steps, sac, sic, cat, slot_start, n_windows, round(CASE WHEN 2 * n_windows >= steps THEN a END, 6) AS avg_media, round(CASE WHEN 2 * n_windows >= steps THEN b END, 6) AS max_media,
  round(CASE WHEN 2 * n_windows >= steps THEN c END, 6) AS min_media FROM r WHERE slot_start > (SELECT max(window_start) FROM s) - steps * 300 * kept"""
)
ORACLES["availability_stored"] = ORACLES["availability_upsert"]
ORACLES["archive_increments"] = ORACLES["availability_rollup"]
ORACLES["flow_bandwidth_total"] = PLOTS + """, w AS (SELECT *, sec // 3600 * 3600 AS window_start, 'radar' || sac AS flow FROM p)
SELECT window_start, flow, count(*) AS packets, CAST(sum(n_bytes) AS BIGINT) AS bytes, round(sum(n_bytes) / 3600.0::DOUBLE, 6) AS bytes_per_s FROM w GROUP BY GROUPING SETS ((window_start, flow), (window_start))"""
ORACLES["pipeline_counters"] = PLOTS + """, c AS (SELECT *, sac <> 3 AS a, cat <> 34 AS k, NOT flag_test AS f, seq % 10 <> 0 AS u FROM p)
SELECT count(*) AS received, count(*) FILTER (WHERE a AND k) AS processed, count(*) FILTER (WHERE NOT (a AND k)) AS ignored, count(*) FILTER (WHERE a AND k AND NOT f) AS filtered, count(*) FILTER (WHERE a AND k AND f AND u) AS "unique",
  count(*) FILTER (WHERE a AND k AND f AND NOT u) AS duped, CAST(sum(n_bytes) AS BIGINT) AS bytes_read, CAST(sum(CASE WHEN a AND k AND f AND u THEN n_bytes ELSE 0 END) AS BIGINT) AS bytes_written FROM c"""
SOURCES = "src AS (SELECT * FROM (VALUES (1, 'alpha', '239.0.0.1', 5000, '0.0.0.0'), (2, 'beta', '239.0.0.1', 5000, '10.0.0.2'), (3, 'gamma', '239.0.0.1', 5001, '10.0.0.3'), (4, 'delta', '239.0.0.2', 5000, '10.0.0.1'), (5, 'omega', '239.0.0.2', 5000, '0.0.0.0')) t(position, name, group_ip, port, source_ip))"
ORACLES["admit_sources"] = f"""WITH {SOURCES},
k AS (SELECT event_id AS packet_id, '239.0.0.' || (user_id % 3 + 1) AS group_ip, event_id % 2 + 5000 AS port, '10.0.0.' || (event_id % 4 + 1) AS source_ip FROM events)
SELECT packet_id, arg_min(name, position) AS flow FROM k JOIN src ON k.group_ip = src.group_ip AND k.port = src.port AND (src.source_ip = k.source_ip OR src.source_ip = '0.0.0.0') GROUP BY packet_id"""
ORACLES["source_subscriptions"] = f"""WITH {SOURCES}, l AS (SELECT *, lag(group_ip) OVER (ORDER BY position) AS g, lag(port) OVER (ORDER BY position) AS q FROM src)
SELECT CAST(position AS INTEGER) AS position, name FROM l WHERE g IS NULL OR g <> group_ip OR q <> port"""
PLAIN = "SELECT seq, sac, sic, cat FROM p WHERE "
for _name, _where in {
    "filter_category_keep": "cat = 48", "filter_category_drop": "cat <> 48", "filter_category_signed": "cat <> 10", "filter_sensor_keep": "sac = 2 AND sic = 3",
    "filter_sensor_pair": "(sac = 1 AND sic = 2) OR (sac = 3 AND sic = 4)", "filter_sensor_excluded": "sac <> 2 OR sic <> 3", "filter_persisted": "cat IN (1, 48, 10, 19, 20)",
    "filter_time_of_day": "tod_stamp >= 81000 OR tod_stamp < 4560", "filter_polar_band": "theta BETWEEN 90 AND 180 AND rho BETWEEN 10 AND 200",
}.items():
    ORACLES[_name] = PLOTS + PLAIN + _where
ORACLES["filter_sensor_drop"] = PLOTS + "SELECT seq, sac, CASE WHEN seq % 9 <> 0 THEN sic END AS sic, cat FROM p WHERE NOT coalesce(sac = 2 AND CASE WHEN seq % 9 <> 0 THEN sic END = 3, FALSE)"
ORACLES["filter_ground_reframe"] = """WITH r AS (SELECT event_id AS seq, unnest(CASE WHEN event_id % 5 = 0 THEN [1] ELSE [0, 1, 2] END) AS k FROM events),
t AS (SELECT seq, k, printf('C1010214%02X%06X%04X', (seq + k) % 256, seq * 331 % 11059200, (seq + k) % 4 * 1024) AS rec FROM r WHERE (seq + k) % 4 NOT IN (1, 3))
SELECT seq, printf('30%04X', 3 + count(*) * 10) || string_agg(rec, '' ORDER BY k) AS payload FROM t GROUP BY seq"""
ORACLES["merge_recordings"] = """WITH t AS (SELECT event_id AS seq, CAST(event_id % 2 + 1 AS INTEGER) AS source, (event_id - event_id % 4) * 3.5::DOUBLE + 70000 AS t_abs FROM events),
z AS (SELECT *, floor(min(t_abs) OVER (PARTITION BY source) / 86400) * 86400 AS base FROM t)
SELECT row_number() OVER (ORDER BY t_abs - base, source DESC, seq) AS ordinal, source, seq, t_abs - base AS abs_tod FROM z"""
SENSOR = "SELECT event_id AS seq, user_id, CAST(user_id % 3 + 1 AS INTEGER) AS sac, CAST(user_id % 7 + 1 AS INTEGER) AS sic, event_id AS n, (event_id * 331 % 11059200) / 128.0::DOUBLE AS tod FROM events"
LENGTH_48 = 3 + 2 * (4 + 2 + 3 + 1 + 4 + 2 + 2 + 3 + 6 + 9 + 2 + 2 + 7)
ORACLES["sensor_list"] = f"""WITH s AS ({SENSOR}), b AS (SELECT sac, sic, 48 AS cat, {LENGTH_48} AS len FROM s UNION ALL SELECT sac, sic, 34, 10 FROM s)
SELECT cat, sac, sic, count(*) AS n_blocks, CAST(sum(len) AS BIGINT) AS n_bytes FROM b GROUP BY ALL"""
ORACLES["sensor_blocks"] = f"WITH s AS ({SENSOR}) SELECT 48 AS cat, {LENGTH_48} AS len, sac, sic FROM s UNION ALL SELECT 34, 10, sac, sic FROM s"
ORACLES["sensor_names"] = PLOTS + """, d AS (SELECT n_nationkey % 2 + 1 AS sac, n_nationkey // 2 + 1 AS sic, upper(substr(n_name, 1, 2)) AS sac_short, n_name AS sic_long FROM nation WHERE n_nationkey < 14)
SELECT seq, sac_short, sic_long FROM p LEFT JOIN d ON p.sac = d.sac AND p.sic = d.sic"""
ORACLES["sensor_names_whole"] = PLOTS + """, d AS (SELECT n_nationkey % 2 + 1 AS sac, n_nationkey // 2 + 1 AS sic, upper(substr(n_name, 1, 2)) AS sac_short, n_name AS sac_long, substr(n_name, 1, 3) AS sic_short, n_name AS sic_long FROM nation)
SELECT seq, sac_short, sac_long, sic_short, sic_long FROM p LEFT JOIN d ON p.sac = d.sac AND p.sic = d.sic"""
ORACLES["header_index"] = f"WITH s AS ({SENSOR}) SELECT seq, 48 AS cat, {LENGTH_48} AS len, sac, sic FROM s UNION ALL SELECT seq, 2, 10, sac, sic FROM s"
ORACLES["split_packets"] = f"SELECT event_id AS seq, CAST(i AS INTEGER) AS block_index, CASE WHEN i = 1 THEN 48 ELSE 34 END AS cat, CASE WHEN i = 1 THEN {LENGTH_48} ELSE 10 END AS len FROM events, range(3) t(i)"


def _message(types: str, code: str) -> str:
    return f"WITH s AS ({SENSOR}) SELECT seq, 0 AS rec_index, sac, sic, tod, CAST({code} AS INTEGER) AS type, {types} AS type_name FROM s"


ORACLES["decode_cat02"] = _message("CASE n % 2 WHEN 0 THEN 'NORTH' ELSE 'SECTOR' END", "n % 2 + 1")
ORACLES["decode_cat34"] = _message("CASE n % 2 WHEN 0 THEN 'NORTH' ELSE 'SECTOR' END", "n % 2 + 1")
ORACLES["decode_cat08"] = _message("CASE n % 2 WHEN 0 THEN 'SOP' ELSE 'EOP' END", "n % 2 + 254")
ORACLES["decode_cat19"] = _message("CASE n % 3 WHEN 0 THEN 'START_UPDATE' WHEN 1 THEN 'PERIODIC' ELSE 'EVENT' END", "n % 3 + 1")
FEET = "CAST(CASE WHEN n * 29 % 16384 >= 8192 THEN n * 29 % 16384 - 16384 ELSE n * 29 % 16384 END * 25 AS INTEGER)"
THETA = "(n * 7919 % 65536) * 360.0::DOUBLE / 65536.0::DOUBLE"
ORACLES["decode_cat01"] = f"""WITH s AS ({SENSOR}) SELECT seq, 0 AS rec_index, sac, sic, CAST(n % 4 AS INTEGER) AS type, (n * 104729 % 65536) / 128.0::DOUBLE AS rho, {THETA} AS theta, CAST(n * 13 % 4096 AS INTEGER) AS modea,
  (n * 13 % 65536) // 32768 = 1 AS modea_v, (n * 13 % 32768) // 16384 = 1 AS modea_g, (n * 13 % 16384) // 8192 = 1 AS modea_l, {FEET} AS modec, CAST(n % 127 AS INTEGER) AS responses, n % 2 = 1 AS flag_fixed,
  (n * 331 % 65536) / 128.0::DOUBLE AS tod_trunc FROM s"""
ORACLES["decode_cat10"] = f"""WITH s AS ({SENSOR}) SELECT seq, 0 AS rec_index, sac, sic, 1 AS type, CAST(n % 2 AS INTEGER) AS channel, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE 1 << (n % 8) END AS INTEGER) AS plot_type,
  (n * 104729 % 65536)::DOUBLE AS rho, {THETA} AS theta, CAST(user_id % 4096 AS INTEGER) AS track_number, tod FROM s"""
ORACLES["decode_cat20"] = f"""WITH s AS ({SENSOR}) SELECT seq, 0 AS rec_index, sac, sic, CAST(1 << (n % 7) AS INTEGER) AS type, (n * 911 % 2000000 - 1000000) / 2.0::DOUBLE AS x, (500000 - n * 577 % 1000000) / 2.0::DOUBLE AS y, tod FROM s"""
ORACLES["decode_cat21"] = f"""WITH s AS ({SENSOR}) SELECT seq, 0 AS rec_index, sac, sic, n % 2 = 1 AS flag_ground, n % 3 % 2 = 1 AS flag_sim, n % 5 % 2 = 1 AS flag_test, n % 7 % 2 = 1 AS flag_fixed, tod FROM s"""
ORACLES["decode_cat48"] = f"""WITH s AS ({SENSOR}), r AS (SELECT s.*, CAST(k AS INTEGER) AS k FROM s, range(2) t(k))
SELECT seq, k AS rec_index, sac, sic, CAST((n + k) % 8 AS INTEGER) AS type, (n * 104729 % 65536) / 256.0::DOUBLE AS rho, {THETA} AS theta, CAST((n + k) * 13 % 4096 AS INTEGER) AS modea, ((n + k) * 13 % 65536) // 32768 = 1 AS modea_v, {FEET} AS modec,
  printf('%06X', (n * 2654435 + k) % 16777216) AS modes, printf('IB%05d', n % 100000) AS aid, CAST(n % 8 AS INTEGER) AS com, CAST(n % 8 AS INTEGER) AS stat, CAST(n % 2 AS INTEGER) AS si, CAST(n % 16 AS INTEGER) AS b1b,
  CAST(n % 4096 AS INTEGER) AS track_number, tod FROM r"""
ORACLES["decode_counts"] = """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS cut FROM events)
SELECT 1 AS cat, n AS n_blocks, n AS n_records, 0::BIGINT AS n_malformed, FALSE AS ignored FROM c UNION ALL SELECT 48, n, 2 * n, 0, FALSE FROM c UNION ALL SELECT 62, n, 0, 0, TRUE FROM c UNION ALL SELECT 2, n, n, cut, FALSE FROM c"""
ORACLES["registers"] = "SELECT event_id AS seq, CAST(k AS INTEGER) AS rec_index, printf('%014X', event_id * 331 + 1) AS bds10 FROM events, range(2) t(k)"
RA = f"""WITH s AS ({SENSOR}), r AS (SELECT s.*, CAST(k AS INTEGER) AS k, n + k AS v FROM s, range(2) t(k))"""
ORACLES["decode_acas_ra"] = RA + """SELECT seq, k AS rec_index, CAST(v % 128 // 64 AS INTEGER) AS bds30_ara41, CAST(v % 2 AS INTEGER) AS bds30_ara47, CAST(v % 4 // 2 AS INTEGER) AS bds30_rac55, CAST(v % 2 AS INTEGER) AS bds30_rac56,
  CAST(v % 16 // 8 AS INTEGER) AS bds30_rac57, CAST(v % 8 // 4 AS INTEGER) AS bds30_rac58, CAST(v % 4 // 2 AS INTEGER) AS bds30_rat, CAST(v % 2 AS INTEGER) AS bds30_mte, CASE WHEN v % 2 = 1 THEN 1 ELSE 2 END AS bds30_tti,
  CASE WHEN v % 2 = 1 THEN printf('%06X', v * 7919 % 16777216) END AS bds30_tid, CASE WHEN v % 2 = 0 THEN CAST(v % 1000 * 100 - 1200 AS INTEGER) END AS bds30_tida, CASE WHEN v % 2 = 0 THEN CAST(v % 128 AS INTEGER) END AS bds30_tidr,
  CASE WHEN v % 2 = 0 THEN CAST(v % 64 AS INTEGER) END AS bds30_tidb FROM r"""
ORACLES["ras_upsert"] = RA + """SELECT sac, sic, floor(tod / 60) * 60 AS tod, printf('%06X', arg_max((n * 2654435 + k) % 16777216, n * 2 + k)) AS modes, arg_max(CASE WHEN v % 2 = 1 THEN 1 ELSE 2 END, n * 2 + k) AS bds30_tti FROM r GROUP BY sac, sic, floor(tod / 60) * 60"""
ORACLES["latest_capabilities"] = f"""WITH s AS ({SENSOR}), r AS (SELECT *, printf('%02X', n * 2654435 % 256) AS modes FROM s)
SELECT modes, CAST(arg_max(n % 8, n) AS INTEGER) AS com, CAST(arg_max(n % 2, n) AS INTEGER) AS si, CAST(arg_max(n % 16, n) AS INTEGER) AS b1b, printf('%014X', max(n) * 331 + 1) AS bds10 FROM r GROUP BY modes"""
ORACLES["latest_capabilities_whole"] = RA + """, m AS (SELECT *, printf('%06X', (n * 2654435 + k) % 16777216) AS modes, n * 2 + k AS place FROM r)
SELECT modes, CAST(arg_max(n % 8, place) AS INTEGER) AS com, CAST(arg_max(n % 2, place) AS INTEGER) AS si, CAST(arg_max(n % 16, place) AS INTEGER) AS b1b, printf('%014X', arg_max(n, place) * 331 + 1) AS bds10 FROM m GROUP BY modes"""
ORACLES["latest_capabilities_repeated"] = RA + """, m AS (SELECT *, printf('%03X', (n * 2654435 + k) % 4096) AS modes, n * 2 + k AS place FROM r)
SELECT modes, CAST(arg_max(n % 8, place) AS INTEGER) AS com, CAST(arg_max(n % 2, place) AS INTEGER) AS si, CAST(arg_max(n % 16, place) AS INTEGER) AS b1b, printf('%014X', arg_max(n, place) * 331 + 1) AS bds10 FROM m GROUP BY modes"""
ORACLES["truncated_time_asof"] = """WITH t AS (SELECT event_id AS seq, user_id % 3 AS s, event_type <> 'view' AS plot, event_id * 37 % 11059200 AS f, event_id % 5 * 20 AS late FROM events),
m AS (SELECT *, max(CASE WHEN NOT plot THEN seq END) OVER (PARTITION BY s ORDER BY seq) AS mark FROM t)
SELECT seq, CASE WHEN plot THEN 1 ELSE 2 END AS cat, CASE WHEN NOT plot THEN f / 128.0::DOUBLE WHEN mark IS NOT NULL THEN (f - late) / 128.0::DOUBLE END AS tod_full FROM m"""
ORACLES["dedup_4s"] = """WITH RECURSIVE x AS (SELECT event_id AS seq, event_id * 0.125::DOUBLE AS ts, (user_id % 11) || '/' || event_type AS k FROM events),
o AS (SELECT k, list(ts ORDER BY ts) AS l FROM x GROUP BY k),
r AS (SELECT k, l, l[1] AS ts FROM o UNION ALL SELECT k, l, list_filter(l, lambda y: y > r.ts + 4)[1] FROM r WHERE len(list_filter(l, lambda y: y > r.ts + 4)) > 0)
SELECT x.seq, x.ts FROM x JOIN r ON x.k = r.k AND x.ts = r.ts"""
ORACLES["dedup_keys"] = "SELECT event_id AS seq, md5((user_id % 11) || '/' || event_type) AS md5, CAST(length((user_id % 11) || '/' || event_type) AS INTEGER) AS n FROM events"
ORACLES["block_keys"] = "WITH x AS (SELECT event_id AS seq, (user_id % 11) || '/' || event_type AS p FROM events) SELECT seq, length(p) || ':' || sha256(p) AS key FROM x"
MARK = f"WITH s AS ({SENSOR}), b AS (SELECT seq, printf('22000AE0%02X%02X%02X%06X', sac, sic, n % 2 + 1, n * 331 % 11059200) AS body FROM s)"
LE = "printf('%02X%02X%02X%02X', {0} % 256, {0} // 256 % 256, {0} // 65536 % 256, {0} // 16777216)"
ORACLES["gps_v1_trailer"] = MARK + "SELECT seq, body || printf('11%02XB50A000A%06XCD', seq % 256, seq * 331 % 11059200) AS frame FROM b"
ORACLES["gps_v2_trailer"] = MARK + f"SELECT seq, body || {LE.format('(seq * 331 % 86400 * 1000)')} AS frame FROM b"
ORACLES["era_header"] = MARK + f"SELECT seq, '38000E00' || {LE.format('(1704067200 + seq * 331 % 86400)')} || body AS frame FROM b"
ORACLES["synthetic_mode_a"] = """WITH x AS (SELECT event_id AS seq, user_id AS t, event_id * 0.25::DOUBLE AS tod FROM events),
g AS (SELECT *, coalesce(NOT tod < lag(tod) OVER (PARTITION BY t ORDER BY seq) + 15, TRUE) AS fresh FROM x),
c AS (SELECT *, CASE WHEN fresh THEN count(*) FILTER (WHERE fresh) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS code FROM g)
SELECT seq, max(code) OVER (PARTITION BY t ORDER BY seq) AS modea FROM c"""
ORACLES["transcode_cat10_cat48"] = f"""WITH s AS ({SENSOR}) SELECT seq, 48 AS cat, sac, sic, floor((n * 104729 % 65536) / 1852.0::DOUBLE * 256) / 256 AS rho, {THETA} AS theta, 1000 AS modec, CAST(user_id % 4096 AS INTEGER) AS track_number, tod FROM s"""
ORACLES["reply_projection"] = """SELECT event_id AS seq, round((event_id % 7 * 400 + event_id // 50 % 5 * 60 + event_id % 2) * 50.0::DOUBLE / 1000 * 299.792458::DOUBLE / 1852 / 2, 6) AS dist, round((event_id % 1000 // 4 * 6) * 360.0::DOUBLE / 16384, 6) AS azimuth,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'C' END AS mode FROM events WHERE event_id % 13 <> 0"""
ORACLES["reply_clusters"] = """WITH r AS (SELECT event_id AS n, event_id // 1000 AS lap FROM events WHERE event_id % 13 <> 0),
c AS (SELECT lap, n % 7 AS d, n // 50 AS stay, min(n) AS head, count(*) AS replies FROM r GROUP BY ALL)
SELECT 'lap' || lap AS source, row_number() OVER (PARTITION BY lap ORDER BY head) - 1 AS cluster, replies - 1 AS n_followers FROM c QUALIFY replies >= 5"""
ORACLES["stream_reply_plots"] = """WITH r AS (SELECT event_id AS n, event_id // 1000 AS lap FROM events WHERE event_id % 13 <> 0),
c AS (SELECT lap, n % 7 AS d, n // 50 AS stay, min(n) AS head, count(*) AS replies FROM r GROUP BY ALL)
SELECT 'lap' || lap AS source, row_number() OVER (PARTITION BY lap ORDER BY head) - 1 AS cluster, head AS first_seq, replies - 1 AS n_followers FROM c
QUALIFY replies >= 5 AND (SELECT count(*) FROM events WHERE event_id = c.lap * 1000 + 999) > 0"""
CLOCK = "printf('%02d:%02d:%02d.%03d', ms_{0} // 3600000, ms_{0} // 60000 % 60, ms_{0} // 1000 % 60, ms_{0} % 1000)"
ORACLES["format_lines"] = PLOTS + f""", l AS (SELECT *, CAST(floor(tod * 1000) AS BIGINT) AS ms_tod, CAST(floor(tod_stamp * 1000) AS BIGINT) AS ms_stamp, CASE WHEN cat = 34 THEN 'NORTH' ELSE 'PSR' END AS tn FROM p WHERE cat IN (1, 48, 34))
SELECT seq, printf('CAT%02d [%d/%d] [%s]%s [AZI %.3f] [DST %.3f] [MODEA %s%s%s] [FL%03d%s] r%d [%s] [%s] (%.4f)', cat, sac, sic, tn, CASE WHEN flag_test THEN 'T' ELSE '' END, round(theta, 3), round(rho, 3),
  printf('%04o', modea), CASE WHEN seq % 5 = 0 THEN 'G' ELSE '' END, CASE WHEN seq % 3 = 0 THEN 'I' ELSE '' END, seq % 400, CASE WHEN seq % 7 = 0 THEN 'G' ELSE '' END, seq % 12,
  {CLOCK.format("tod")}, {CLOCK.format("stamp")}, round(delay, 4)) AS line FROM l"""
def _text(ms: str) -> str:
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


# Each event's block in a category of eight by its number; the reception is n % 50 / 128 s behind the measurement.
_SENSOR_TEXT = "printf('%d [%d/%d] ', seq, sac, sic)"
_TIMES = f"printf('[%s] [%s] (%.4f)', {_text('ms')}, {_text('stamp')}, n % 50 / 128.0::DOUBLE)"
_MARKS = "CASE WHEN {0} * 13 % 32768 // 16384 = 1 THEN 'G' ELSE '' END || CASE WHEN {0} * 13 % 65536 // 32768 = 1 THEN 'I' ELSE '' END || CASE WHEN {0} * 13 % 16384 // 8192 = 1 THEN 'S' ELSE '' END"
# Names of types as lines print them.
_LINES = {
    1: f"printf('[%s%s] [AZI %.3f] [DST %.3f] [MODEA %s%s] [FL%03d] r%d [na] (%.3f) [%s] (0.0000)', ['NODET', 'PSR', 'SSR', 'CMB'][n % 4 + 1], CASE WHEN n % 2 = 1 THEN 'TRN' ELSE '' END, {THETA}, (n * 104729 % 65536) / 128.0::DOUBLE, printf('%04o', n * 13 % 4096), {_MARKS.format('n')}, {FEET}, n % 127, (n * 331 % 65536) / 128.0::DOUBLE, {_text('stamp')})",
    2: f"printf('[%s] ', ['NORTE', 'SECTOR'][n % 2 + 1]) || {_TIMES}",
    10: f"printf('[PLOT] [%s %s] [AZI %.3f] [DST %.3f] ', CASE WHEN n % 5 = 0 THEN 'NODETEC' ELSE ['SSRM', 'SMMS', 'ADS', 'SMR', 'MAG', 'HFM', 'und', 'OTHER'][n % 8 + 1] END, ['CH1', 'CH2'][n % 2 + 1], {THETA}, (n * 104729 % 65536)::DOUBLE) || {_TIMES}",
    19: f"printf('[%s] ', ['UPDATE', 'PERIODIC', 'EVENT'][n % 3 + 1]) || {_TIMES}",
    20: f"printf('[%sCHN2] [X %.3f] [Y %.3f] ', ['OTHER_MAT', 'DME_MAT', 'UAT_MAT', 'VDL_MAT', 'HF_MLAT', 'MODES_MLAT', 'SSR_MLAT'][n % 7 + 1], (n * 911 % 2000000 - 1000000) / 2.0::DOUBLE, (500000 - n * 577 % 1000000) / 2.0::DOUBLE) || {_TIMES}",
    21: f"printf('[%s%s%s%s] ', CASE WHEN n % 5 % 2 = 1 THEN 'TEST' ELSE '' END, CASE WHEN n % 2 = 1 THEN 'GROUND' ELSE '' END, CASE WHEN n % 3 % 2 = 1 THEN 'SIM' ELSE '' END, CASE WHEN n % 7 % 2 = 1 THEN 'FIXED' ELSE '' END) || {_TIMES}",
    34: f"printf('[%s] ', ['NORTE', 'SECTOR'][n % 2 + 1]) || {_TIMES}",
    48: f"printf('[%s] [AZI %.3f] [DST %.3f] [AID IB%05d] [MS%06X] ', ['NODET', 'PSR', 'SSR', 'CMB', 'SSRSGEN', 'SSRSROL', 'CMBSGEN', 'CMBSROL'][(n + k) % 8 + 1], {THETA}, (n * 104729 % 65536) / 256.0::DOUBLE, n % 100000, (n * 2654435 + k) % 16777216) || {_TIMES}",
}
ORACLES["category_lines"] = f"""WITH s AS ({SENSOR}), c AS (SELECT *, [1, 2, 10, 19, 20, 21, 34, 48][n // 7 % 8 + 1] AS cat, (n * 331 % 11059200) * 1000 // 128 AS ms, (n * 331 + n % 50) % 11059200 * 1000 // 128 AS stamp FROM s),
r AS (SELECT *, CAST(k AS INTEGER) AS rec_index FROM c, range(2) t(k) WHERE k = 0 OR cat = 48)
SELECT seq, rec_index, {_SENSOR_TEXT} || CASE cat {" ".join(f"WHEN {c} THEN {x}" for c, x in _LINES.items())} END AS line FROM r"""
# A category's records hold those fields of a line that its layout has.
FIELDS = ("theta", "rho", "x", "y", "modea", "modea_v", "modea_g", "modea_l", "modec", "modes", "aid", "responses", "tod", "tod_trunc")
_theirs = {
    1: {"theta", "rho", "modea", "modea_v", "modea_g", "modea_l", "modec", "responses", "tod_trunc"}, 10: {"theta", "rho", "tod"}, 20: {"x", "y", "tod"}, 34: {"tod"},
    48: {"theta", "rho", "modea", "modea_v", "modec", "modes", "aid", "tod"},
}
# Names of types in the public format.
_made = {
    (1, "type_name"): "['NODET', 'PSR', 'SSR', 'CMB'][type + 1]", (10, "type_name"): "'TARGET'", (34, "type_name"): "type_name",
    (20, "type_name"): "CASE type WHEN 1 THEN 'OTHER' WHEN 2 THEN 'DME' WHEN 4 THEN 'UAT' WHEN 8 THEN 'VDL4' WHEN 16 THEN 'HF' WHEN 32 THEN 'MODE_S' WHEN 64 THEN 'NON_MODE_S' END",
    (48, "type_name"): "['NODET', 'PSR', 'SSR', 'CMB', 'SSRS_GEN', 'SSRS_ROLL', 'CMBS_GEN', 'CMBS_ROLL'][type + 1]", (1, "flag_fixed"): "flag_fixed",
    (48, "modea_g"): "((seq + rec_index) * 13 % 32768) // 16384 = 1", (48, "modea_l"): "((seq + rec_index) * 13 % 16384) // 8192 = 1",
}


def _records(cat: int) -> str:
    made = lambda c, none: _made.get((cat, c)) or (c if c in _theirs[cat] else none)
    fields = ", ".join(f"{made(c, 'NULL')} AS {c}" for c in FIELDS)
    return f"SELECT seq, rec_index, {cat} AS cat, sac, sic, {made('type_name', 'NULL')} AS type_name, {made('flag_fixed', 'FALSE')} AS flag_fixed, {fields} FROM ({ORACLES[f'decode_cat{cat:02d}']})"


ORACLES["format_lines_whole"] = PLOTS + f""", d AS ({" UNION ALL ".join(_records(c) for c in (1, 10, 20, 34, 48))}),
l AS (SELECT d.*, p.tod_stamp, CAST(floor(d.tod * 1000) AS BIGINT) AS ms_tod, CAST(floor(p.tod_stamp * 1000) AS BIGINT) AS ms_stamp,
  CASE WHEN p.tod_stamp - d.tod <= -86000 THEN p.tod_stamp - d.tod + 86400 WHEN p.tod_stamp - d.tod >= 85888 THEN p.tod_stamp - d.tod - 86400 ELSE p.tod_stamp - d.tod END AS delay FROM d JOIN p USING (seq, cat))
SELECT seq, rec_index, concat_ws(' ', printf('CAT%02d', cat), printf('[%d/%d]', sac, sic), '[' || type_name || CASE WHEN flag_fixed THEN 'TRN' ELSE '' END || ']' || CASE WHEN seq % 50 = 0 THEN 'T' ELSE '' END,
  printf('[AZI %.3f]', round(theta, 3)), CASE WHEN cat = 10 THEN printf('[DST %.0fm]', rho) ELSE printf('[DST %.3f]', round(rho, 3)) END, printf('[X %.1f]', x), printf('[Y %.1f]', y),
  '[MODEA ' || printf('%04o', modea) || CASE WHEN modea_g THEN 'G' ELSE '' END || CASE WHEN modea_v THEN 'I' ELSE '' END || CASE WHEN modea_l THEN 'S' ELSE '' END || ']',
  '[FL' || printf('%03d', CAST(floor(modec / 100) AS INTEGER)) || CASE WHEN seq % 7 = 0 THEN 'G' ELSE '' END || CASE WHEN seq % 11 = 0 THEN 'I' ELSE '' END || ']',
  printf('[%s]', modes), printf('<%s>', aid), printf('r%d', responses), CASE WHEN tod IS NULL THEN '[na]' ELSE '[' || {CLOCK.format("tod")} || ']' END, printf('(%.3f)', round(tod_trunc, 3)),
  '[' || {CLOCK.format("stamp")} || ']', printf('(%.4f)', round(delay, 4))) AS line FROM l"""
ORACLES["availability_statements"] = PLOTS + _windows(86400) + """SELECT printf('%03d_%03d_%03d', sac, sic, cat) AS sac_sic_cat, window_start AS timestamp,
  printf('REPLACE INTO availability3 (sac_sic_cat, region, timestamp, cuenta, max, min, media, stdev, p99) VALUES (''%03d_%03d_%03d'', ''north'', %d, %d, %.6f, %.6f, %.6f, %.6f, %.6f)', sac, sic, cat, window_start, cuenta, round(max, 3), round(min, 3), round(media, 3), round(stdev, 3), p99) AS sql FROM s"""
ORACLES["hex_dump"] = MARK + "SELECT seq, seq || 'a ' || regexp_replace(body, '(..)', '\\1 ', 'g') AS dump FROM b"
ORACLES["file_names"] = PLOTS + "SELECT us // 600000000 * 600 AS lap_start, count(*) AS n, strftime(make_timestamp(us // 600000000 * 600000000), '%m/%d/%y%m%d-north-%H%M%S.ast') AS name FROM p GROUP BY us // 600000000"
ORACLES["volume_by_part"] = (
    "WITH v AS (SELECT l_returnflag, l_linestatus, l_quantity / 8.0::DOUBLE - 3 AS delay FROM lineitem)" + _stats("l_returnflag, l_linestatus", "v") + f"SELECT l_returnflag, l_linestatus, cuenta, {R}, mode FROM s"
)
# Streams report windows that the watermark, ten seconds behind the last reception, has passed.
CLOSED = "WHERE window_start + {0} <= (SELECT max(us) FROM p) / 1000000.0::DOUBLE - 10"
ORACLES["stream_delay_windows"] = ORACLES["delay_windows_5min"] + " " + CLOSED.format(300)
ORACLES["stream_simple_windows"] = PLOTS + _windows(3600) + f"SELECT {WINDOW}, cuenta, media FROM s " + CLOSED.format(3600)
ORACLES["stream_dedup"] = ORACLES["dedup_4s"]
ORACLES["stream_full_times"] = ORACLES["truncated_time_asof"]
ORACLES["stream_live_statistics"] = PLOTS + _stats("sac, sic, cat", "p") + "SELECT sac, sic, cat, cuenta, max, min, media, mode, p99 FROM s"
ORACLES["stream_counters"] = ORACLES["pipeline_counters"]
# A delivery's mark is ten seconds before the latest event of all deliveries before it.
ORACLES["stream_late_windows"] = (
    PLOTS
    + """, b AS (SELECT quantile_cont(us, 0.25) AS e1, quantile_cont(us, 0.5) AS e2, quantile_cont(us, 0.75) AS e3 FROM p),
o AS (SELECT p.*, (us > e1)::INTEGER + (us > e2)::INTEGER + (us > e3)::INTEGER AS own FROM p, b),
f AS (SELECT *, CASE WHEN own < 2 AND seq % 7 = 0 THEN own + 2 ELSE own END AS file FROM o),
k AS (SELECT file, max(max(us)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 1000000.0::DOUBLE - 10 AS mark FROM f GROUP BY file),
w AS (SELECT f.*, sec // 3600 * 3600 AS window_start, coalesce(ts < mark, FALSE) AS late FROM f JOIN k USING (file))"""
    + _stats(WINDOW, "w")
    + f""", l AS (SELECT {WINDOW}, CAST(sum(late::INTEGER) AS BIGINT) AS n_late FROM d GROUP BY ALL)
SELECT {WINDOW}, n_late, cuenta, media, mode, p99 FROM s JOIN l USING ({WINDOW}) """
    + CLOSED.format(3600)
)
READ = f"""WITH s AS ({SENSOR}), r AS (SELECT *, CAST(seq // 5000 AS INTEGER) AS part, row_number() OVER (PARTITION BY seq // 5000 ORDER BY seq) - 1 AS k,
  ((n * 331 + 5) % 11059200) / 128.0::DOUBLE AS at_s, printf('22000AE0%02X%02X%02X%06X', sac, sic, n % 2 + 1, n * 331 % 11059200) AS payload FROM s)
SELECT part, k AS seq, 34 AS cat, sac, sic, {{0}} AS recv_tod, {{1}} AS src_ip, payload FROM r"""
NO_IP, NO_TIME = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
for _format, _time, _ip in (("ast", NO_TIME, NO_IP), ("hensoldt", NO_TIME, NO_IP), ("gps1", "at_s", "'10.0.0.7'"), ("gps2", "floor(at_s)", NO_IP), ("era", "floor(at_s)", NO_IP)):
    ORACLES[f"read_{_format}"] = READ.format(_time, _ip)
ORACLES["read_light_ranges"] = f"""WITH s AS ({SENSOR})
SELECT CAST(seq // 5000 AS INTEGER) AS part, row_number() OVER (PARTITION BY seq // 5000 ORDER BY seq) - 1 AS seq, 48 AS cat, 97 AS len, sac, sic, ((n * 331 + 5) % 11059200) / 128.0::DOUBLE AS recv_tod FROM s"""
ORACLES["latency_report"] = (
    f"""WITH s AS ({SENSOR}), p AS (SELECT sac, sic, 48 AS cat, (n % 50) / 128.0::DOUBLE AS delay, CAST((n * 331 + n % 50) // 128 AS BIGINT) + 1704067200 AS sec, (n * 331 + n % 50) / 128.0::DOUBLE + 1704067200 AS ts FROM s, range(2) t(k))"""
    + _windows(300) + f"SELECT printf('%03d_%03d_%03d', sac, sic, cat) AS sac_sic_cat, 'north' AS region, window_start AS timestamp, cuenta, {R} FROM s2 WHERE window_start + 300 <= (SELECT max(ts) FROM p)"
).replace("s AS (SELECT g.*", "s2 AS (SELECT g.*")
ORACLES["statistics_admission"] = f"SELECT seq, type, plot_type FROM ({ORACLES['decode_cat10']}) WHERE (type = 1 AND plot_type <> 0) OR type = 2"

ORACLES["truncated_time_turn"] = ORACLES["truncated_time_asof"].replace("event_id * 37 % 11059200 AS f", "(event_id * 37 + 11059200 - 18500) % 11059200 AS f").replace("(f - late) /", "((f - late + 11059200) % 11059200) /")
ORACLES["availability_statements_dated"] = ORACLES["availability_statements"].replace("p99) VALUES", "p99, insert_date) VALUES").replace("%.6f)'", "%.6f, NOW())'")
ORACLES["ras_statements"] = RA + """SELECT seq, k AS rec_index,
  'REPLACE INTO ras (sac, sic, modea, modea_v, modea_g, modea_l, modec, modec_v, modec_g, modes, aid, rho, theta, tod, tod_stamp, lat, lon, di48_230_com, di48_230_stat, di48_230_si, di48_230_mssc, di48_230_arc, di48_230_aic, di48_230_b1a, di48_230_b1b, bds30_ara41, bds30_ara42, bds30_ara43, bds30_ara44, bds30_ara45, bds30_ara46, bds30_ara47, bds30_rac55, bds30_rac56, bds30_rac57, bds30_rac58, bds30_rat, bds30_mte, bds30_tti, bds30_tid, bds30_tida, bds30_tidr, bds30_tidb, bds00, bds10, bds17, bds30, bds40, bds50, bds60, insert_date) VALUES ('
  || printf('%d, %d, ''%04o'', %d, NULL, NULL, NULL, NULL, NULL, ''%06X'', ''IB%05d'', NULL, NULL, %.4f, NULL, NULL, NULL, ', sac, sic, v * 13 % 4096, v * 13 % 65536 // 32768, (n * 2654435 + k) % 16777216, n % 100000, floor(tod) + 1704067200)
  || printf('%d, %d, %d, NULL, NULL, NULL, NULL, %d, ', n % 8, n % 8, n % 2, n % 16)
  || printf('%d, NULL, NULL, NULL, NULL, NULL, %d, %d, %d, %d, %d, %d, %d, ', v % 128 // 64, v % 2, v % 4 // 2, v % 2, v % 16 // 8, v % 8 // 4, v % 4 // 2, v % 2)
  || CASE WHEN v % 2 = 1 THEN printf('1, ''%06X'', NULL, NULL, NULL, ', v * 7919 % 16777216) ELSE printf('2, NULL, %d, %d, %d, ', v % 1000 * 100 - 1200, v % 128, v % 64) END
  || 'NULL, NULL, NULL, NULL, NULL, NULL, NULL, NOW())' AS sql FROM r"""
ORACLES["decode_recorded_without_cat21"] = f"WITH s AS ({SENSOR}) SELECT seq, 34 AS cat, sac, sic FROM s"
ORACLES["read_reply_records"] = """WITH r AS (SELECT CAST(event_id // 1000 AS INTEGER) AS lap, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS seq, event_id AS n FROM events)
SELECT lap, seq, printf('%04X%04X%04X%04X', n % 7 * 400 + n // 50 % 5 * 60 + n % 2, n % 1000 // 4 * 6, CASE WHEN n % 2 = 0 THEN 2816 ELSE 3328 END, CASE WHEN n % 13 = 0 THEN 0 ELSE 8 END) AS tail FROM r WHERE seq < 170"""
ORACLES["gps_clock_lines"] = "SELECT event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S') END AS clock FROM events"
