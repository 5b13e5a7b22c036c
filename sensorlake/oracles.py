"""DuckDB SQL of the queries, written another way than the operators where there is one: windows there, joins here."""

from __future__ import annotations

TURN, COUNTER, TICKS, JUMP, ROWS, CARRY, DEVIATION = 4294967296, 256, 15625, 2147483648, 8, 3, 144000 * 15625


def fitted(name: str, source: str, keys: str) -> str:
    """Pairs of ``source`` that are used, and the clock fits per ``keys``: CTEs <name>pair1, <name>pairs, <name>fits0 and <name>fits."""
    of = lambda alias: ", ".join(f"{alias}.{k}" for k in keys.split(", "))
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    stray = lambda c: f"3 * power(4 * a.{c}::HUGEINT - sum(b.{c}::HUGEINT), 2)::HUGEINT > 4 * (4 * sum(b.{c}::HUGEINT * b.{c}) - sum(b.{c}::HUGEINT) * sum(b.{c}::HUGEINT))"
    x, y = "(micros - x0)::DOUBLE", "(utc_second - y0)::DOUBLE"
    return f"""{name}pair1 AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "offset") AS at, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{name}stray AS (
  SELECT {of("a")}, a."offset", a.micros, a.utc_second, a.n, a.n >= 5 AND coalesce({stray("micros")} OR {stray("utc_second")}, false) AS stray
  FROM {name}pair1 a LEFT JOIN {name}pair1 b ON {same} AND a.at <> b.at
    AND b.at BETWEEN CASE WHEN a.at <= 2 THEN 1 WHEN a.at > a.n - 2 THEN a.n - 4 ELSE a.at - 2 END AND CASE WHEN a.at <= 2 THEN 5 WHEN a.at > a.n - 2 THEN a.n ELSE a.at + 2 END
  GROUP BY {of("a")}, a."offset", a.micros, a.utc_second, a.n),
{name}pairs AS (
  SELECT {keys}, "offset", micros, utc_second, n < 7 OR kept < 2 OR NOT stray AS used
  FROM (SELECT *, count(*) FILTER (NOT stray) OVER (PARTITION BY {keys}) AS kept FROM {name}stray)),
{name}fits0 AS (
  SELECT {keys}, count(*) AS n_pairs, count(*) FILTER (used) AS n_pairs_used, min(micros) AS x0, min(utc_second) AS y0 FROM {name}pairs GROUP BY {keys}),
{name}fits AS (
  SELECT {of("a")}, a.n_pairs, a.n_pairs_used, regr_slope({y}, {x}) AS slope,
         any_value(y0) + regr_intercept({y}, {x}) - regr_slope({y}, {x}) * any_value(x0) AS intercept, regr_r2({y}, {x}) AS r_squared
  FROM {name}fits0 a JOIN {name}pairs b ON {same} WHERE used AND n_pairs >= 2 GROUP BY {of("a")}, a.n_pairs, a.n_pairs_used HAVING max(utc_second) > min(utc_second) AND max(micros) > min(micros))"""


BASE = f"""
WITH RECURSIVE log AS (
  SELECT user_id AS file_id, epoch_us(ts) AS "offset", CASE event_type WHEN 'error' THEN 'PPS' WHEN 'signup' THEN 'GNSS' ELSE 'IMU' END AS kind,
         (epoch_us(ts) // 64) % {TURN} AS micros_reading, event_id % 256 AS counter,
         floor(value * 100)::BIGINT AS acc_x, floor(value * 10)::BIGINT % 50 AS acc_y, event_id % 17 AS acc_z,
         floor(value)::BIGINT AS gyr_x, event_id * 7 % 23 AS gyr_y, event_id % 5 AS gyr_z,
         500000000 + floor(value * 1000)::BIGINT AS latitude, -70000000 + event_id % 1000 AS longitude,
         floor(value * 3)::BIGINT AS ned_vel_north, event_id % 101 AS ned_vel_east, event_id % 7 AS ned_vel_down,
         epoch_us(ts) // 1000000 AS posix_timestamp, epoch_us(ts) % 1000000 AS microseconds, value
  FROM events),
imu0 AS (
  SELECT *, micros_reading - lag(micros_reading) OVER (PARTITION BY file_id ORDER BY "offset") AS step FROM log WHERE kind = 'IMU'),
imu1 AS (
  SELECT *, coalesce(step < 0 OR step > {JUMP}, false) AS imu_jump,
         sum(coalesce(step < 0 OR step > {JUMP}, false)::INT) OVER (PARTITION BY file_id ORDER BY "offset") AS island FROM imu0),
imu2 AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, island ORDER BY "offset") AS rn FROM imu1),
imu3 AS (
  SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY island, (rn - 1) // {ROWS}) - 1 AS s FROM imu2),
seg AS (
  SELECT * EXCLUDE (s, rn), (coalesce(last_value(s IGNORE NULLS) OVER w, 0) + CASE WHEN kind <> 'IMU' AND last_value(rn IGNORE NULLS) OVER w % {ROWS} = 0 THEN 1 ELSE 0 END)::INTEGER AS segment
  FROM (SELECT l.*, i.s, i.rn FROM log l LEFT JOIN imu3 i ON l.file_id = i.file_id AND l."offset" = i."offset")
  WINDOW w AS (PARTITION BY file_id ORDER BY "offset" ROWS UNBOUNDED PRECEDING)),
rel0 AS (
  SELECT *, row_number() OVER w AS nth,
         coalesce(lag(micros_reading) OVER w - micros_reading > 0.25 * {TURN}, false) AS wrap,
         coalesce(lag(counter) OVER w - counter > 0.25 * {COUNTER}, false) AS cwrap
  FROM seg WINDOW w AS (PARTITION BY file_id, segment, kind ORDER BY "offset")),
rel AS (
  SELECT *, micros_reading + {TURN} * sum(wrap::INT) OVER w AS mrel, counter + {COUNTER} * sum(cwrap::INT) OVER w AS crel
  FROM rel0 WINDOW w AS (PARTITION BY file_id, segment, kind ORDER BY "offset" ROWS UNBOUNDED PRECEDING)),
summary AS (
  SELECT file_id, segment, row_number() OVER (PARTITION BY file_id ORDER BY segment) AS k,
         {", ".join(f"count(*) FILTER (kind = '{s}') AS n_{c}, arg_min(micros_reading, \"offset\") FILTER (kind = '{s}') AS f_{c}, arg_max(micros_reading, \"offset\") FILTER (kind = '{s}') AS l_{c}, coalesce(sum(wrap::INT) FILTER (kind = '{s}'), 0)::BIGINT AS w_{c}, (min(mrel) FILTER (kind = '{s}'))::BIGINT AS lo_{c}, (max(mrel) FILTER (kind = '{s}'))::BIGINT AS hi_{c}" for s, c in (("PPS", "p"), ("GNSS", "g"), ("IMU", "i")))},
         arg_min(counter, "offset") FILTER (kind = 'IMU') AS f_c, arg_max(counter, "offset") FILTER (kind = 'IMU') AS l_c, coalesce(sum(cwrap::INT) FILTER (kind = 'IMU'), 0)::BIGINT AS w_c
  FROM rel GROUP BY file_id, segment),
state AS (
  SELECT DISTINCT file_id, 0::BIGINT AS k, NULL::INTEGER AS segment, {", ".join(f"0::BIGINT AS o_{c}, NULL::BIGINT AS v_{c}, 0::BIGINT AS s_{c}, false AS t_{c}" for c in "pgic")}, true AS ok FROM log
  UNION ALL
  SELECT file_id, k, segment, {", ".join(f"(CASE WHEN ok AND n_{'i' if c == 'c' else c} >= {CARRY} THEN s_{c} + w_{c} * {COUNTER if c == 'c' else TURN} ELSE 0 END)::BIGINT, (CASE WHEN ok AND n_{'i' if c == 'c' else c} >= {CARRY} THEN l_{c} END)::BIGINT, s_{c}, t_{c}" for c in "pgic")}, ok
  FROM (SELECT *, coalesce(greatest(lo_p + s_p, lo_g + s_g, lo_i + s_i) - least(lo_p + s_p, lo_g + s_g, lo_i + s_i) <= {DEVIATION}
                       AND greatest(hi_p + s_p, hi_g + s_g, hi_i + s_i) - least(hi_p + s_p, hi_g + s_g, hi_i + s_i) <= {DEVIATION}, true) AS ok
        FROM (SELECT y.*, {", ".join(f"(x.o_{c} + CASE WHEN x.v_{c} - y.f_{c} > 0.25 * {COUNTER if c == 'c' else TURN} THEN {COUNTER if c == 'c' else TURN} ELSE 0 END)::BIGINT AS s_{c}, coalesce(x.v_{c} - y.f_{c} > 0.25 * {COUNTER if c == 'c' else TURN}, false) AS t_{c}" for c in "pgic")}
              FROM state x JOIN summary y ON x.file_id = y.file_id AND y.k = x.k + 1))),
unw AS (
  SELECT r.*, s.ok,
         (r.mrel + CASE kind WHEN 'PPS' THEN s_p WHEN 'GNSS' THEN s_g ELSE s_i END)::BIGINT AS micros_reading_unwrapped,
         CASE WHEN kind = 'IMU' THEN (r.crel + s_c)::BIGINT END AS counter_unwrapped,
         wrap OR (nth = 1 AND CASE kind WHEN 'PPS' THEN t_p WHEN 'GNSS' THEN t_g ELSE t_i END) AS micros_reading_wrap,
         kind = 'IMU' AND (cwrap OR (nth = 1 AND t_c)) AS counter_wrap
  FROM rel r JOIN state s ON r.file_id = s.file_id AND r.segment = s.segment),
near AS (
  SELECT * FROM (
    SELECT p.file_id, p.segment, p."offset", p.micros_reading_unwrapped AS micros, g.micros_reading_unwrapped AS gnss_micros,
           g.posix_timestamp + g.microseconds / 1e6 AS gnss_utc,
           row_number() OVER (PARTITION BY p.file_id, p."offset" ORDER BY abs(g.micros_reading_unwrapped - p.micros_reading_unwrapped), g.micros_reading_unwrapped, g."offset") AS best
    FROM unw p LEFT JOIN unw g ON g.kind = 'GNSS' AND p.file_id = g.file_id AND p.segment = g.segment WHERE p.kind = 'PPS') WHERE best = 1),
whole AS (
  SELECT *, (micros_reading + {TURN} * coalesce(sum(back::INT) OVER (PARTITION BY file_id, kind ORDER BY "offset" ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS m
  FROM (SELECT *, coalesce(lag(micros_reading) OVER (PARTITION BY file_id, kind ORDER BY "offset") - micros_reading > 0.25 * {TURN}, false) AS back FROM log)),
pair0 AS (
  SELECT * FROM (
    SELECT p.file_id, p."offset", p.m AS micros, round_even(g.posix_timestamp + g.microseconds / 1e6 + (p.m - g.m) / {TICKS}, 0)::BIGINT AS utc_second,
           row_number() OVER (PARTITION BY p.file_id, p."offset" ORDER BY abs(g.m - p.m), g.m, g."offset") AS best
    FROM whole p JOIN whole g ON g.kind = 'GNSS' AND p.file_id = g.file_id WHERE p.kind = 'PPS') WHERE best = 1),
{fitted("", "pair0", "file_id")},
spair0 AS (
  SELECT file_id, segment, "offset", micros, round_even(gnss_utc + (micros - gnss_micros) / {TICKS}, 0)::BIGINT AS utc_second FROM near WHERE gnss_micros IS NOT NULL),
{fitted("s", "spair0", "file_id, segment")},
sgrade AS (
  SELECT file_id, segment, count(*) FILTER (kind = 'PPS') AS n_pps, count(*) FILTER (kind = 'GNSS') AS n_gnss, count(*) FILTER (kind = 'IMU') AS n_imu,
         coalesce(bool_and(ok) AND any_value(slope) IS NOT NULL AND any_value(r_squared) >= 0.99 AND coalesce(max(abs(utc - round_even(utc, 0))) FILTER (kind = 'PPS'), 0) <= 0.2, false) AS valid
  FROM (SELECT u.file_id, u.segment, u.kind, u.ok, f.slope, f.r_squared, f.slope * u.micros_reading_unwrapped + f.intercept AS utc
        FROM unw u LEFT JOIN sfits f ON u.file_id = f.file_id AND u.segment = f.segment) GROUP BY file_id, segment),
skeep AS (
  SELECT *, NOT (max(n_gnss) OVER w > 0 AND count(*) OVER w > 1 AND (n_pps < 2 OR n_gnss < 1 OR NOT valid)) AS keep FROM sgrade WINDOW w AS (PARTITION BY file_id)),
fake AS (
  SELECT file_id, segment, count(*) FILTER (kind = 'PPS') AS n_pps, count(*) FILTER (kind = 'GNSS') AS n_gnss, count(*) FILTER (kind = 'IMU') AS n_imu,
         sum(acc_x)::BIGINT AS a, sum(counter)::BIGINT AS c FROM seg GROUP BY file_id, segment),
grades AS (
  SELECT *, n_pps >= 1 AND n_gnss >= 1 AND 1 - (a % 40) / 1000 >= 0.99 AND (c % 30) / 100 <= 0.2 AND c % 7 > 0 AS regression_valid FROM fake),
reasons AS (
  SELECT *, CASE WHEN max(n_gnss) OVER w = 0 OR count(*) OVER w = 1 THEN NULL WHEN n_pps < 2 OR n_gnss < 1 THEN 'small' WHEN NOT regression_valid THEN 'poor' END AS skip_reason
  FROM grades WINDOW w AS (PARTITION BY file_id)),
filtered AS (
  SELECT r.*, skip_reason IS NULL AS keep, CASE WHEN skip_reason IS NULL THEN (SELECT count(*) FROM reasons q WHERE q.file_id = r.file_id AND q.segment < r.segment AND q.skip_reason IS NULL) END AS segment_out FROM reasons r),
odd AS (
  SELECT file_id, "offset", CASE WHEN counter % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS v, row_number() OVER (PARTITION BY file_id ORDER BY "offset") AS at, count(*) OVER (PARTITION BY file_id) AS n FROM log WHERE kind = 'IMU'),
heard AS (
  SELECT file_id AS device, kind, "offset" // 86400000000 * 86400000000 AS window_start, count(*) AS n FROM log GROUP BY ALL),
rate AS (
  SELECT w.device, w.kind, w.window_start, coalesce(h.n, 0) AS n
  FROM (SELECT device, k.kind, unnest(range(min(window_start), max(window_start) + 1, 86400000000)) AS window_start FROM heard, (VALUES ('IMU'), ('GNSS'), ('PPS')) k(kind) GROUP BY device, k.kind) w
  LEFT JOIN heard h ON w.device = h.device AND w.kind = h.kind AND w.window_start = h.window_start)
"""


def neighbours(source: str, keys: str, columns: list[str], sigma: int, least: int = 5) -> str:
    """The local test by a join of each row with its six neighbours."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    test = ", ".join(f"a.n >= {least} AND a.n >= 7 AND (5 * power(6 * a.{c}::HUGEINT - sum(b.{c}::HUGEINT), 2)::HUGEINT > {sigma * sigma * 6} * (6 * sum(b.{c}::HUGEINT * b.{c}) - sum(b.{c}::HUGEINT) * sum(b.{c}::HUGEINT))) AS {c}_stdchecked" for c in columns)
    listed = ", ".join(f"a.{c}" for c in columns)
    return f"""(SELECT {", ".join("a." + k for k in keys.split(", "))}, a."offset", {test}
      FROM (SELECT *, row_number() OVER w AS at, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY "offset")) a
      LEFT JOIN (SELECT *, row_number() OVER w AS at FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY "offset")) b
        ON {same} AND a.at <> b.at AND b.at BETWEEN CASE WHEN a.at <= 3 THEN 1 WHEN a.at > a.n - 3 THEN a.n - 6 ELSE a.at - 3 END AND CASE WHEN a.at <= 3 THEN 7 WHEN a.at > a.n - 3 THEN a.n ELSE a.at + 3 END
      GROUP BY {", ".join("a." + k for k in keys.split(", "))}, a."offset", a.n, {listed})"""


SIX = ["acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z"]
IMU_SEG = "(SELECT * FROM seg WHERE kind = 'IMU')"
IMU_LOG = "(SELECT * FROM log WHERE kind = 'IMU')"
LATE = "CASE WHEN counter % 5 > 0 THEN \"offset\" / 1e6 END"
HEADER_CHARS = len("Log start OLA ISM330DHCX SAM-M10Q logger\n\nFirmware commit ID: \nISM330DHCX Acc sensitivity (mg/LSB): 0.061000\nISM330DHCX Gyr sensitivity (mdps/LSB): 4.375000\nISM330DHCX ODR (Hz): 417.00\nGNSS update rate (Hz): 10\n")
#: Sizes of frames; the header is followed by a commit of "c" and the device's number.
SIZE = "CASE kind WHEN 'PPS' THEN 8 WHEN 'GNSS' THEN 40 ELSE 24 END"
FOOTER_BYTES = len("\n\nLog stop OLA ISM330DHCX SAM-M10Q logger\n")
HEAD = f"({HEADER_CHARS} + 1 + length(file_id::VARCHAR))"

FINAL = {
    "file_names": "SELECT file_id, 'lake/BOOT_' || lpad(file_id::VARCHAR, 6, '0') || '/DATA_BOOT_' || lpad(file_id::VARCHAR, 6, '0') || '_TIME_' || strftime(make_timestamp(min(\"offset\")), '%Y%m%dT%H%M%S') || '.dat' AS path, file_id AS boot_id, strftime(make_timestamp(min(\"offset\")), '%Y-%m-%d %H:%M:%S') AS file_start FROM log GROUP BY file_id",
    "file_headers": f"SELECT DISTINCT file_id, 0.061::DOUBLE AS acc_sensitivity, 4.375::DOUBLE AS gyr_sensitivity, 417.0::DOUBLE AS imu_odr, 10.0::DOUBLE AS gnss_rate, 'c' || file_id AS firmware_commit, {HEAD} AS header_chars FROM log",
    "decoded_frames": f"""SELECT file_id, kind, ({HEAD} + coalesce(sum({SIZE}) OVER (PARTITION BY file_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", micros_reading,
        CASE WHEN kind = 'IMU' THEN counter ELSE -1 END AS counter, CASE WHEN kind = 'IMU' THEN (acc_x + 32768) % 65536 - 32768 ELSE -1 END AS acc_x, CASE WHEN kind = 'IMU' THEN acc_y ELSE -1 END AS acc_y, CASE WHEN kind = 'IMU' THEN gyr_z ELSE -1 END AS gyr_z,
        CASE WHEN kind = 'GNSS' THEN latitude ELSE -1 END AS latitude, CASE WHEN kind = 'GNSS' THEN longitude ELSE -1 END AS longitude, CASE WHEN kind = 'GNSS' THEN posix_timestamp ELSE -1 END AS posix_timestamp, CASE WHEN kind = 'GNSS' THEN microseconds ELSE -1 END AS microseconds, CASE WHEN kind = 'GNSS' THEN ned_vel_east ELSE -1 END AS ned_vel_east, CASE WHEN kind = 'GNSS' THEN 3::BIGINT ELSE -1 END AS fix_type FROM log""",
    "file_audit": f"""SELECT file_id, ({HEAD} + sum({SIZE}) + {FOOTER_BYTES})::BIGINT AS file_bytes, ({HEAD} + sum({SIZE}))::BIGINT AS parsed_bytes, true AS footer_found, 'complete' AS status, count(*) FILTER (kind = 'PPS') AS n_pps, count(*) FILTER (kind = 'GNSS') AS n_gnss, count(*) FILTER (kind = 'IMU') AS n_imu,
        round(({HEAD} + sum({SIZE})) / ({HEAD} + sum({SIZE}) + {FOOTER_BYTES}), 6) AS share_parsed, round(({HEAD} + sum({SIZE})) / count(*), 6) AS bytes_per_frame FROM log GROUP BY file_id""",
    "combined_segments": "SELECT file_id, segment AS segment_out, \"offset\", acc_x, 0.061::DOUBLE AS acc_sensitivity, 417.0::DOUBLE AS imu_odr FROM seg WHERE kind = 'IMU'",
    "scaled_imu": "SELECT file_id, \"offset\", " + ", ".join(f"round({c} * {k}::DOUBLE, 6) AS {c}_{u}" for c, k, u in [(f"acc_{a}", 0.061, "mg") for a in "xyz"] + [(f"gyr_{a}", 8.75, "mdps") for a in "xyz"]) + " FROM log WHERE kind = 'IMU'",
    "scaled_gnss": "SELECT file_id, \"offset\", round(latitude / 1e7, 6) AS latitude_dd, round(longitude / 1e7, 6) AS longitude_dd, ned_vel_north AS ned_vel_north_mmps, posix_timestamp * 1000000 + microseconds AS datetime_utc_micros FROM log WHERE kind = 'GNSS'",
    "gnss_posix_seconds": "SELECT file_id, \"offset\", round(posix_timestamp + microseconds / 1e6, 6) AS posix_seconds FROM log WHERE kind = 'GNSS'",
    "calendar": """SELECT file_id, "offset", year(t) AS year, month(t) AS month, day(t) AS day, second(t) AS second, strftime(t, '%Y-%m-%dT%H:%M:%S') AS iso, posix_timestamp AS back,
        counter % 35 BETWEEN 1 AND day(last_day(t)) AS valid_day, dayofyear(make_date(1900 + counter, 12, 31)) = 366 AS leap FROM (SELECT *, make_timestamp(posix_timestamp * 1000000) AS t FROM log)""",
    "next_file_boundary": "SELECT file_id, posix_timestamp // 900 * 900 + 900 AS boundary, count(*) AS n FROM log GROUP BY ALL",
    "normalized_index": "SELECT file_id, kind, \"offset\", round((row_number() OVER (PARTITION BY file_id, kind ORDER BY \"offset\") - 1) / count(*) OVER (PARTITION BY file_id, kind), 6) AS normalized_index FROM log",
    "utc_micros": "SELECT file_id, \"offset\", CASE WHEN counter % 5 > 0 THEN \"offset\" ELSE -1 END AS utc_micros, counter % 5 > 0 AS utc_valid FROM log",
    "relative_time": "SELECT file_id, kind, \"offset\", round(\"offset\" / 1e6 - min(\"offset\") OVER (PARTITION BY file_id, kind) / 1e6, 6) AS relative_time FROM log",
    "outlier_masks": f"SELECT file_id, \"offset\", acc_x_stdchecked OR acc_y_stdchecked OR acc_z_stdchecked AS acc_outlier, gyr_x_stdchecked OR gyr_y_stdchecked OR gyr_z_stdchecked AS gyr_outlier FROM {neighbours(IMU_LOG, 'file_id', SIX, 3)}",
    "imu_jumps": "SELECT file_id, \"offset\", imu_jump FROM imu1",
    "assigned_segments": "SELECT file_id, \"offset\", kind, segment FROM seg",
    "unwrapped_counter": "SELECT file_id, segment, kind, \"offset\", mrel::BIGINT AS micros_reading_unwrapped, wrap FROM rel",
    "carried_state": "SELECT file_id, segment, s_p AS pps_start, s_g AS gnss_start, s_i AS imu_start, s_c AS counter_start, t_p AS pps_turned, t_g AS gnss_turned, t_i AS imu_turned, t_c AS counter_turned, ok AS consistency_ok FROM state WHERE k > 0",
    "carried_unwrap": "SELECT file_id, segment, kind, \"offset\", micros_reading_unwrapped, coalesce(counter_unwrapped, -1) AS counter_unwrapped, micros_reading_wrap, counter_wrap FROM unw",
    "wrap_positions": "SELECT file_id, segment, kind, nth - 1 AS index FROM unw WHERE micros_reading_wrap",
    "jump_positions": f"""SELECT file_id, segment, field, nth - 1 AS index, step FROM (
        SELECT file_id, segment, 'counter' AS field, nth, counter_unwrapped - lag(counter_unwrapped) OVER w AS step, 1 AS most FROM unw WHERE kind = 'IMU' WINDOW w AS (PARTITION BY file_id, segment ORDER BY "offset")
        UNION ALL SELECT file_id, segment, 'micros_reading', nth, micros_reading_unwrapped - lag(micros_reading_unwrapped) OVER w, 0.1 * {TURN} FROM unw WHERE kind = 'IMU' WINDOW w AS (PARTITION BY file_id, segment ORDER BY "offset")) WHERE step < 0 OR step > most""",
    "consecutive_dt": f"SELECT file_id, kind, \"offset\", round((micros_reading - lag(micros_reading) OVER w) * 1000 / {TICKS}, 6) AS dt_raw_ms, round((\"offset\" / 1e6 - lag(\"offset\" / 1e6) OVER w) * 1000.0::DOUBLE, 2) AS dt_utc_ms FROM log WINDOW w AS (PARTITION BY file_id, kind ORDER BY \"offset\")",
    "counter_gaps": """SELECT file_id, "offset", step, step > 200 AS is_wrap, CASE WHEN step <= 200 THEN step - 1 ELSE 0 END AS missed FROM (
        SELECT file_id, "offset", CASE WHEN d < -64 THEN d + 256 ELSE d END AS step FROM (SELECT file_id, "offset", counter - lag(counter) OVER (PARTITION BY file_id ORDER BY "offset") AS d FROM log WHERE kind = 'IMU')) WHERE step <> 1""",
    "flagged_outliers": f"SELECT * FROM {neighbours(IMU_SEG, 'file_id, segment', SIX, 5)}",
    "flagged_outliers_wide": f"SELECT * FROM {neighbours('(SELECT * FROM log WHERE kind = ' + chr(39) + 'GNSS' + chr(39) + ')', 'file_id', ['latitude', 'longitude', 'micros_reading'], 3)}",
    "flagged_float_outliers": f"""SELECT file_id, "offset", isnan(v) OR coalesce(n >= 7 AND m >= 2 AND abs(v - mean) > 3 * sd, false) AS reading_stdchecked FROM (
        SELECT a.file_id, a."offset", a.v, a.n, count(b.v) FILTER (NOT isnan(b.v)) AS m, avg(b.v) FILTER (NOT isnan(b.v)) AS mean, stddev_samp(b.v) FILTER (NOT isnan(b.v)) AS sd
        FROM odd a LEFT JOIN odd b ON a.file_id = b.file_id AND a.at <> b.at AND b.at BETWEEN CASE WHEN a.at <= 3 THEN 1 WHEN a.at > a.n - 3 THEN a.n - 6 ELSE a.at - 3 END AND CASE WHEN a.at <= 3 THEN 7 WHEN a.at > a.n - 3 THEN a.n ELSE a.at + 3 END GROUP BY ALL)""",
    "debounced_pulses": f"SELECT file_id, \"offset\", (micros_reading - coalesce(lag(micros_reading) OVER (PARTITION BY file_id ORDER BY \"offset\"), 0) + {TURN}) % {TURN} >= {500_000 * TICKS} AS kept FROM log WHERE kind = 'PPS'",
    "clock_consistency": f"""SELECT file_id, segment, (max(lo) - min(lo))::BIGINT AS min_spread, (max(hi) - min(hi))::BIGINT AS max_spread, max(lo) - min(lo) <= {DEVIATION} AND max(hi) - min(hi) <= {DEVIATION} AS consistency_ok
        FROM (SELECT file_id, segment, kind, min(mrel) AS lo, max(mrel) AS hi FROM rel GROUP BY ALL) GROUP BY ALL""",
    "nearest_fixes": "SELECT file_id, segment, \"offset\", micros, coalesce(gnss_micros, -1) AS gnss_micros, round(gnss_utc, 6) AS gnss_utc FROM near",
    "pulse_seconds": f"SELECT file_id, segment, \"offset\", coalesce(round_even(gnss_utc + (micros - gnss_micros) / {TICKS}, 0)::BIGINT, -1) AS utc_second FROM near",
    "filtered_pairs": "SELECT file_id, \"offset\", utc_second, used FROM pairs",
    "fitted_clock": "SELECT f.file_id, f.n_pairs, f.n_pairs_used, round(slope * 1e6, 4) AS slope_us, round(intercept, 3) AS intercept, round(r_squared, 6) AS r_squared FROM fits0 f LEFT JOIN fits USING (file_id)",
    "applied_clock": "SELECT w.file_id, w.kind, w.\"offset\", round(slope * m + intercept, 2) AS utc, slope IS NOT NULL AS has_time FROM whole w LEFT JOIN fits USING (file_id)",
    "pulse_mismatch": """SELECT file_id, 0 AS segment, round(max(abs(d)), 6) AS max_mismatch, round(avg(d), 6) AS mean_mismatch, round(sqrt(avg(d * d)), 6) AS rms_mismatch
        FROM (SELECT file_id, u - round_even(u, 0) AS d FROM (SELECT file_id, posix_timestamp + (counter - 128) / 400 AS u FROM log WHERE kind = 'PPS')) GROUP BY file_id""",
    "graded_segments": "SELECT file_id, segment, n_pps, n_gnss, n_imu, regression_valid FROM grades",
    "filtered_segments": "SELECT file_id, segment, keep, skip_reason, coalesce(segment_out, -1) AS segment_out FROM filtered",
    "kept_rows": "SELECT s.file_id, s.segment, count(*) AS n FROM seg s JOIN filtered f ON s.file_id = f.file_id AND s.segment = f.segment WHERE keep GROUP BY ALL",
    "unwrap_stats": f"""SELECT file_id, segment, kind, count(*) FILTER (micros_reading_wrap) AS wraps, count(*) FILTER (jump) AS jumps,
        coalesce(string_agg((nth - 1)::VARCHAR, ',' ORDER BY nth) FILTER (micros_reading_wrap), '') AS wrap_indices, coalesce(string_agg((nth - 1)::VARCHAR, ',' ORDER BY nth) FILTER (jump), '') AS jump_indices
        FROM (SELECT *, coalesce(d < 0 OR d > 0.1 * {TURN}, false) AS jump FROM (SELECT *, micros_reading_unwrapped - lag(micros_reading_unwrapped) OVER (PARTITION BY file_id, segment, kind ORDER BY "offset") AS d FROM unw)) GROUP BY ALL""",
    "segment_counts": "SELECT file_id, coalesce(segment, -1) AS segment, count(*) FILTER (kind = 'PPS') AS n_pps, count(*) FILTER (kind = 'GNSS') AS n_gnss, count(*) FILTER (kind = 'IMU') AS n_imu FROM seg GROUP BY GROUPING SETS ((file_id, segment), (file_id))",
    "utc_duration": f"SELECT file_id, round(max(u) - min(u), 6) AS duration_s FROM (SELECT file_id, CASE WHEN kind = 'IMU' THEN {LATE} END AS u FROM log) GROUP BY file_id",
    "outlier_counts": "SELECT file_id, coalesce(segment, -1) AS segment, " + ", ".join(f"sum({c}_stdchecked::INT)::BIGINT AS n_{c}_stdchecked" for c in SIX) + ", " + ", ".join(f"sum({g}_x_stdchecked::INT + {g}_y_stdchecked::INT + {g}_z_stdchecked::INT)::BIGINT AS n_{g}" for g in ("acc", "gyr")) + f" FROM {neighbours(IMU_SEG, 'file_id, segment', SIX, 5)} GROUP BY GROUPING SETS ((file_id, segment), (file_id))",
    "dt_stats": f"""SELECT file_id, kind, round(avg(r), 3) AS mean_dt_raw_ms, round(stddev_pop(r), 3) AS std_dt_raw_ms, round(avg(u), 3) AS mean_dt_utc_ms, round(stddev_pop(u), 3) AS std_dt_utc_ms
        FROM (SELECT file_id, kind, (micros_reading - lag(micros_reading) OVER w) * 1000 / {TICKS} AS r, ("offset" / 1e6 - lag("offset" / 1e6) OVER w) * 1000.0::DOUBLE AS u FROM log WINDOW w AS (PARTITION BY file_id, kind ORDER BY "offset")) GROUP BY ALL""",
    "raw_vs_clean_range": f"SELECT file_id, kind, count(*) AS n, min(micros_reading) AS min_micros, max(micros_reading) AS max_micros, count(u) AS n_valid, round(min(u * 1e6), 0) AS min_utc_micros, round(max(u * 1e6), 0) AS max_utc_micros FROM (SELECT *, {LATE} AS u FROM log) GROUP BY ALL",
    "flat_export": f"SELECT file_id, micros_reading AS imu_micros, round(coalesce({LATE}, -1), 6) AS imu_timestamp, acc_x::DOUBLE AS imu_acc_x FROM log WHERE kind = 'IMU'",
    "value_limits": """SELECT file_id, kind, round(low - pad, 6) AS lower, round(high + pad, 6) AS upper FROM (
        SELECT *, CASE WHEN high > low THEN (high - low) * 0.1::DOUBLE WHEN low <> 0 THEN abs(low) * 0.1::DOUBLE ELSE 1.0 END AS pad FROM (
          SELECT file_id, kind, coalesce(min(acc_x) FILTER (NOT f), min(acc_x)) AS low, coalesce(max(acc_x) FILTER (NOT f), max(acc_x)) AS high FROM (SELECT *, counter % 3 > 0 OR file_id % 10 = 0 AS f FROM log) GROUP BY ALL))""",
    "head_tail_sample": """SELECT file_id, kind, "offset", CASE WHEN a <= 3 AND b <= 3 THEN 'both' WHEN a <= 3 THEN 'head' ELSE 'tail' END AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id, kind ORDER BY "offset") AS a, row_number() OVER (PARTITION BY file_id, kind ORDER BY "offset" DESC) AS b FROM log) WHERE a <= 3 OR b <= 3""",
    "track_endpoints": "SELECT file_id, count(*) AS n_points, count(*) FILTER (counter % 10 = 0) AS n_outliers, " + ", ".join(f"round({f}({c}, \"offset\") / 1e7, 6) AS {p}_{c}" for p, f in (("start", "arg_min"), ("end", "arg_max")) for c in ("latitude", "longitude")) + " FROM log WHERE kind = 'GNSS' GROUP BY file_id",
    "quality_gates": f"""SELECT * EXCLUDE (m), coalesce(null_utc + old_utc + counter_breaks + backward_steps = 0 AND outlier_rows > 0 AND outlier_rows / nullif(m, 0) < 0.1, false) AS passed FROM (
        SELECT file_id, count(*) AS n, count(*) FILTER (counter % 50 = 0) AS null_utc, count(*) FILTER (counter % 50 > 0 AND "offset" / 1e6 <= 1.7045e9) AS old_utc,
               count(*) FILTER (kind = 'IMU' AND (c % 256 + 256) % 256 NOT IN (0, 1)) AS counter_breaks, count(*) FILTER (d < 0) AS backward_steps, count(*) FILTER (kind = 'IMU' AND acc_x % 20 = 0) AS outlier_rows, count(*) FILTER (kind = 'IMU') AS m
        FROM (SELECT *, counter - lag(counter) OVER w AS c, micros_reading_unwrapped - lag(micros_reading_unwrapped) OVER w AS d FROM unw WINDOW w AS (PARTITION BY file_id, segment, kind ORDER BY "offset")) GROUP BY file_id)""",
    "sigma_filtered_mean": """SELECT file_id, kind, CASE WHEN lo = hi THEN lo ELSE coarse + trunc((strict - ns * coarse) / n)::BIGINT END AS mean FROM (
        SELECT file_id, kind, min(acc_x) AS lo, max(acc_x) AS hi, count(*) FILTER (abs(acc_x - m) <= 1.6 * s) AS n, trunc(sum(acc_x) FILTER (abs(acc_x - m) <= 1.6 * s) / count(*) FILTER (abs(acc_x - m) <= 1.6 * s))::BIGINT AS coarse,
               coalesce(sum(acc_x) FILTER (abs(acc_x - m) < 1.6 * s), 0)::BIGINT AS strict, count(*) FILTER (abs(acc_x - m) < 1.6 * s) AS ns
        FROM (SELECT *, avg(acc_x) OVER w AS m, stddev_pop(acc_x) OVER w AS s FROM log WINDOW w AS (PARTITION BY file_id, kind)) GROUP BY ALL)""",
    "sigma_filtered_mean_float": """SELECT file_id, kind, round(CASE WHEN min(value) = max(value) THEN min(value) ELSE coalesce(avg(value) FILTER (abs(value - m) < 1.5 * s), 0) END, 6) AS mean
        FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM log WINDOW w AS (PARTITION BY file_id, kind)) GROUP BY ALL""",
    "plain_mean": "SELECT file_id, kind, round(avg(value), 6) AS mean FROM log GROUP BY ALL",
    "live_rates": "SELECT device, kind, window_start, n, round(n / 86400, 6) AS rate_hz FROM rate",
    "rate_alarm": """SELECT device, kind, window_start, n, coalesce(sum(bad) OVER (PARTITION BY device, kind, island ORDER BY window_start), 0)::BIGINT AS in_a_row, coalesce(sum(bad) OVER (PARTITION BY device, kind, island ORDER BY window_start), 0) >= 3 AS alarm FROM (
        SELECT *, sum(1 - bad) OVER (PARTITION BY device, kind ORDER BY window_start) AS island FROM (SELECT *, (n < 2.0::DOUBLE * (1 - 0.4::DOUBLE) OR n > 2.0::DOUBLE * (1 + 0.4::DOUBLE))::INT AS bad FROM rate))""",
    "silence_alarm": """SELECT device, kind, window_start, n, (rn - coalesce(max(CASE WHEN bad THEN NULL ELSE rn END) OVER w, 0))::BIGINT AS in_a_row, rn - coalesce(max(CASE WHEN bad THEN NULL ELSE rn END) OVER w, 0) >= 3 AS alarm FROM (
        SELECT g.device, g.kind, g.window_start, coalesce(r.n, 0) AS n, coalesce(r.n, 0) NOT IN (2) AS bad, row_number() OVER (PARTITION BY g.device, g.kind ORDER BY g.window_start) AS rn FROM (
          SELECT device, k.kind, unnest(range(lo, hi + 1, 86400000000)) AS window_start FROM (SELECT device, min(window_start) AS lo, max(window_start) AS hi FROM rate GROUP BY device), (VALUES ('IMU'), ('GNSS'), ('PPS')) k(kind)) g
        LEFT JOIN rate r ON g.device = r.device AND g.kind = r.kind AND g.window_start = r.window_start) WINDOW w AS (PARTITION BY device, kind ORDER BY window_start)""",
    "busy_alarm": """SELECT file_id, "offset", sum(bad) OVER (PARTITION BY file_id, island ORDER BY "offset")::BIGINT AS in_a_row, sum(bad) OVER (PARTITION BY file_id, island ORDER BY "offset") >= 3 AS alarm FROM (
        SELECT *, sum(1 - bad) OVER (PARTITION BY file_id ORDER BY "offset") AS island FROM (SELECT *, (acc_x >= 4000)::INT AS bad FROM log))""",
}

SUMMARY = f"""SELECT file_id, n_pps, n_gnss, n_imu, first_micros, last_micros, round(d, 6) AS duration_s, {", ".join(f"CASE WHEN d > 0 THEN round(n_{k} / d * 1e6, 4) END AS rate_{k}_uhz" for k in ("pps", "gnss", "imu"))} FROM (
        SELECT *, CASE WHEN steady > 1 THEN (last_micros - first_micros + CASE WHEN last_micros < first_micros THEN {TURN} ELSE 0 END) / {TICKS} END AS d FROM (
          SELECT w.file_id, count(*) FILTER (w.kind = 'PPS') AS n_pps, count(*) FILTER (w.kind = 'GNSS') AS n_gnss, count(*) FILTER (w.kind = 'IMU') AS n_imu, count(*) FILTER (NOT i.imu_jump) AS steady,
                 arg_min(w.m, w."offset") FILTER (NOT i.imu_jump) AS first_micros, arg_max(w.m, w."offset") FILTER (NOT i.imu_jump) AS last_micros
          FROM whole w LEFT JOIN imu1 i ON w.kind = 'IMU' AND w.file_id = i.file_id AND w."offset" = i."offset" GROUP BY w.file_id))"""
FINAL["recording_summary"] = SUMMARY
FINAL["quality_report"] = f"""SELECT s.file_id, n_pps, n_gnss, n_imu, duration_s, rate_imu_uhz, mean_dt_raw_ms, n_gaps, missed FROM ({SUMMARY}) s
        LEFT JOIN (SELECT file_id, mean_dt_raw_ms FROM ({FINAL["dt_stats"]}) WHERE kind = 'IMU') d ON s.file_id = d.file_id
        LEFT JOIN (SELECT file_id, count(*) AS n_gaps, sum(missed)::BIGINT AS missed FROM ({FINAL["counter_gaps"]}) GROUP BY file_id) g ON s.file_id = g.file_id"""

FINAL["range_decoded_frames"] = FINAL["decoded_frames"]
FINAL["synchronised"] = """SELECT file_id, segment, (count(*) OVER (PARTITION BY file_id ORDER BY segment) - 1)::INTEGER AS segment_out, n_pps, n_gnss, n_imu FROM skeep WHERE keep"""
FINAL["fleet_report"] = f"""SELECT coalesce(day, 'all') AS day, count(*) AS n_files, sum(n_pps)::BIGINT AS n_pps, sum(n_gnss)::BIGINT AS n_gnss, sum(n_imu)::BIGINT AS n_imu, count(*) FILTER (status = 'complete') AS n_complete,
        round(sum(duration_s), 3) AS duration_s, round(sum(n_imu) FILTER (duration_s > 0) / sum(duration_s) FILTER (duration_s > 0) * 1e6, 3) AS rate_imu_uhz, sum(n_gaps)::BIGINT AS n_gaps, sum(missed)::BIGINT AS missed, max(max_mismatch) AS max_mismatch, sum(n_valid)::BIGINT AS n_valid
        FROM (SELECT strftime(make_timestamp(d.start), '%Y-%m-%d') AS day, q.*, a.status, m.max_mismatch, v.n_valid FROM ({FINAL["quality_report"]}) q
              JOIN (SELECT file_id, min("offset") AS start FROM log GROUP BY file_id) d ON q.file_id = d.file_id
              JOIN (SELECT file_id, status FROM ({FINAL["file_audit"]})) a ON q.file_id = a.file_id
              LEFT JOIN (SELECT file_id, max_mismatch FROM ({FINAL["pulse_mismatch"]})) m ON q.file_id = m.file_id
              LEFT JOIN (SELECT file_id, sum(n_valid) AS n_valid FROM ({FINAL["raw_vs_clean_range"]}) GROUP BY file_id) v ON q.file_id = v.file_id)
        GROUP BY ROLLUP (day)"""


def oracle_sql() -> dict[str, str]:
    return {name: f"{BASE}\n{sql}" for name, sql in FINAL.items()}
