"""Oracle SQL (DuckDB) for the registered queries.

Written independently of the Spark code: plain SQL over the driver's tables,
with the adapter of ``sources.fixtures`` inlined as CTEs. Rounding that must
match Spark's HALF_UP ``round`` on the decimal representation goes through
``CAST(CAST(x AS VARCHAR) AS DECIMAL)``; means are decimal sums divided once.
"""

from __future__ import annotations

from ..sources.fixtures import oracle_ctes

# Spark ``round(x, 2)`` semantics (HALF_UP on the shortest decimal text).
def R2(x: str) -> str:
    return f"CAST(ROUND(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"


def MEAN(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / CAST(NULLIF(COUNT({x}), 0) AS DOUBLE))"


CLASSIFIED = """
pings AS (
  SELECT id, device_id, device_name,
    CASE WHEN isnan(latitude) THEN NULL ELSE latitude END AS latitude,
    CASE WHEN isnan(longitude) THEN NULL ELSE longitude END AS longitude,
    altitude, speed, trunc(battery) AS battery, trunc(signal) AS signal,
    sim_operator, network_type, timestamp
  FROM raw_pings),
locations AS (
  SELECT id, device_id, device_name, latitude, longitude,
    COALESCE(altitude, 0.0) AS altitude, COALESCE(speed, 0.0) AS speed,
    COALESCE(battery, 0.0) AS battery, COALESCE(signal, 0.0) AS signal,
    CASE WHEN sim_operator IS NULL THEN 'SIN SEÑAL'
         WHEN sim_operator = '' THEN 'SIN SEÑAL'
         WHEN regexp_matches(sim_operator, '(?i)unknown|sin señ|sin seal|n/a') THEN 'SIN SEÑAL'
         WHEN regexp_matches(sim_operator, '(?i)entel|bomov|18vacunate|distancia|movil gsm|t-mobile') THEN 'ENTEL'
         WHEN regexp_matches(sim_operator, '(?i)tigo') THEN 'TIGO'
         WHEN regexp_matches(sim_operator, '(?i)viva') THEN 'VIVA'
         ELSE sim_operator END AS sim_operator,
    sim_operator AS sim_operator_raw,
    CASE WHEN network_type IS NULL THEN 'SIN DATOS'
         WHEN regexp_matches(network_type, '(?i)wifi|wi-fi') THEN 'WiFi'
         WHEN regexp_matches(network_type, '(?i)5G') THEN '5G'
         WHEN regexp_matches(network_type, '(?i)4G|LTE|mobile') THEN '4G'
         WHEN regexp_matches(network_type, '(?i)3G|HSDPA|HSPA|UMTS|WCDMA') THEN '3G'
         WHEN regexp_matches(network_type, '(?i)2G|EDGE|GPRS|GSM') THEN '2G'
         ELSE 'SIN DATOS' END AS network_type,
    network_type AS network_type_raw,
    timestamp, CAST(timestamp AS DATE) AS date,
    CASE WHEN hour(timestamp) >= 6 AND hour(timestamp) < 12 THEN 'MAÑANA'
         WHEN hour(timestamp) >= 12 AND hour(timestamp) < 19 THEN 'TARDE'
         ELSE 'NOCHE' END AS period,
    CASE WHEN altitude IS NULL THEN NULL WHEN altitude <= 400 THEN 'BAJA' WHEN altitude <= 500 THEN 'MEDIA'
         ELSE 'ALTA' END AS altitude_range,
    CASE WHEN battery IS NULL THEN NULL WHEN battery < 25 THEN 'CRITICO' WHEN battery < 50 THEN 'BAJO'
         WHEN battery < 75 THEN 'MEDIO' ELSE 'ALTO' END AS battery_level,
    CASE WHEN signal IS NULL THEN NULL WHEN signal >= -60 THEN 'EXCELENTE' WHEN signal >= -70 THEN 'BUENA'
         WHEN signal >= -80 THEN 'REGULAR' ELSE 'POBRE' END AS signal_quality,
    CASE WHEN COALESCE(speed, 0.0) = 0 THEN 'DETENIDO'
         WHEN COALESCE(speed, 0.0) * 3.6 <= 5 THEN 'CAMINANDO'
         WHEN COALESCE(speed, 0.0) * 3.6 <= 10 THEN 'CORRIENDO'
         WHEN COALESCE(speed, 0.0) * 3.6 <= 60 THEN 'TRANSPORTE PÚBLICO'
         ELSE 'VEHÍCULO' END AS speed_range,
    'SRID=4326;POINT(' || CAST(longitude AS VARCHAR) || ' ' || CAST(latitude AS VARCHAR) || ')' AS location_geom,
    floor(latitude / CAST(0.01 AS DOUBLE)) * CAST(0.01 AS DOUBLE) AS lat_grid,
    floor(longitude / CAST(0.01 AS DOUBLE)) * CAST(0.01 AS DOUBLE) AS lon_grid
  FROM pings
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
"""


def with_locations(body: str) -> str:
    return "WITH " + oracle_ctes() + ",\n" + CLASSIFIED + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["transform_locations"] = with_locations("""
SELECT id, device_id, device_name, latitude, longitude, altitude, speed, battery, signal,
  sim_operator, sim_operator_raw, network_type, network_type_raw, network_type AS network_generation,
  timestamp, date, period, altitude_range, battery_level, signal_quality, speed_range, location_geom,
  lat_grid, lon_grid
FROM locations""")

ORACLE["grid_heatmap"] = with_locations(f"""
SELECT cell_y, cell_x, lat_grid, lon_grid,
  COUNT(*) AS point_count, COUNT(DISTINCT device_id) AS unique_devices,
  {R2(MEAN('battery'))} AS avg_battery, {R2(MEAN('signal'))} AS avg_signal,
  {R2(MEAN('altitude'))} AS avg_altitude, {R2(MEAN('speed'))} AS avg_speed,
  'SRID=4326;POLYGON((' || CAST(lon_grid AS VARCHAR) || ' ' || CAST(lat_grid AS VARCHAR) || ','
    || CAST(lon_grid + 0.01 AS VARCHAR) || ' ' || CAST(lat_grid AS VARCHAR) || ','
    || CAST(lon_grid + 0.01 AS VARCHAR) || ' ' || CAST(lat_grid + 0.01 AS VARCHAR) || ','
    || CAST(lon_grid AS VARCHAR) || ' ' || CAST(lat_grid + 0.01 AS VARCHAR) || ','
    || CAST(lon_grid AS VARCHAR) || ' ' || CAST(lat_grid AS VARCHAR) || '))' AS cell_geom,
  CAST(0.01 AS DOUBLE) AS grid_size
FROM (SELECT *, CAST(floor(latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_y,
        CAST(floor(longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_x FROM locations) c
GROUP BY cell_y, cell_x, lat_grid, lon_grid""")


def R(x: str, d: int) -> str:
    return f"CAST(ROUND(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def PCT(part: str, total: str) -> str:
    return f"(CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST({total} AS DOUBLE))"


def NULLIF_FALSY(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR ({x}) = 0 THEN NULL ELSE ({x}) END)"


PING_COLS = ("id, device_id, device_name, latitude, longitude, altitude, speed, battery, signal, "
             "sim_operator, network_type, timestamp")

ORACLE["page_scan"] = with_locations(f"SELECT {PING_COLS} FROM pings ORDER BY id LIMIT 1000 OFFSET 2000")

ORACLE["filtered_scan"] = with_locations(f"""
SELECT {PING_COLS} FROM pings WHERE network_type = 'LTE'
  AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'""")

ORACLE["incremental_new_rows"] = with_locations(f"SELECT {PING_COLS} FROM pings WHERE id > 5000")

ORACLE["count_records"] = with_locations("SELECT COUNT(*) AS total FROM pings WHERE sim_operator = 'tigo'")

ORACLE["high_water_mark"] = with_locations("SELECT MAX(id) AS last_processed_id FROM pings")

ORACLE["quarantine"] = with_locations("""
SELECT * FROM (
  SELECT id, latitude, longitude, speed, battery,
    concat_ws(',',
      CASE WHEN latitude IS NULL THEN 'latitude_missing' END,
      CASE WHEN latitude IS NOT NULL AND NOT (latitude BETWEEN -90 AND 90) THEN 'latitude_out_of_range' END,
      CASE WHEN longitude IS NULL THEN 'longitude_missing' END,
      CASE WHEN longitude IS NOT NULL AND NOT (longitude BETWEEN -180 AND 180) THEN 'longitude_out_of_range' END,
      CASE WHEN speed < 0 THEN 'speed_negative' END,
      CASE WHEN NOT (battery BETWEEN 0 AND 100) THEN 'battery_out_of_range' END) AS reason
  FROM pings) q
WHERE reason <> ''""")

ORACLE["time_decomposition"] = with_locations("""
SELECT id, date, hour(timestamp) AS hour_value, period AS time_period,
  CASE period WHEN 'MAÑANA' THEN 'MOR' WHEN 'TARDE' THEN 'AFT' WHEN 'NOCHE' THEN 'NIG' END AS time_period_code,
  hour(timestamp) AS time_id
FROM locations""")

ORACLE["heatmap_filtered"] = with_locations(f"""
SELECT cell_y, cell_x, cell_y * CAST(0.005 AS DOUBLE) AS lat_grid, cell_x * CAST(0.005 AS DOUBLE) AS lon_grid,
  COUNT(*) AS point_count, COUNT(DISTINCT device_id) AS unique_devices,
  {R2(MEAN('battery'))} AS avg_battery, {R2(MEAN('signal'))} AS avg_signal,
  {R2(MEAN('altitude'))} AS avg_altitude, {R2(MEAN('speed'))} AS avg_speed,
  'SRID=4326;POLYGON((' || CAST(cell_x * CAST(0.005 AS DOUBLE) AS VARCHAR) || ' ' || CAST(cell_y * CAST(0.005 AS DOUBLE) AS VARCHAR) || ','
    || CAST(cell_x * CAST(0.005 AS DOUBLE) + 0.005 AS VARCHAR) || ' ' || CAST(cell_y * CAST(0.005 AS DOUBLE) AS VARCHAR) || ','
    || CAST(cell_x * CAST(0.005 AS DOUBLE) + 0.005 AS VARCHAR) || ' ' || CAST(cell_y * CAST(0.005 AS DOUBLE) + 0.005 AS VARCHAR) || ','
    || CAST(cell_x * CAST(0.005 AS DOUBLE) AS VARCHAR) || ' ' || CAST(cell_y * CAST(0.005 AS DOUBLE) + 0.005 AS VARCHAR) || ','
    || CAST(cell_x * CAST(0.005 AS DOUBLE) AS VARCHAR) || ' ' || CAST(cell_y * CAST(0.005 AS DOUBLE) AS VARCHAR) || '))' AS cell_geom,
  CAST(0.005 AS DOUBLE) AS grid_size
FROM (SELECT *, CAST(floor(latitude / CAST(0.005 AS DOUBLE)) AS BIGINT) AS cell_y,
        CAST(floor(longitude / CAST(0.005 AS DOUBLE)) AS BIGINT) AS cell_x FROM locations
      WHERE latitude >= -18.2 AND latitude <= -17.5 AND longitude >= -63.6 AND longitude <= -63.0
        AND network_type = '4G') c
GROUP BY cell_y, cell_x""")

ORACLE["dataset_statistics"] = with_locations(f"""
SELECT COUNT(*) AS total_points, COUNT(DISTINCT device_id) AS unique_devices,
  COALESCE({NULLIF_FALSY(R2(MEAN('battery')))}, 0.0) AS avg_battery,
  COALESCE({NULLIF_FALSY(R2(MEAN('signal')))}, 0.0) AS avg_signal,
  COALESCE({NULLIF_FALSY(R2(MEAN('speed')))}, 0.0) AS avg_speed,
  COALESCE({NULLIF_FALSY(R2(MEAN('altitude')))}, 0.0) AS avg_altitude,
  MIN(timestamp) AS min_date, MAX(timestamp) AS max_date
FROM locations""")

ORACLE["label_distributions"] = with_locations(f"""
, d AS (
  SELECT 'period' AS dimension, period AS label, COUNT(*) AS count,
    CASE period WHEN 'MAÑANA' THEN 1 WHEN 'TARDE' THEN 2 WHEN 'NOCHE' THEN 3 ELSE 4 END AS position
  FROM locations GROUP BY period
  UNION ALL
  SELECT 'altitude_range', altitude_range, COUNT(*),
    CASE altitude_range WHEN 'BAJA' THEN 1 WHEN 'MEDIA' THEN 2 WHEN 'ALTA' THEN 3 ELSE 4 END
  FROM locations WHERE altitude_range IS NOT NULL GROUP BY altitude_range
  UNION ALL
  SELECT 'battery_level', battery_level, COUNT(*),
    CASE battery_level WHEN 'CRITICO' THEN 1 WHEN 'BAJO' THEN 2 WHEN 'MEDIO' THEN 3 WHEN 'ALTO' THEN 4 ELSE 5 END
  FROM locations WHERE battery_level IS NOT NULL GROUP BY battery_level
  UNION ALL
  SELECT 'network_generation', network_type, COUNT(*),
    CAST(row_number() OVER (ORDER BY COUNT(*) DESC, network_type ASC NULLS LAST) AS INTEGER)
  FROM locations GROUP BY network_type
  UNION ALL
  SELECT 'sim_operator', sim_operator, COUNT(*),
    CAST(row_number() OVER (ORDER BY COUNT(*) DESC, sim_operator ASC NULLS LAST) AS INTEGER)
  FROM locations GROUP BY sim_operator)
SELECT dimension, label, count, CAST(position AS INTEGER) AS position,
  {PCT('count', 'SUM(count) OVER (PARTITION BY dimension)')} AS percentage
FROM d""")

# device-day summary runs on raw values with non-null coordinates (older job)
ORACLE["device_day_summary"] = with_locations(f"""
SELECT device_id, device_name, CAST(timestamp AS DATE) AS date, COUNT(*) AS points_count,
  {MEAN('speed')} AS avg_speed, MAX(speed) AS max_speed, {MEAN('battery')} AS avg_battery
FROM pings WHERE latitude IS NOT NULL AND longitude IS NOT NULL
GROUP BY device_id, device_name, CAST(timestamp AS DATE)""")

ORACLE["latest_device_days"] = ORACLE["device_day_summary"] + "\nORDER BY date DESC, device_id, device_name LIMIT 100"

ORACLE["device_extents"] = with_locations("""
SELECT device_id, device_name, MIN(timestamp) AS first_seen, MAX(timestamp) AS last_seen
FROM locations GROUP BY device_id, device_name""")

ORACLE["device_stats"] = with_locations(f"""
, base AS (
  SELECT device_id, arg_max(device_name, timestamp) AS device_name,
    COUNT(*) AS total_records, MIN(timestamp) AS first_seen, MAX(timestamp) AS last_seen,
    {MEAN('battery')} AS avg_battery, {MEAN('signal')} AS avg_signal, {MEAN('speed')} AS avg_speed
  FROM locations GROUP BY device_id),
pos AS (
  SELECT device_id, lat_r, lon_r, COUNT(*) AS n FROM (
    SELECT device_id, {R('latitude', 3)} AS lat_r, {R('longitude', 3)} AS lon_r FROM locations) GROUP BY 1, 2, 3),
mode AS (
  SELECT device_id, lat_r AS most_common_lat, lon_r AS most_common_lon FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, lat_r ASC, lon_r ASC) AS rk FROM pos)
  WHERE rk = 1),
nets AS (
  SELECT device_id, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS network_distribution FROM (
    SELECT device_id, network_type AS k, COUNT(*) AS v FROM locations GROUP BY 1, 2) GROUP BY device_id),
ops AS (
  SELECT device_id, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS operator_distribution FROM (
    SELECT device_id, sim_operator AS k, COUNT(*) AS v FROM locations GROUP BY 1, 2) GROUP BY device_id)
SELECT * FROM base LEFT JOIN mode USING (device_id) LEFT JOIN nets USING (device_id) LEFT JOIN ops USING (device_id)""")

STRICT_OPERATOR = """CASE WHEN sim_operator IS NULL OR trim(sim_operator) = '' THEN 'SIN SEÑAL'
  WHEN upper(trim(sim_operator)) IN ('UNKNOWN', 'SIN SEÑAL', 'SIN SEAL', 'N/A', 'NA') THEN 'SIN SEÑAL'
  WHEN contains(upper(trim(sim_operator)), 'ENTEL') OR contains(upper(trim(sim_operator)), 'BOMOV')
    OR contains(upper(trim(sim_operator)), '+18VACUNATE') OR contains(upper(trim(sim_operator)), 'LADISTANCIANOSCUIDA')
    OR contains(upper(trim(sim_operator)), 'MOVIL GSM') OR contains(upper(trim(sim_operator)), 'T-MOBILE') THEN 'ENTEL'
  WHEN contains(upper(trim(sim_operator)), 'TIGO') THEN 'TIGO'
  WHEN contains(upper(trim(sim_operator)), 'VIVA') THEN 'VIVA'
  WHEN contains(upper(trim(sim_operator)), 'SIN') OR contains(upper(trim(sim_operator)), 'SEAL') THEN 'SIN SEÑAL'
  ELSE upper(trim(sim_operator)) END"""

VARIANT = "CASE WHEN sim_operator IS NULL OR sim_operator = '' THEN 'NULL' ELSE sim_operator END"

ORACLE["operator_groups"] = with_locations(f"""
, g AS (
  SELECT {STRICT_OPERATOR} AS operator, COUNT(*) AS records, COUNT(DISTINCT {VARIANT}) AS variants,
    arg_min(struct_pack(d := device_name, n := network_type), id).d AS sample_device,
    arg_min(struct_pack(d := device_name, n := network_type), id).n AS sample_network
  FROM pings GROUP BY 1)
SELECT operator, records, variants, sample_device, sample_network,
  {PCT('records', 'SUM(records) OVER ()')} AS percentage,
  CAST(row_number() OVER (ORDER BY records DESC, operator ASC NULLS LAST) AS INTEGER) AS rank
FROM g""")

ORACLE["operator_variants"] = with_locations(f"""
SELECT {STRICT_OPERATOR} AS operator, {VARIANT} AS variant, COUNT(*) AS records FROM pings GROUP BY 1, 2""")

NET_KEY = "CASE WHEN network_type IS NULL OR network_type = '' THEN 'NULL' ELSE trim(network_type) END"

ORACLE["network_groups"] = with_locations(f"""
, g AS (SELECT {NET_KEY} AS network, COUNT(*) AS records FROM pings GROUP BY 1)
SELECT network, records, {PCT('records', 'SUM(records) OVER ()')} AS percentage,
  CAST(row_number() OVER (ORDER BY records DESC, network ASC NULLS LAST) AS INTEGER) AS rank
FROM g""")

STRICT_NET = """CASE WHEN k IS NULL OR trim(k) = '' THEN 'SIN DATOS'
  WHEN contains(upper(trim(k)), 'WIFI') OR contains(upper(trim(k)), 'WI-FI') THEN 'WiFi'
  WHEN contains(upper(trim(k)), '5G') THEN '5G'
  WHEN contains(upper(trim(k)), '4G') OR contains(upper(trim(k)), 'LTE')
    OR (contains(upper(trim(k)), 'MOBILE') AND length(upper(trim(k))) < 15) THEN '4G'
  WHEN contains(upper(trim(k)), '3G') OR contains(upper(trim(k)), 'HSDPA') OR contains(upper(trim(k)), 'HSPA')
    OR contains(upper(trim(k)), 'UMTS') OR contains(upper(trim(k)), 'WCDMA') THEN '3G'
  WHEN contains(upper(trim(k)), '2G') OR contains(upper(trim(k)), 'EDGE') OR contains(upper(trim(k)), 'GPRS')
    OR contains(upper(trim(k)), 'GSM') THEN '2G'
  ELSE 'SIN DATOS' END"""

ORACLE["network_generations"] = with_locations(f"""
, g AS (SELECT {STRICT_NET} AS generation, COUNT(*) AS records FROM (SELECT {NET_KEY} AS k FROM pings) GROUP BY 1)
SELECT generation, records, {PCT('records', 'SUM(records) OVER ()')} AS percentage FROM g WHERE records > 0""")

SPEED_RANGE_RAW = """CASE WHEN speed IS NULL OR speed = 0 THEN 'DETENIDO'
  WHEN speed * 3.6 <= 5 THEN 'CAMINANDO' WHEN speed * 3.6 <= 10 THEN 'CORRIENDO'
  WHEN speed * 3.6 <= 60 THEN 'TRANSPORTE PÚBLICO' ELSE 'VEHÍCULO' END"""

ORACLE["speed_groups"] = with_locations(f"""
, g AS (SELECT {SPEED_RANGE_RAW} AS speed_range, COUNT(*) AS records FROM pings GROUP BY 1)
SELECT speed_range, records, {PCT('records', 'SUM(records) OVER ()')} AS percentage,
  CASE speed_range WHEN 'DETENIDO' THEN 1 WHEN 'CAMINANDO' THEN 2 WHEN 'CORRIENDO' THEN 3
    WHEN 'TRANSPORTE PÚBLICO' THEN 4 WHEN 'VEHÍCULO' THEN 5 ELSE 6 END AS position
FROM g""")

ORACLE["speed_motion_share"] = with_locations(f"""
, s AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE {SPEED_RANGE_RAW} = 'DETENIDO') AS stationary FROM pings)
SELECT total, stationary, total - stationary AS moving, {PCT('stationary', 'total')} AS pct_stationary,
  {PCT('total - stationary', 'total')} AS pct_moving
FROM s""")


def _kth(p: str, name: str) -> str:
    return (f"(SELECT speed FROM ranked WHERE rn = CAST(floor(CAST(n AS DOUBLE) * CAST({p} AS DOUBLE)) AS BIGINT))"
            f" AS {name}")


RANKED = """, ranked AS (
  SELECT speed, row_number() OVER (ORDER BY speed) - 1 AS rn, COUNT(*) OVER () AS n
  FROM pings WHERE speed IS NOT NULL)"""

ORACLE["speed_profile"] = with_locations(RANKED + f"""
, s AS (
  SELECT COUNT(*) AS total, COUNT(speed) AS valid, COUNT(*) FILTER (WHERE speed = 0) AS zero,
    MIN(speed) AS min_speed, MAX(speed) AS max_speed, {MEAN('speed')} AS mean_speed FROM pings)
SELECT total, valid, zero, min_speed, max_speed, mean_speed, {_kth('0.5', 'median_speed')},
  total - valid AS null_or_invalid, {PCT('total - valid', 'total')} AS pct_null_or_invalid,
  {PCT('valid', 'total')} AS pct_valid, {PCT('zero', 'total')} AS pct_zero
FROM s""")

ORACLE["speed_percentiles"] = with_locations(RANKED + f"""
SELECT {_kth('0.25', 'p25')}, {_kth('0.5', 'p50')}, {_kth('0.75', 'p75')}, {_kth('0.9', 'p90')},
  {_kth('0.95', 'p95')}, {_kth('0.99', 'p99')}""")

ORACLE["speed_histogram"] = with_locations(f"""
, g AS (
  SELECT CASE WHEN speed = 0 THEN 'Detenido (0 m/s)' WHEN speed < 2 THEN 'Muy lento (0.1-2 m/s)'
    WHEN speed < 5 THEN 'Lento (2-5 m/s)' WHEN speed < 10 THEN 'Caminando (5-10 m/s)'
    WHEN speed < 20 THEN 'Moderado (10-20 m/s)' WHEN speed < 30 THEN 'Rápido (20-30 m/s)'
    ELSE 'Muy rápido (>30 m/s)' END AS bucket, COUNT(*) AS records
  FROM pings WHERE speed IS NOT NULL GROUP BY 1)
SELECT bucket, records, {PCT('records', 'SUM(records) OVER ()')} AS percentage,
  CASE bucket WHEN 'Detenido (0 m/s)' THEN 1 WHEN 'Muy lento (0.1-2 m/s)' THEN 2 WHEN 'Lento (2-5 m/s)' THEN 3
    WHEN 'Caminando (5-10 m/s)' THEN 4 WHEN 'Moderado (10-20 m/s)' THEN 5 WHEN 'Rápido (20-30 m/s)' THEN 6
    WHEN 'Muy rápido (>30 m/s)' THEN 7 ELSE 8 END AS position
FROM g""")

ORACLE["top_speeds"] = with_locations("""
SELECT id, speed, speed * CAST(3.6 AS DOUBLE) AS speed_kmh, device_name, network_type, timestamp
FROM pings WHERE speed > 0 ORDER BY speed DESC, id LIMIT 10""")

ORACLE["period_report"] = with_locations(f"""
SELECT period AS time_period, COUNT(*) AS total_locations, {MEAN('battery')} AS avg_battery,
  {MEAN('signal')} AS avg_signal
FROM locations GROUP BY period""")

ORACLE["hour_report"] = with_locations("""
SELECT hour(timestamp) AS hour_value, period AS time_period, COUNT(*) AS records,
  COUNT(DISTINCT device_id) AS devices
FROM locations GROUP BY 1, 2""")

ORACLE["date_hour_report"] = with_locations("""
SELECT date, hour(timestamp) AS hour_value, period AS time_period, COUNT(*) AS records
FROM locations GROUP BY 1, 2, 3""")

DIM_NETWORK = """dim_network AS (
  SELECT network_type, network_generation,
    TRY_CAST(NULLIF(regexp_extract(network_generation, '([2-5])G', 1), '') AS INTEGER) AS generation,
    row_number() OVER (ORDER BY first_ts, network_type ASC NULLS FIRST) AS id
  FROM (SELECT network_type_raw AS network_type, arg_min(network_type, timestamp) AS network_generation,
          MIN(timestamp) AS first_ts FROM locations GROUP BY network_type_raw))"""

DIM_OPERATOR = """dim_operator AS (
  SELECT operator_name, upper(substring(operator_name, 1, 3)) AS operator_code,
    row_number() OVER (ORDER BY operator_name) AS id
  FROM (SELECT DISTINCT sim_operator AS operator_name FROM locations))"""

DIM_DEVICE = """dim_device AS (
  SELECT device_id, device_name, first_seen, last_seen, row_number() OVER (ORDER BY device_id) AS id
  FROM (SELECT device_id, arg_max(device_name, timestamp) AS device_name, MIN(timestamp) AS first_seen,
          MAX(timestamp) AS last_seen FROM locations GROUP BY device_id))"""

ORACLE["dim_network"] = with_locations(", " + DIM_NETWORK + " SELECT * FROM dim_network")
ORACLE["dim_operator"] = with_locations(", " + DIM_OPERATOR + " SELECT * FROM dim_operator")
ORACLE["dim_device"] = with_locations(", " + DIM_DEVICE + " SELECT * FROM dim_device")

ORACLE["fact_locations"] = with_locations(", " + DIM_NETWORK + ", " + DIM_OPERATOR + ", " + DIM_DEVICE + """
SELECT l.id AS location_id, CAST(hour(l.timestamp) AS INTEGER) AS time_id,
  CASE l.altitude_range WHEN 'BAJA' THEN 1 WHEN 'MEDIA' THEN 2 WHEN 'ALTA' THEN 3 END AS altitude_id,
  CASE l.battery_level WHEN 'CRITICO' THEN 1 WHEN 'BAJO' THEN 2 WHEN 'MEDIO' THEN 3 WHEN 'ALTO' THEN 4 END AS battery_id,
  n.id AS network_id, o.id AS operator_id, d.id AS device_key, l.date, l.latitude, l.longitude,
  l.altitude, l.speed, l.battery, l.signal
FROM locations l
LEFT JOIN dim_network n ON l.network_type_raw IS NOT DISTINCT FROM n.network_type
LEFT JOIN dim_operator o ON l.sim_operator = o.operator_name
LEFT JOIN dim_device d ON l.device_id = d.device_id""")

# ---------------------------------------------------------------- spatial

SPATIAL = """,
d_edges AS (
  SELECT district_id AS pid, part, ring, seq, x AS x1, y AS y1,
    LEAD(x) OVER (PARTITION BY district_id, part, ring ORDER BY seq) AS x2,
    LEAD(y) OVER (PARTITION BY district_id, part, ring ORDER BY seq) AS y2
  FROM district_vertices),
p_edges AS (
  SELECT province_id AS pid, part, ring, seq, x AS x1, y AS y1,
    LEAD(x) OVER (PARTITION BY province_id, part, ring ORDER BY seq) AS x2,
    LEAD(y) OVER (PARTITION BY province_id, part, ring ORDER BY seq) AS y2
  FROM province_vertices),
d_names AS (SELECT DISTINCT district_id, district_number, district_name FROM district_vertices),
p_names AS (SELECT DISTINCT province_id, province_name FROM province_vertices),
pts AS (SELECT id, latitude AS y, longitude AS x FROM locations),
d_match AS (
  SELECT id, pid FROM (
    SELECT p.id, e.pid, COUNT(*) AS c FROM pts p JOIN d_edges e
      ON e.x2 IS NOT NULL AND (e.y1 > p.y) <> (e.y2 > p.y)
     AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY 1, 2) WHERE c % 2 = 1),
p_match AS (
  SELECT id, pid FROM (
    SELECT p.id, e.pid, COUNT(*) AS c FROM pts p JOIN p_edges e
      ON e.x2 IS NOT NULL AND (e.y1 > p.y) <> (e.y2 > p.y)
     AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY 1, 2) WHERE c % 2 = 1),
d_min AS (SELECT id, MIN(pid) AS district_id FROM d_match GROUP BY id),
p_min AS (SELECT id, MIN(pid) AS province_id FROM p_match GROUP BY id),
independent AS (
  SELECT l.*, dm.district_id, dn.district_name, pm.province_id, pn.province_name
  FROM locations l LEFT JOIN d_min dm USING (id) LEFT JOIN d_names dn USING (district_id)
  LEFT JOIN p_min pm USING (id) LEFT JOIN p_names pn USING (province_id)),
assigned AS (
  SELECT * REPLACE (
    CASE WHEN district_id IS NOT NULL AND province_id IS NOT NULL THEN district_id END AS district_id,
    CASE WHEN district_id IS NOT NULL AND province_id IS NOT NULL THEN district_name END AS district_name,
    CASE WHEN district_id IS NOT NULL AND province_id IS NOT NULL THEN province_id END AS province_id,
    CASE WHEN district_id IS NOT NULL AND province_id IS NOT NULL THEN province_name END AS province_name)
  FROM independent)
"""


def with_spatial(body: str) -> str:
    return with_locations(SPATIAL + body)


ORACLE["district_assignment"] = with_spatial(
    "SELECT id, district_id, district_name, province_id, province_name FROM assigned")
ORACLE["district_assignment_independent"] = with_spatial(
    "SELECT id, district_id, district_name, province_id, province_name FROM independent")

ORACLE["assignment_coverage"] = with_spatial(f"""
, c AS (SELECT COUNT(*) AS total, COUNT(district_id) AS with_district, COUNT(province_id) AS with_province
        FROM assigned)
SELECT total, with_district, with_province, {PCT('with_district', 'total')} AS pct_district,
  {PCT('with_province', 'total')} AS pct_province, total - with_district AS outside FROM c""")


def _top(name: str) -> str:
    return with_spatial(f"""
SELECT {name}, COUNT(*) AS points, {R2(MEAN('battery'))} AS avg_battery, {R2(MEAN('signal'))} AS avg_signal
FROM assigned WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY points DESC, {name} LIMIT 10""")


ORACLE["top_districts"] = _top("district_name")
ORACLE["top_provinces"] = _top("province_name")

MEASURES = """,
ring_terms AS (
  SELECT pid, part, ring,
    list_reduce(list(x1 * y2 - x2 * y1 ORDER BY seq), lambda a, b: a + b) / CAST(2 AS DOUBLE) AS a,
    list_reduce(list((x1 + x2) * (x1 * y2 - x2 * y1) ORDER BY seq), lambda a, b: a + b) / CAST(6 AS DOUBLE) AS mx,
    list_reduce(list((y1 + y2) * (x1 * y2 - x2 * y1) ORDER BY seq), lambda a, b: a + b) / CAST(6 AS DOUBLE) AS my
  FROM d_edges WHERE x2 IS NOT NULL GROUP BY pid, part, ring),
ring_norm AS (
  SELECT pid, part, ring,
    CASE WHEN ring = 0 THEN abs(a) ELSE -abs(a) END AS a_part,
    abs(a) * CASE WHEN ring = 0 THEN 1.0 ELSE -1.0 END AS a_c,
    mx * CASE WHEN ring = 0 THEN sign(a) ELSE -sign(a) END AS mx_c,
    my * CASE WHEN ring = 0 THEN sign(a) ELSE -sign(a) END AS my_c
  FROM ring_terms),
part_area AS (
  SELECT pid, part, list_reduce(list(a_part ORDER BY ring), lambda a, b: a + b) AS pa FROM ring_norm GROUP BY pid, part),
areas AS (
  SELECT pid, list_reduce(list(pa ORDER BY part), lambda a, b: a + b) AS area_deg2 FROM part_area GROUP BY pid),
cents AS (
  SELECT pid,
    list_reduce(list(mx_c ORDER BY part, ring), lambda a, b: a + b)
      / list_reduce(list(a_c ORDER BY part, ring), lambda a, b: a + b) AS cx,
    list_reduce(list(my_c ORDER BY part, ring), lambda a, b: a + b)
      / list_reduce(list(a_c ORDER BY part, ring), lambda a, b: a + b) AS cy
  FROM ring_norm GROUP BY pid),
perims AS (
  SELECT pid, list_reduce(list(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) ORDER BY part, ring, seq),
                          lambda a, b: a + b) AS len_deg
  FROM d_edges WHERE x2 IS NOT NULL GROUP BY pid),
measures AS (
  SELECT a.pid AS district_id, a.area_deg2,
    """ + R2("a.area_deg2 * CAST(111 AS DOUBLE) * CAST(106 AS DOUBLE)") + """ AS area_km2,
    """ + R2("p.len_deg * CAST(108.5 AS DOUBLE)") + """ AS perimeter_km,
    """ + R("c.cx", 6) + """ AS centroid_x, """ + R("c.cy", 6) + """ AS centroid_y
  FROM areas a JOIN perims p USING (pid) JOIN cents c USING (pid))
"""


def with_measures(body: str) -> str:
    return with_spatial(MEASURES + body)


ORACLE["polygon_measures"] = with_measures(
    "SELECT district_id, area_km2, perimeter_km, centroid_x, centroid_y FROM measures")

ORACLE["polygon_totals"] = with_measures("""
SELECT COUNT(*) AS polygons, CAST(SUM(CAST(area_km2 AS DECIMAL(18,6))) AS DOUBLE) AS total_area_km2 FROM measures""")

DISTRICT_STATS = f""",
per AS (
  SELECT m.pid AS district_id, COUNT(*) AS total_locations, COUNT(DISTINCT l.device_id) AS unique_devices,
    {MEAN('l.battery')} AS b, {MEAN('l.signal')} AS s, {MEAN('l.speed')} AS v
  FROM d_match m JOIN locations l ON l.id = m.id GROUP BY m.pid),
dstats AS (
  SELECT n.district_id, n.district_number, n.district_name, ms.area_km2, ms.perimeter_km,
    COALESCE(per.total_locations, 0) AS total_locations, COALESCE(per.unique_devices, 0) AS unique_devices,
    {NULLIF_FALSY(R2('per.b'))} AS avg_battery, {NULLIF_FALSY(R2('per.s'))} AS avg_signal,
    {NULLIF_FALSY(R2('per.v'))} AS avg_speed
  FROM d_names n JOIN measures ms ON ms.district_id = n.district_id
  LEFT JOIN per ON per.district_id = n.district_id)
"""

ORACLE["district_statistics"] = with_measures(DISTRICT_STATS + "SELECT * FROM dstats")

ORACLE["district_density"] = with_measures(DISTRICT_STATS + """
SELECT district_number, district_name, total_locations, area_km2,
  CAST(total_locations AS DOUBLE) / CAST(area_km2 AS DOUBLE) AS density
FROM dstats WHERE area_km2 > 0""")

ORACLE["density_summary"] = with_measures(DISTRICT_STATS + """
, t AS (SELECT SUM(total_locations) AS total_locations,
          CAST(SUM(CAST(area_km2 AS DECIMAL(18,6))) AS DOUBLE) AS total_area_km2,
          COUNT(*) FILTER (WHERE total_locations > 0) AS districts_with_data, COUNT(*) AS districts FROM dstats)
SELECT total_locations, total_area_km2, districts_with_data, districts,
  COALESCE(CAST(total_locations AS DOUBLE) / NULLIF(CAST(total_area_km2 AS DOUBLE), 0), 0.0) AS mean_density
FROM t""")

ORACLE["district_point_count"] = with_spatial("SELECT COUNT(*) AS total FROM d_match WHERE pid = 0")

ORACLE["points_in_district_page"] = with_spatial("""
SELECT l.id, l.device_id, l.latitude, l.longitude FROM d_match m JOIN locations l ON l.id = m.id
WHERE m.pid = 10 ORDER BY l.id LIMIT 1000""")

ORACLE["spatial_modes_agree"] = with_locations("""
SELECT CAST(id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS district_id, CAST(NULL AS BIGINT) AS other_district_id
FROM locations WHERE FALSE""")

# ---------------------------------------------------------------- sinks / incremental / streaming

ORACLE["incremental_etl_grid"] = ORACLE["grid_heatmap"]
ORACLE["stream_ingest_grid"] = ORACLE["grid_heatmap"]
ORACLE["incremental_etl_locations"] = ORACLE["district_assignment"]
ORACLE["incremental_etl_device_days"] = with_locations(f"""
SELECT device_id, device_name, date, COUNT(*) AS points_count, {MEAN('speed')} AS avg_speed,
  MAX(speed) AS max_speed, {MEAN('battery')} AS avg_battery
FROM locations GROUP BY device_id, device_name, date""")

ORACLE["etl_after_crash_grid"] = ORACLE["grid_heatmap"]
ORACLE["etl_duplicate_ids"] = ORACLE["district_assignment"]
ORACLE["stream_replay_locations"] = ORACLE["district_assignment"]

ORACLE["sample_by_district"] = with_spatial("""
, chosen AS (SELECT id FROM locations ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 500)
SELECT COALESCE(district_name, 'Fuera de distritos') AS district_label, COUNT(*) AS points
FROM chosen LEFT JOIN d_min USING (id) LEFT JOIN d_names USING (district_id) GROUP BY 1""")


ORACLE["poi_by_district"] = with_spatial("""
, poi AS (SELECT poi_id AS id, name, latitude AS y, longitude AS x FROM points_of_interest),
poi_hit AS (
  SELECT id, MIN(pid) AS district_id FROM (
    SELECT p.id, e.pid, COUNT(*) AS c FROM poi p JOIN d_edges e
      ON e.x2 IS NOT NULL AND (e.y1 > p.y) <> (e.y2 > p.y)
     AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY 1, 2) WHERE c % 2 = 1 GROUP BY id),
lab AS (
  SELECT poi.id, poi.name, COALESCE(n.district_name, 'Fuera de distritos') AS district_label
  FROM poi LEFT JOIN poi_hit h USING (id) LEFT JOIN d_names n ON n.district_id = h.district_id)
SELECT id, name, district_label, COUNT(*) OVER (PARTITION BY district_label) AS points_in_district FROM lab""")


ORACLE["district_profile"] = with_measures(f"""
, per AS (
  SELECT m.pid AS district_id, COUNT(*) AS total_locations, COUNT(DISTINCT l.device_id) AS unique_devices,
    {R2(MEAN('l.battery'))} AS avg_battery, {R2(MEAN('l.signal'))} AS avg_signal,
    {R2(MEAN('l.speed'))} AS avg_speed, {R2(MEAN('l.altitude'))} AS avg_altitude
  FROM d_match m JOIN locations l ON l.id = m.id GROUP BY m.pid),
nets AS (
  SELECT pid, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS network_distribution FROM (
    SELECT m.pid, l.network_type AS k, COUNT(*) AS v FROM d_match m JOIN locations l ON l.id = m.id GROUP BY 1, 2)
  GROUP BY pid),
ops AS (
  SELECT pid, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS operator_distribution FROM (
    SELECT m.pid, l.sim_operator AS k, COUNT(*) AS v FROM d_match m JOIN locations l ON l.id = m.id GROUP BY 1, 2)
  GROUP BY pid)
SELECT n.district_id, n.district_number, n.district_name, ms.area_km2,
  COALESCE(per.total_locations, 0) AS total_locations, COALESCE(per.unique_devices, 0) AS unique_devices,
  per.avg_battery, per.avg_signal, per.avg_speed, per.avg_altitude,
  CASE WHEN ms.area_km2 > 0 THEN CAST(COALESCE(per.total_locations, 0) AS DOUBLE) / CAST(ms.area_km2 AS DOUBLE) END
    AS density,
  nets.network_distribution, ops.operator_distribution
FROM d_names n JOIN measures ms ON ms.district_id = n.district_id
LEFT JOIN per ON per.district_id = n.district_id
LEFT JOIN nets ON nets.pid = n.district_id LEFT JOIN ops ON ops.pid = n.district_id""")

ORACLE["top_dense_districts"] = with_measures(DISTRICT_STATS + """
SELECT district_number, district_name, total_locations, area_km2,
  CAST(total_locations AS DOUBLE) / CAST(area_km2 AS DOUBLE) AS density
FROM dstats WHERE area_km2 > 0 ORDER BY density DESC, district_number LIMIT 5""")

ORACLE["grid_label_maps"] = with_locations(f"""
, c AS (SELECT CAST(floor(latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_y,
          CAST(floor(longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_x, * FROM locations),
g AS (SELECT cell_y, cell_x, lat_grid, lon_grid, COUNT(*) AS point_count, COUNT(DISTINCT device_id) AS unique_devices,
        {R2(MEAN('battery'))} AS avg_battery, {R2(MEAN('signal'))} AS avg_signal
      FROM c GROUP BY cell_y, cell_x, lat_grid, lon_grid),
n AS (SELECT cell_y, cell_x, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS network_distribution
      FROM (SELECT cell_y, cell_x, network_type AS k, COUNT(*) AS v FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT cell_y, cell_x, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY k) AS operator_distribution
      FROM (SELECT cell_y, cell_x, sim_operator AS k, COUNT(*) AS v FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.*, n.network_distribution, o.operator_distribution
FROM g LEFT JOIN n USING (cell_y, cell_x) LEFT JOIN o USING (cell_y, cell_x)""")

ORACLE["table_counts"] = with_locations("""
SELECT 'events' AS table_name, COUNT(*) AS rows FROM events
UNION ALL SELECT 'nation', COUNT(*) FROM nation
UNION ALL SELECT 'region', COUNT(*) FROM region
UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
UNION ALL SELECT 'locations', COUNT(*) FROM locations""")

ORACLE["reassign_missing"] = ORACLE["district_assignment"]

ORACLE["afternoon_locations"] = with_locations("""
SELECT id, date, hour(timestamp) AS hour_value, period FROM locations
WHERE period = 'TARDE' AND hour(timestamp) >= 12 AND hour(timestamp) <= 18""")

ORACLE["device_day_job"] = ORACLE["device_day_summary"]
ORACLE["district_statistics_one"] = with_measures(DISTRICT_STATS + "SELECT * FROM dstats WHERE district_number = 11")


PARCEL_MEASURES = MEASURES.replace("FROM d_edges", "FROM pc_edges").replace("a.pid AS district_id", "a.pid AS parcel_id")
PARCELS = """,
pc_edges AS (
  SELECT parcel_id AS pid, part, ring, seq, x AS x1, y AS y1,
    LEAD(x) OVER (PARTITION BY parcel_id, part, ring ORDER BY seq) AS x2,
    LEAD(y) OVER (PARTITION BY parcel_id, part, ring ORDER BY seq) AS y2
  FROM parcel_vertices)""" + PARCEL_MEASURES


def with_parcels(body: str) -> str:
    return with_locations(PARCELS + body)


ORACLE["polygon_measures"] = with_parcels(
    "SELECT parcel_id, area_km2, perimeter_km, centroid_x, centroid_y FROM measures")
ORACLE["polygon_totals"] = with_parcels("""
SELECT COUNT(*) AS polygons, CAST(SUM(CAST(area_km2 AS DECIMAL(18,6))) AS DOUBLE) AS total_area_km2 FROM measures""")
ORACLE["geojson_roundtrip"] = with_parcels("SELECT parcel_id, area_km2, perimeter_km FROM measures")
ORACLE["wkt_roundtrip"] = with_parcels("SELECT parcel_id, area_km2, perimeter_km FROM measures")
ORACLE["parcel_assignment"] = with_parcels("""
, hit AS (
  SELECT id, MIN(pid) AS parcel_id FROM (
    SELECT p.id, e.pid, COUNT(*) AS c
    FROM (SELECT id, latitude AS y, longitude AS x FROM locations) p JOIN pc_edges e
      ON e.x2 IS NOT NULL AND (e.y1 > p.y) <> (e.y2 > p.y)
     AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY 1, 2) WHERE c % 2 = 1 GROUP BY id)
SELECT l.id, hit.parcel_id FROM locations l LEFT JOIN hit USING (id)""")

ORACLE["device_day_job_twice"] = ORACLE["device_day_job"]

# ---------------------------------------------------------------- quadtree cover, pyramid, layout

ORACLE["quadtree_assignment"] = ORACLE["district_assignment"]
ORACLE["quadtree_parcel_assignment"] = ORACLE["parcel_assignment"]
ORACLE["pyramid_district_statistics"] = ORACLE["district_statistics"]
ORACLE["pyramid_district_one"] = ORACLE["district_statistics_one"]
ORACLE["pyramid_point_count"] = ORACLE["district_point_count"]
ORACLE["placed_heatmap_filtered"] = ORACLE["heatmap_filtered"]
ORACLE["placed_district_page"] = ORACLE["points_in_district_page"]
ORACLE["indexed_page"] = ORACLE["page_scan"]
ORACLE["pyramid_parcel_statistics"] = with_parcels(f"""
, pc_match AS (
  SELECT id, pid FROM (
    SELECT p.id, e.pid, COUNT(*) AS c
    FROM (SELECT id, latitude AS y, longitude AS x FROM locations) p JOIN pc_edges e
      ON e.x2 IS NOT NULL AND (e.y1 > p.y) <> (e.y2 > p.y)
     AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY 1, 2) WHERE c % 2 = 1),
per AS (
  SELECT m.pid AS parcel_id, COUNT(*) AS total_locations, COUNT(DISTINCT l.device_id) AS unique_devices,
    {MEAN('l.battery')} AS b, {MEAN('l.signal')} AS s, {MEAN('l.speed')} AS v
  FROM pc_match m JOIN locations l ON l.id = m.id GROUP BY m.pid)
SELECT n.parcel_id, n.parcel_name, ms.area_km2, ms.perimeter_km,
  COALESCE(per.total_locations, 0) AS total_locations, COALESCE(per.unique_devices, 0) AS unique_devices,
  {NULLIF_FALSY(R2('per.b'))} AS avg_battery, {NULLIF_FALSY(R2('per.s'))} AS avg_signal, {NULLIF_FALSY(R2('per.v'))} AS avg_speed
FROM (SELECT DISTINCT parcel_id, parcel_name FROM parcel_vertices) n JOIN measures ms USING (parcel_id) LEFT JOIN per USING (parcel_id)""")

# ---------------------------------------------------------------- replay without ids, ids in any order

ORACLE["etl_null_ids"] = with_spatial("""
SELECT id, device_id, latitude, longitude, timestamp, district_id, province_id FROM assigned WHERE id % 10 <> 0
UNION ALL
SELECT CAST(NULL AS BIGINT), device_id, latitude, longitude, timestamp, district_id, province_id FROM (
  SELECT DISTINCT device_id, device_name, latitude, longitude, altitude, speed, battery, signal, sim_operator, sim_operator_raw, network_type,
    network_type_raw, timestamp, altitude_range, battery_level, signal_quality, speed_range, district_id, province_id FROM assigned WHERE id % 10 = 0)""")
ORACLE["etl_ids_in_any_order"] = ORACLE["district_assignment"]

# ---------------------------------------------------------------- mergeable summaries

ORACLE["grid_sketch"] = with_locations(f"""
, c AS (SELECT *, CAST(floor(latitude / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_y, CAST(floor(longitude / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_x FROM locations),
h AS (SELECT cell_y, cell_x, CAST('0x' || substr(md5(device_id), 1, 13) AS BIGINT) AS bits FROM c WHERE device_id IS NOT NULL),
r AS (
  SELECT cell_y, cell_x, bits % 4096 AS register, MAX(CASE WHEN bits // 4096 = 0 THEN 41 ELSE 41 - length(bin(bits // 4096)) END) AS rank
  FROM h GROUP BY 1, 2, 3),
e AS (SELECT cell_y, cell_x, 4096 - COUNT(*) AS zeros, 4096 - COUNT(*) + SUM(pow(2.0, -rank)) AS harmonic FROM r GROUP BY 1, 2),
u AS (
  SELECT cell_y, cell_x, CASE WHEN raw <= 2.5 * 4096 AND zeros > 0 THEN 4096 * ln(4096 / zeros) ELSE raw END AS estimate
  FROM (SELECT *, 0.7213 / (1.0 + 1.079 / 4096) * 4096 * 4096 / harmonic AS raw FROM e)),
g AS (
  SELECT cell_y, cell_x, COUNT(*) AS point_count, {R2(MEAN('battery'))} AS avg_battery, {R2(MEAN('signal'))} AS avg_signal,
    {R2(MEAN('altitude'))} AS avg_altitude, {R2(MEAN('speed'))} AS avg_speed
  FROM c GROUP BY 1, 2)
SELECT g.*, CAST(COALESCE(round(estimate), 0) AS BIGINT) AS unique_devices FROM g LEFT JOIN u USING (cell_y, cell_x)""")
ORACLE["grid_sketch_error"] = with_locations("""
SELECT CAST(id AS BIGINT) AS cell_y, CAST(id AS BIGINT) AS cell_x, CAST(id AS BIGINT) AS estimated, CAST(id AS BIGINT) AS exact FROM locations WHERE FALSE""")
ORACLE["speed_percentiles_by_days"] = ORACLE["speed_percentiles"]
ORACLE["speed_percentiles_of_a_week"] = with_locations(RANKED.replace(
    "WHERE speed IS NOT NULL", "WHERE speed IS NOT NULL AND CAST(timestamp AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
    + f"SELECT {_kth('0.5', 'median')}, {_kth('0.99', 'p99')}")

# ---------------------------------------------------------------- nearest polygon, ring faults

ORACLE["nearest_district"] = with_spatial(f"""
, outside AS (SELECT id, latitude AS y, longitude AS x FROM locations WHERE id NOT IN (SELECT id FROM d_match)),
away AS (
  SELECT id, pid, (x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy)) AS d
  FROM (SELECT o.id, o.x, o.y, e.pid, e.x1, e.y1, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy,
          least(greatest(((o.x - e.x1) * (e.x2 - e.x1) + (o.y - e.y1) * (e.y2 - e.y1))
            / ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)), 0.0), 1.0) AS t
        FROM outside o CROSS JOIN d_edges e WHERE e.x2 IS NOT NULL))
SELECT id, pid AS nearest_id, {R('sqrt(d)', 9)} AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, pid) AS k FROM away) WHERE k = 1""")

ORACLE["polygon_faults"] = with_locations("""
, v AS (
  SELECT parcel_id AS pid, part, ring, CASE WHEN parcel_id % 4 = 1 AND ring = 0 AND part = 0 AND seq IN (1, 2) THEN 3 - seq ELSE seq END AS seq,
    x + CASE WHEN ring = 1 AND parcel_id % 10 = 5 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS x, y
  FROM parcel_vertices),
e AS (
  SELECT pid, part, ring, seq, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2, MAX(seq) OVER (PARTITION BY pid, part, ring) - 1 AS last
  FROM v WINDOW w AS (PARTITION BY pid, part, ring ORDER BY seq)),
ed AS (SELECT * FROM e WHERE x2 IS NOT NULL),
o AS (
  SELECT a.pid, a.part = b.part AND a.ring = b.ring AND b.seq = a.seq + 1 AS following, a.part = b.part AND a.ring = b.ring AND a.seq = 0 AND b.seq = b.last AS closing,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS s1, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS s2,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS s3, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS s4,
    b.x1 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y1 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) AS i1,
    b.x2 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y2 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) AS i2,
    a.x1 BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) AND a.y1 BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2) AS i3,
    a.x2 BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) AND a.y2 BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2) AS i4
  FROM ed a JOIN ed b ON a.pid = b.pid AND (a.part, a.ring, a.seq) < (b.part, b.ring, b.seq)),
m AS (
  SELECT pid, s1 * s2 < 0 AND s3 * s4 < 0 AS crossing,
    (s1 = 0 AND i1 AND NOT following) OR (s2 = 0 AND i2 AND NOT closing) OR (s3 = 0 AND i3 AND NOT closing) OR (s4 = 0 AND i4 AND NOT following) AS touch FROM o),
met AS (SELECT pid, COUNT(*) FILTER (crossing) AS crossings, COUNT(*) FILTER (touch AND NOT crossing) AS touches FROM m GROUP BY pid),
hole AS (
  SELECT v.pid, v.part, v.ring, COUNT(*) FILTER ((e.y1 > v.y) <> (e.y2 > v.y) AND v.x < (e.x2 - e.x1) * (v.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1 AS inside
  FROM v JOIN ed e ON e.pid = v.pid AND e.part = v.part AND e.ring = 0 WHERE v.ring > 0 AND v.seq = 0 GROUP BY 1, 2, 3),
holes AS (SELECT pid, COUNT(*) FILTER (NOT inside) AS holes_outside FROM hole GROUP BY pid)
SELECT p.pid AS parcel_id, COALESCE(crossings, 0) AS crossings, COALESCE(touches, 0) AS touches, COALESCE(holes_outside, 0) AS holes_outside,
  COALESCE(crossings, 0) = 0 AND COALESCE(holes_outside, 0) = 0 AS usable
FROM (SELECT DISTINCT pid FROM v) p LEFT JOIN met USING (pid) LEFT JOIN holes USING (pid)""")

# ---------------------------------------------------------------- reload of polygons, dimension loads, stateful streams

ORACLE["reassign_after_reload"] = ORACLE["district_assignment"]
ORACLE["dim_device_loads"] = with_locations(", " + DIM_DEVICE + " SELECT device_id, device_name, first_seen, last_seen, TRUE AS keys_dense FROM dim_device")
ORACLE["stream_day_summary"] = ORACLE["device_day_summary"]

# ---------------------------------------------------------------- items that only tests showed before

ORACLE["etl_date_bounds"] = with_spatial("""
SELECT id, timestamp, district_id, province_id FROM assigned
WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-12 23:59:59'""")
ORACLE["ledger_reports"] = with_locations("""
, runs AS (
  SELECT 'SUCCESS' AS entry, (SELECT MAX(id) FROM pings WHERE id <= 400) AS last_processed_id, (SELECT COUNT(*) FROM locations WHERE id <= 400) AS records
  UNION ALL SELECT 'SUCCESS', (SELECT MAX(id) FROM pings), (SELECT COUNT(*) FROM locations WHERE id > 400))
SELECT entry, CAST(last_processed_id AS BIGINT) AS last_processed_id, CAST(records AS BIGINT) AS records FROM runs
UNION ALL SELECT 'today', NULL, CAST(SUM(records) AS BIGINT) FROM runs""")
ORACLE["network_group_samples"] = with_locations(f"""
SELECT {NET_KEY} AS network, COUNT(*) AS records, MIN(id) AS sample_id, arg_min(struct_pack(v := device_name), id).v AS sample_device_name,
  arg_min(struct_pack(v := sim_operator), id).v AS sample_sim_operator
FROM pings GROUP BY 1""")
ORACLE["speed_group_samples"] = with_locations(f"""
SELECT {SPEED_RANGE_RAW} AS speed_range, COUNT(*) AS records, MIN(id) AS sample_id, arg_min(struct_pack(v := device_name), id).v AS sample_device_name,
  arg_min(struct_pack(v := speed), id).v AS sample_speed
FROM pings GROUP BY 1""")
ORACLE["one_distribution"] = with_locations("""
SELECT altitude_range AS label, COUNT(*) AS count FROM locations WHERE altitude_range IS NOT NULL GROUP BY 1""")
ORACLE["json_text_pings"] = with_locations("""
SELECT id, device_id, latitude, CASE WHEN id % 31 = 0 THEN NULL ELSE longitude END AS longitude, battery,
  CASE WHEN id % 37 = 0 THEN NULL ELSE speed END AS speed, CASE WHEN id % 41 = 0 THEN NULL ELSE CAST(date_trunc('second', timestamp) AS TIMESTAMP) END AS timestamp,
  concat_ws(',', CASE WHEN id % 31 = 0 THEN 'unparsable_longitude' END, CASE WHEN id % 41 = 0 THEN 'unparsable_timestamp' END) AS errors
FROM pings""")
ORACLE["geojson_polygon_roundtrip"] = with_parcels("SELECT parcel_id, area_km2, perimeter_km FROM measures WHERE parcel_id % 7 <> 3")
ORACLE["null_orphans"] = with_spatial("""
SELECT id, CASE WHEN district_id % 3 <> 0 THEN district_id END AS district_id, CASE WHEN district_id % 3 <> 0 THEN district_name END AS district_name FROM assigned""")
ORACLE["evolved_table"] = with_locations("SELECT id, device_id, CASE WHEN id % 2 = 1 THEN speed END AS speed FROM pings")
ORACLE["backfill_time_fields"] = with_locations("""
SELECT id, CASE WHEN id % 2 = 0 THEN 99 ELSE CAST(hour(timestamp) AS INTEGER) END AS hour_value, period AS time_period,
  CASE period WHEN 'MAÑANA' THEN 'MOR' WHEN 'TARDE' THEN 'AFT' WHEN 'NOCHE' THEN 'NIG' END AS time_period_code, date
FROM locations""")
ORACLE["processed_at_kept"] = with_locations("SELECT id, CASE WHEN id % 2 = 0 THEN timestamp END AS processed_at FROM locations")
