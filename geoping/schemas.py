"""Fixed schemas and label values.

The labels and thresholds below are fixed values that must equal the ones the
reference emits, so results can be compared label for label.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (labels, thresholds, patterns) -- must match the reference.
# ---------------------------------------------------------------------------

# Period of day (hour of the ping timestamp).
PERIOD_MORNING = "MAÑANA"      # 6 <= hour < 12
PERIOD_AFTERNOON = "TARDE"     # 12 <= hour < 19
PERIOD_NIGHT = "NOCHE"         # otherwise, also a null timestamp
PERIOD_ORDER = ["MAÑANA", "TARDE", "NOCHE"]
PERIOD_CODES = {"MAÑANA": "MOR", "TARDE": "AFT", "NOCHE": "NIG"}

# Altitude range (metres): <= 400 BAJA, <= 500 MEDIA, else ALTA.
ALTITUDE_ORDER = ["BAJA", "MEDIA", "ALTA"]
ALTITUDE_LOW_MAX = 400
ALTITUDE_MEDIUM_MAX = 500
# dim_altitude rows: (label, min, max)
ALTITUDE_DIM = [("BAJA", 0.0, 400.0), ("MEDIA", 400.0, 500.0), ("ALTA", 500.0, 1000.0)]

# Battery level (percent): < 25 CRITICO, < 50 BAJO, < 75 MEDIO, else ALTO.
BATTERY_ORDER = ["CRITICO", "BAJO", "MEDIO", "ALTO"]
BATTERY_DIM = [("CRITICO", 0.0, 25.0), ("BAJO", 25.0, 50.0), ("MEDIO", 50.0, 75.0), ("ALTO", 75.0, 100.0)]

# Signal quality (dBm): >= -60 EXCELENTE, >= -70 BUENA, >= -80 REGULAR, else POBRE.
SIGNAL_ORDER = ["EXCELENTE", "BUENA", "REGULAR", "POBRE"]

# Network generation labels and the live (regex, first match wins) rule.
NET_WIFI, NET_5G, NET_4G, NET_3G, NET_2G, NET_NONE = "WiFi", "5G", "4G", "3G", "2G", "SIN DATOS"
NETWORK_LABELS = ["WiFi", "5G", "4G", "3G", "2G", "SIN DATOS"]
NETWORK_PATTERNS_LIVE = [
    ("WiFi", "wifi|wi-fi"),
    ("5G", "5G"),
    ("4G", "4G|LTE|mobile"),
    ("3G", "3G|HSDPA|HSPA|UMTS|WCDMA"),
    ("2G", "2G|EDGE|GPRS|GSM"),
]
# Strict rule: upper-cased substrings; "MOBILE" counts as 4G only when the
# trimmed text is shorter than 15 characters.
NETWORK_SUBSTRINGS_STRICT = [
    ("WiFi", ["WIFI", "WI-FI"]),
    ("5G", ["5G"]),
    ("4G", ["4G", "LTE"]),
    ("3G", ["3G", "HSDPA", "HSPA", "UMTS", "WCDMA"]),
    ("2G", ["2G", "EDGE", "GPRS", "GSM"]),
]
NETWORK_MOBILE_MAX_LEN = 15

# Operator normalisation.
OP_NO_SIGNAL, OP_ENTEL, OP_TIGO, OP_VIVA = "SIN SEÑAL", "ENTEL", "TIGO", "VIVA"
OPERATOR_NO_SIGNAL_PATTERN_LIVE = "unknown|sin señ|sin seal|n/a"
OPERATOR_ENTEL_PATTERN_LIVE = "entel|bomov|18vacunate|distancia|movil gsm|t-mobile"
OPERATOR_TIGO_PATTERN_LIVE = "tigo"
OPERATOR_VIVA_PATTERN_LIVE = "viva"
OPERATOR_NO_SIGNAL_EXACT_STRICT = ["UNKNOWN", "SIN SEÑAL", "SIN SEAL", "N/A", "NA"]
OPERATOR_ENTEL_SUBSTRINGS_STRICT = ["ENTEL", "BOMOV", "+18VACUNATE", "LADISTANCIANOSCUIDA", "MOVIL GSM", "T-MOBILE"]
OPERATOR_NO_SIGNAL_SUBSTRINGS_STRICT = ["SIN", "SEAL"]

# Speed range from m/s, thresholds in km/h (speed * 3.6).
SPEED_STOPPED, SPEED_WALKING, SPEED_RUNNING, SPEED_TRANSIT, SPEED_VEHICLE = (
    "DETENIDO", "CAMINANDO", "CORRIENDO", "TRANSPORTE PÚBLICO", "VEHÍCULO")
SPEED_ORDER = ["DETENIDO", "CAMINANDO", "CORRIENDO", "TRANSPORTE PÚBLICO", "VEHÍCULO"]
MS_TO_KMH = 3.6
SPEED_WALKING_MAX_KMH = 5
SPEED_RUNNING_MAX_KMH = 10
SPEED_TRANSIT_MAX_KMH = 60

# Speed histogram in m/s: (label, lower bound inclusive) -- 0 is its own bucket.
SPEED_HISTOGRAM = [
    ("Detenido (0 m/s)", None),
    ("Muy lento (0.1-2 m/s)", 0.0),
    ("Lento (2-5 m/s)", 2.0),
    ("Caminando (5-10 m/s)", 5.0),
    ("Moderado (10-20 m/s)", 10.0),
    ("Rápido (20-30 m/s)", 20.0),
    ("Muy rápido (>30 m/s)", 30.0),
]
SPEED_PERCENTILES = [0.25, 0.5, 0.75, 0.90, 0.95, 0.99]

# Geometry.
SRID = 4326
KM_PER_DEG_AREA_X = 111.0      # area km2 = planar deg2 * 111 * 106
KM_PER_DEG_AREA_Y = 106.0
KM_PER_DEG_LENGTH = 108.5      # perimeter km = planar degree length * 108.5
DEFAULT_GRID_SIZE = 0.01
OUTSIDE_DISTRICTS = "Fuera de distritos"

# Run ledger status values.
STATUS_SUCCESS, STATUS_FAILED = "SUCCESS", "FAILED"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# Raw ping as it arrives (JSON lines / REST export). Numeric fields are read as
# strings so that dirty text never fails the read; ``normalise_pings`` casts.
RAW_PING_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
    T.StructField("altitude", T.StringType()),
    T.StructField("speed", T.StringType()),
    T.StructField("battery", T.StringType()),
    T.StructField("signal", T.StringType()),
    T.StructField("sim_operator", T.StringType()),
    T.StructField("network_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

# Typed ping after normalisation.
PING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("battery", T.DoubleType()),
    T.StructField("signal", T.DoubleType()),
    T.StructField("sim_operator", T.StringType()),
    T.StructField("network_type", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

PING_COLUMNS = [f.name for f in PING_SCHEMA.fields]

# Run ledger (one row per ETL run).
LEDGER_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("execution_date", T.TimestampType()),
    T.StructField("last_processed_id", T.LongType()),
    T.StructField("records_processed", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("execution_time_seconds", T.DoubleType()),
    T.StructField("error_message", T.StringType()),
])

# Device-day summary table.
DEVICE_DAY_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("points_count", T.LongType()),
    T.StructField("avg_speed", T.DoubleType()),
    T.StructField("max_speed", T.DoubleType()),
    T.StructField("avg_battery", T.DoubleType()),
])

# Polygon vertex table: one row per ring vertex, rings closed (last == first).
VERTEX_SCHEMA = T.StructType([
    T.StructField("polygon_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("ring", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
# MultiPolygon: parts -> rings -> points; ring 0 of a part is the shell, others are holes.
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
EDGE = T.StructType([
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType()),
])

# Location table columns written by the ETL (order of the target table).
LOCATION_COLUMNS = [
    "id", "device_id", "device_name", "latitude", "longitude", "altitude", "speed", "battery", "signal",
    "sim_operator", "sim_operator_raw", "network_type", "network_type_raw", "network_generation",
    "timestamp", "date", "period", "altitude_range", "battery_level", "signal_quality", "speed_range",
    "location_geom", "lat_grid", "lon_grid", "district_id", "district_name", "province_id", "province_name",
    "processed_at",
]
