"""Column -> Column classifiers (all JVM-side CASE chains, no Python UDF).

Each function takes Columns (or column names) and returns a Column, so it can
be used inside one ``select`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_of_day(ts: Column | str) -> Column:
    """MAÑANA for 6 <= hour < 12, TARDE for 12 <= hour < 19, else NOCHE (null -> NOCHE)."""
    return period_from_hour(F.hour(_c(ts)))


def period_from_hour(hour: Column | str) -> Column:
    """F01 on an hour of day (0-23)."""
    h = _c(hour)
    return (F.when((h >= 6) & (h < 12), F.lit(S.PERIOD_MORNING))
            .when((h >= 12) & (h < 19), F.lit(S.PERIOD_AFTERNOON))
            .otherwise(F.lit(S.PERIOD_NIGHT)))


def period_code(period: Column | str) -> Column:
    """three-letter code of a period label."""
    p = _c(period)
    expr = None
    for label, code in S.PERIOD_CODES.items():
        expr = (F.when(p == label, F.lit(code)) if expr is None else expr.when(p == label, F.lit(code)))
    return expr


def altitude_range(altitude: Column | str) -> Column:
    """null -> null, <= 400 BAJA, <= 500 MEDIA, else ALTA."""
    a = _c(altitude)
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(a <= S.ALTITUDE_LOW_MAX, F.lit("BAJA"))
            .when(a <= S.ALTITUDE_MEDIUM_MAX, F.lit("MEDIA"))
            .otherwise(F.lit("ALTA")))


def battery_level(battery: Column | str) -> Column:
    """null -> null, < 25 CRITICO, < 50 BAJO, < 75 MEDIO, else ALTO."""
    b = _c(battery)
    return (F.when(b.isNull(), F.lit(None).cast("string"))
            .when(b < 25, F.lit("CRITICO"))
            .when(b < 50, F.lit("BAJO"))
            .when(b < 75, F.lit("MEDIO"))
            .otherwise(F.lit("ALTO")))


def signal_quality(signal: Column | str) -> Column:
    """null -> null, >= -60 EXCELENTE, >= -70 BUENA, >= -80 REGULAR, else POBRE."""
    s = _c(signal)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s >= -60, F.lit("EXCELENTE"))
            .when(s >= -70, F.lit("BUENA"))
            .when(s >= -80, F.lit("REGULAR"))
            .otherwise(F.lit("POBRE")))


def network_generation(network_type: Column | str, strict: bool = False) -> Column:
    """F04a (live) / F04b (strict) network generation.

    live: null -> SIN DATOS; first case-insensitive regex match of WiFi, 5G, 4G
    (incl. any 'mobile'), 3G, 2G; else SIN DATOS.
    strict: blank -> SIN DATOS; upper-cased trimmed substrings; 'MOBILE' is 4G
    only when the trimmed text is shorter than 15 characters.
    """
    n = _c(network_type)
    if not strict:
        expr = F.when(n.isNull(), F.lit(S.NET_NONE))
        for label, pattern in S.NETWORK_PATTERNS_LIVE:
            expr = expr.when(n.rlike(f"(?iu){pattern}"), F.lit(label))
        return expr.otherwise(F.lit(S.NET_NONE))
    t = F.upper(F.trim(n))
    expr = F.when(n.isNull() | (F.trim(n) == ""), F.lit(S.NET_NONE))
    for label, subs in S.NETWORK_SUBSTRINGS_STRICT:
        cond = None
        for s in subs:
            c = t.contains(s)
            cond = c if cond is None else (cond | c)
        if label == S.NET_4G:
            cond = cond | (t.contains("MOBILE") & (F.length(t) < S.NETWORK_MOBILE_MAX_LEN))
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(S.NET_NONE))


def normalize_operator(sim_operator: Column | str, strict: bool = False) -> Column:
    """F06a (live) / F06b (strict) operator normalisation.

    live: null or '' -> SIN SEÑAL; regex (case-insensitive, Unicode folding)
    unknown|sin señ|sin seal|n/a -> SIN SEÑAL; ENTEL variants; TIGO; VIVA; else unchanged.
    strict: blank -> SIN SEÑAL; trim + upper; exact no-signal list; ENTEL
    substrings; TIGO; VIVA; any 'SIN'/'SEAL' -> SIN SEÑAL; else the upper-cased text.
    """
    o = _c(sim_operator)
    if not strict:
        return (F.when(o.isNull(), F.lit(S.OP_NO_SIGNAL))
                .when(o == "", F.lit(S.OP_NO_SIGNAL))
                .when(o.rlike(f"(?iu){S.OPERATOR_NO_SIGNAL_PATTERN_LIVE}"), F.lit(S.OP_NO_SIGNAL))
                .when(o.rlike(f"(?iu){S.OPERATOR_ENTEL_PATTERN_LIVE}"), F.lit(S.OP_ENTEL))
                .when(o.rlike(f"(?iu){S.OPERATOR_TIGO_PATTERN_LIVE}"), F.lit(S.OP_TIGO))
                .when(o.rlike(f"(?iu){S.OPERATOR_VIVA_PATTERN_LIVE}"), F.lit(S.OP_VIVA))
                .otherwise(o))
    u = F.upper(F.trim(o))

    def any_of(subs):
        cond = None
        for s in subs:
            c = u.contains(s)
            cond = c if cond is None else (cond | c)
        return cond

    return (F.when(o.isNull() | (F.trim(o) == ""), F.lit(S.OP_NO_SIGNAL))
            .when(u.isin(*S.OPERATOR_NO_SIGNAL_EXACT_STRICT), F.lit(S.OP_NO_SIGNAL))
            .when(any_of(S.OPERATOR_ENTEL_SUBSTRINGS_STRICT), F.lit(S.OP_ENTEL))
            .when(u.contains(S.OP_TIGO), F.lit(S.OP_TIGO))
            .when(u.contains(S.OP_VIVA), F.lit(S.OP_VIVA))
            .when(any_of(S.OPERATOR_NO_SIGNAL_SUBSTRINGS_STRICT), F.lit(S.OP_NO_SIGNAL))
            .otherwise(u))


def speed_kmh(speed_ms: Column | str) -> Column:
    """m/s -> km/h."""
    return _c(speed_ms) * F.lit(S.MS_TO_KMH)


def speed_range(speed_ms: Column | str) -> Column:
    """null or 0 -> DETENIDO; km/h <= 5 CAMINANDO, <= 10 CORRIENDO, <= 60 TRANSPORTE PÚBLICO, else VEHÍCULO.

    Negative speeds fall into CAMINANDO, as in the reference.
    """
    s = _c(speed_ms)
    k = speed_kmh(s)
    return (F.when(s.isNull() | (s == 0), F.lit(S.SPEED_STOPPED))
            .when(k <= S.SPEED_WALKING_MAX_KMH, F.lit(S.SPEED_WALKING))
            .when(k <= S.SPEED_RUNNING_MAX_KMH, F.lit(S.SPEED_RUNNING))
            .when(k <= S.SPEED_TRANSIT_MAX_KMH, F.lit(S.SPEED_TRANSIT))
            .otherwise(F.lit(S.SPEED_VEHICLE)))


def speed_histogram_bucket(speed_ms: Column | str) -> Column:
    """A20 bucket label (m/s): 0, (0,2), [2,5), [5,10), [10,20), [20,30), >= 30."""
    s = _c(speed_ms)
    labels = [lbl for lbl, _ in S.SPEED_HISTOGRAM]
    return (F.when(s == 0, F.lit(labels[0]))
            .when(s < 2, F.lit(labels[1]))
            .when(s < 5, F.lit(labels[2]))
            .when(s < 10, F.lit(labels[3]))
            .when(s < 20, F.lit(labels[4]))
            .when(s < 30, F.lit(labels[5]))
            .otherwise(F.lit(labels[6])))


def ordinal(label: Column | str, order: list[str]) -> Column:
    """Position of a label in a fixed order (1-based); unknown labels sort last."""
    c = _c(label)
    expr = None
    for i, v in enumerate(order, start=1):
        expr = F.when(c == v, F.lit(i)) if expr is None else expr.when(c == v, F.lit(i))
    return expr.otherwise(F.lit(len(order) + 1))


def grid_index(coord: Column | str, grid_size: float) -> Column:
    """integer cell index floor(x / g) (bigint)."""
    return F.floor(_c(coord) / F.lit(float(grid_size)))


def grid_snap(coord: Column | str, grid_size: float) -> Column:
    """snapped coordinate floor(x / g) * g (double)."""
    return grid_index(coord, grid_size) * F.lit(float(grid_size))


def ewkt_point(lon: Column | str, lat: Column | str) -> Column:
    """'SRID=4326;POINT(lon lat)'."""
    return F.concat(F.lit(f"SRID={S.SRID};POINT("), _c(lon).cast("string"), F.lit(" "),
                    _c(lat).cast("string"), F.lit(")"))


def ewkt_cell(lon0: Column | str, lat0: Column | str, grid_size: float) -> Column:
    """cell polygon, 5 vertices counter-clockwise from the lower-left corner."""
    x0, y0 = _c(lon0), _c(lat0)
    g = F.lit(float(grid_size))
    x1, y1 = x0 + g, y0 + g

    def pt(x, y):
        return [x.cast("string"), F.lit(" "), y.cast("string")]

    parts = [F.lit(f"SRID={S.SRID};POLYGON((")]
    for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]):
        if i:
            parts.append(F.lit(","))
        parts.extend(pt(x, y))
    parts.append(F.lit("))"))
    return F.concat(*parts)


def time_decomposition(ts: Column | str) -> dict[str, Column]:
    """date, hour_value, time_period, time_period_code, time_id (= hour)."""
    t = _c(ts)
    period = period_of_day(t)
    return {
        "date": F.to_date(t),
        "hour_value": F.hour(t),
        "time_period": period,
        "time_period_code": period_code(period),
        "time_id": F.hour(t),
    }
