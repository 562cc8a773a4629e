"""SQL texts of the geodesy formulas, for checks by another engine."""

R = 6371000.0


def norm(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def delta(a: str, b: str) -> str:
    d = norm(f"({a}) - ({b})")
    return f"(CASE WHEN {d} > 180 THEN {d} - 360 ELSE {d} END)"


def distance(lat1, lon1, lat2, lon2) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {R} * asin(least(1, sqrt({h}))))"


def bearing(lat1, lon1, lat2, lon2) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return norm(f"degrees(atan2({y}, {x}))")


def drop(d) -> str:
    return f"({d} * {d} / (2 * {R}) * 0.87)"


def angle(h0, h, d) -> str:
    return f"degrees(atan2({h} - ({h0}) - {drop(d)}, {d}))"


def dest_lat(lat, az, d) -> str:
    return f"degrees(asin(sin(radians({lat})) * cos(({d}) / {R}) + cos(radians({lat})) * sin(({d}) / {R}) * cos(radians({az}))))"


def dest_lon(lat, lon, az, d) -> str:
    s2 = f"(sin(radians({lat})) * cos(({d}) / {R}) + cos(radians({lat})) * sin(({d}) / {R}) * cos(radians({az})))"
    lon2 = f"{lon} + degrees(atan2(sin(radians({az})) * sin(({d}) / {R}) * cos(radians({lat})), cos(({d}) / {R}) - sin(radians({lat})) * {s2}))"
    return f"({norm(f'{lon2} + 540')} - 180)"


def merc_y(lat) -> str:
    return f"(0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * pi()))"


def flat(lat1, lon1, lat2, lon2) -> str:
    return f"sqrt(pow(({lat2} - {lat1}) * 111195.0, 2) + pow(({lon2} - {lon1}) * 111195.0 * cos(radians({lat1})), 2))"


def terrain(lat, lon) -> str:
    return f"(1000 + 800 * sin({lat} * 40) * cos({lon} * 35))"


def cell(lat, zoom: int) -> str:
    return f"(40075016.686 * cos(radians({lat})) / {256 * 2**zoom}.0)"


def ladder(table: str, keys: str, radius: str) -> str:
    """A recursive CTE body `ladder` over (keys, lat, lon and the rest of table)."""
    step = f"greatest(10.0, least(d * 0.01, CASE WHEN d < 8000 THEN {cell('lat', 12)} ELSE {cell('lat', 10)} END))"
    return f"ladder AS (SELECT *, 40.0::DOUBLE AS d FROM {table} WHERE {radius} >= 40 UNION ALL SELECT * EXCLUDE (d), d + {step} FROM ladder WHERE d + {step} <= {radius})"


def sampled(source: str) -> str:
    """(SELECT *, h) of rows (lat, lon, az, d): the terrain at the point of the ray."""
    k = "floor(d / 1000)"
    a_lat, b_lat = dest_lat("lat", "az", "k * 1000"), dest_lat("lat", "az", "(k + 1) * 1000")
    a_lon, b_lon = dest_lon("lat", "lon", "az", "k * 1000"), dest_lon("lat", "lon", "az", "(k + 1) * 1000")
    one = f"(SELECT *, {k} AS k, d / 1000 - {k} AS tt FROM {source})"
    two = f"(SELECT *, {a_lat} AS la, {b_lat} AS lb, {a_lon} AS oa, {b_lon} AS ob FROM {one})"
    three = f"(SELECT *, {merc_y('la')} AS ya, {merc_y('lb')} AS yb FROM {two})"
    y = "(ya + (yb - ya) * tt)"
    lat = f"degrees(atan((exp(pi() * (1 - 2 * {y})) - exp(-pi() * (1 - 2 * {y}))) / 2))"
    lon = "(((oa + 180) / 360 + ((ob + 180) / 360 - (oa + 180) / 360) * tt) * 360 - 180)"
    four = f"(SELECT *, {lat} AS q_lat, {lon} AS q_lon FROM {three})"
    return f"(SELECT *, {terrain('q_lat', 'q_lon')} AS h FROM {four})"


def tiles(table: str) -> str:
    """(SELECT *, ty, tx, tdist) for the one-degree tiles within radius."""
    grid = f"(SELECT *, unnest(generate_series(CAST(floor(lat - radius / 111195.0) AS BIGINT), CAST(floor(lat + radius / 111195.0) AS BIGINT))) AS ty FROM {table})"
    grid = f"(SELECT *, unnest(generate_series(CAST(floor(lon - radius / 111195.0 / cos(radians(lat))) AS BIGINT), CAST(floor(lon + radius / 111195.0 / cos(radians(lat))) AS BIGINT))) AS tx FROM {grid})"
    dist = "sqrt(pow(greatest(0, ty - lat, lat - (ty + 1)) * 111195.0, 2) + pow(greatest(0, tx - lon, lon - (tx + 1)) * 111195.0 * cos(radians(lat)), 2))"
    return f"(SELECT * FROM (SELECT *, {dist} AS tdist FROM {grid}) WHERE tdist <= radius)"
