"""Plain Python counterparts and small inputs."""

import math

from wayfleet.sources.network import Network

SEGMENT_SCHEMA = "route string, polyline_idx int, segment_idx int, lat1 double, lon1 double, lat2 double, lon2 double"
STOP_SCHEMA = "route string, stop_ord int, stop_name string, lat double, lon double"


def haversine(lat1, lon1, lat2, lon2, radius=6371.0):
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * radius * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def nearest_on(lat, lon, s):
    dy, dx = s["lat2"] - s["lat1"], s["lon2"] - s["lon1"]
    sq = dy * dy + dx * dx
    t = min(1.0, max(0.0, ((lat - s["lat1"]) * dy + (lon - s["lon1"]) * dx) / sq)) if sq > 1e-12 else 0.0
    return haversine(lat, lon, s["lat1"] + t * dy, s["lon1"] + t * dx)


def exhaustive_match(lat, lon, segments, threshold):
    per_line = {}
    for s in segments:
        key, km = (s["route"], s["polyline_idx"]), nearest_on(lat, lon, s)
        rank = (round(km, 9), s["segment_idx"])
        if key not in per_line or rank < per_line[key][0]:
            per_line[key] = (rank, km, s["segment_idx"])
    ranked = sorted(per_line.items(), key=lambda kv: (kv[1][0][0], kv[0]))
    best = ranked[0][1][1]
    close = [k for k, v in per_line.items() if v[1] - best < threshold]
    (route, line), (_, km, seg) = ranked[0]
    if len(close) == 1:
        return route, line, seg, km
    return (route, None, None, km) if len({k[0] for k in close}) == 1 else (None, None, None, None)


def make_network(spark, segments, stops, polyline_stops=()):
    return Network(spark.createDataFrame(segments, SEGMENT_SCHEMA), spark.createDataFrame(stops, STOP_SCHEMA),
                   spark.createDataFrame(list(polyline_stops), "route string, polyline_idx int, stop_name string"))


def pings_df(spark, rows, extra=""):
    """rows: (vehicle_id, seconds, ...)."""
    made = [(v, int(s * 1e6), i, *rest) for i, (v, s, *rest) in enumerate(rows)]
    return spark.createDataFrame(made, "vehicle_id string, t_us long, ping_id long" + (", " + extra if extra else ""))


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("ping_id").collect()]
