"""SQL of the stages for the checking engine, written without slices, cells or halos."""

from __future__ import annotations

from queries.fixture import CHAIN, DUCK, NEEDS, ordered

R = 6371.0


def hav(lat1, lon1, lat2, lon2, radius=R):
    a = (f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"power(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * {radius}e0 * atan2(sqrt{a}, sqrt(1 - {a})))"


def share(lat, lon, s=""):
    dx, dy = f"({s}lat2 - {s}lat1)", f"({s}lon2 - {s}lon1)"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    return (f"CASE WHEN {sq} > 1e-12 THEN greatest(0e0, least(1e0, (({lat} - {s}lat1) * {dx} + ({lon} - {s}lon1) * {dy}) / {sq})) "
            "ELSE 0e0 END")


PLACED = f"""
SELECT q.*, {hav('q.latitude', 'q.longitude', 'q.plat', 'q.plon')} AS km FROM (
  SELECT x.*, x.lat1 + x.t * (x.lat2 - x.lat1) AS plat, x.lon1 + x.t * (x.lon2 - x.lon1) AS plon FROM (
    SELECT p.vehicle_id, p.ping_id, p.t_us, p.latitude, p.longitude, s.*,
           {share('p.latitude', 'p.longitude', 's.')} AS t
    FROM pings p CROSS JOIN segments s) x) q"""

PER_LINE = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ping_id, route, polyline_idx
                                            ORDER BY round(km, 9), segment_idx) AS rk FROM placed) r WHERE rk = 1"""

BEST = """
SELECT b.*, (SELECT 1) AS one_ FROM (SELECT *, row_number() OVER (PARTITION BY ping_id
             ORDER BY round(km, 9), route, polyline_idx) AS rb FROM per_line) b WHERE rb = 1"""

L1 = """
SELECT b.vehicle_id, b.ping_id, b.t_us, b.latitude, b.longitude,
       CASE WHEN c.routes = 1 THEN b.km END AS dist_to_route,
       CASE WHEN c.routes = 1 THEN b.plat END AS closest_lat, CASE WHEN c.routes = 1 THEN b.plon END AS closest_lon,
       CASE WHEN c.routes = 1 THEN b.route END AS route,
       CASE WHEN c.lines = 1 THEN b.polyline_idx END AS polyline_idx,
       CASE WHEN c.lines = 1 THEN b.segment_idx END AS segment_idx
FROM best b JOIN (SELECT l.ping_id, count(*) AS lines, count(DISTINCT l.route) AS routes
                  FROM per_line l JOIN best bb ON l.ping_id = bb.ping_id
                  WHERE l.km - bb.km < 0.020 GROUP BY l.ping_id) c ON c.ping_id = b.ping_id"""

MEASURED = f"""
SELECT *, sum(seg_km) OVER (PARTITION BY route, polyline_idx ORDER BY segment_idx) AS cum_end,
       sum(seg_km) OVER (PARTITION BY route, polyline_idx) AS polyline_km
FROM (SELECT *, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS seg_km FROM segments) m"""


def trips(tag, gap, dist):
    """Trip numbers with the vote and the refinement, before short trips go."""
    order = "ORDER BY t_us, ping_id"
    return {
        f"cut_{tag}": f"""
SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id {order}
                                                        ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_no
FROM (SELECT *, (prev_us IS NULL OR t_us - prev_us > {int(gap * 1e6)} OR coalesce(dist_to_route > {dist}, false)
                 OR coalesce(prev_off, false)) AS starts
      FROM (SELECT *, lag(t_us) OVER (PARTITION BY vehicle_id {order}) AS prev_us,
                   lag(coalesce(dist_to_route > {dist}, false)) OVER (PARTITION BY vehicle_id {order}) AS prev_off
            FROM l1) a) b""",
        f"numbered_{tag}": f"""
SELECT *, row_number() OVER (PARTITION BY vehicle_id, segment_no {order}) AS rn,
       count(*) OVER (PARTITION BY vehicle_id, segment_no) AS trip_rows FROM cut_{tag}""",
        f"ballots_{tag}": f"""
SELECT a.ping_id, b.route, b.polyline_idx, count(*) AS votes, sum(count(*)) OVER (PARTITION BY a.ping_id) AS voters
FROM numbered_{tag} a JOIN numbered_{tag} b ON a.vehicle_id = b.vehicle_id AND a.segment_no = b.segment_no
     AND b.rn BETWEEN a.rn - 5 AND a.rn + 5 AND b.rn <> a.rn
WHERE (a.route IS NULL OR a.polyline_idx IS NULL) AND b.route IS NOT NULL
GROUP BY a.ping_id, b.route, b.polyline_idx""",
        f"voted_{tag}": f"""
SELECT n.* EXCLUDE (route, polyline_idx), CASE WHEN w.ping_id IS NULL THEN n.route ELSE w.route END AS route,
       CASE WHEN w.ping_id IS NULL THEN n.polyline_idx ELSE w.polyline_idx END AS polyline_idx
FROM numbered_{tag} n LEFT JOIN (SELECT * FROM ballots_{tag} WHERE votes * 2 > voters) w ON n.ping_id = w.ping_id""",
        f"refined_{tag}": f"""
SELECT v.* EXCLUDE (dist_to_route, closest_lat, closest_lon, segment_idx),
       CASE WHEN f.ping_id IS NULL THEN v.dist_to_route ELSE f.km END AS dist_to_route,
       CASE WHEN f.ping_id IS NULL THEN v.closest_lat ELSE f.plat END AS closest_lat,
       CASE WHEN f.ping_id IS NULL THEN v.closest_lon ELSE f.plon END AS closest_lon,
       CASE WHEN f.ping_id IS NULL THEN v.segment_idx ELSE f.segment_idx END AS segment_idx
FROM voted_{tag} v LEFT JOIN per_line f ON v.segment_idx IS NULL AND f.ping_id = v.ping_id AND f.route = v.route
     AND f.polyline_idx = v.polyline_idx""",
        f"l2_{tag}_all": f"""
SELECT *, CASE WHEN t_us > back_us THEN distance_km / ((t_us - back_us) / 1e6) * 3600 END AS speed_kmh
FROM (SELECT *, {hav('blat', 'blon', 'closest_lat', 'closest_lon')} AS distance_km
      FROM (SELECT *, lag(closest_lat) OVER w AS blat, lag(closest_lon) OVER w AS blon, lag(t_us) OVER w AS back_us
            FROM refined_{tag} WINDOW w AS (PARTITION BY vehicle_id, segment_no {order})) a) b""",
    }


def l2(tag, min_len):
    return f"SELECT * FROM l2_{tag}_all WHERE trip_rows >= {min_len}"


def l3(src, tag):
    order = "(PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id)"
    return {
        f"near_{tag}": f"""
SELECT * FROM (SELECT p.ping_id, s.route AS stop_route, s.stop_name, s.stop_ord, {hav('p.latitude', 'p.longitude', 's.lat', 's.lon')} AS km,
       row_number() OVER (PARTITION BY p.ping_id ORDER BY round({hav('p.latitude', 'p.longitude', 's.lat', 's.lon')}, 9), s.route, s.stop_ord) AS rk
       FROM {src} p CROSS JOIN stops s) n WHERE rk = 1 AND km < 0.020""",
        f"progress_{tag}": f"""
SELECT p.*, n.stop_route, n.stop_name AS seen_stop,
       CASE WHEN m.route IS NOT NULL THEN greatest(0e0, least(m.cum_end - m.seg_km + {hav('m.lat1', 'm.lon1', 'p.closest_lat', 'p.closest_lon')}, m.polyline_km)) END AS dist_from_start,
       m.polyline_km - greatest(0e0, least(m.cum_end - m.seg_km + {hav('m.lat1', 'm.lon1', 'p.closest_lat', 'p.closest_lon')}, m.polyline_km)) AS dist_to_end,
       m.polyline_km AS polyline_length
FROM {src} p LEFT JOIN near_{tag} n ON n.ping_id = p.ping_id
LEFT JOIN measured m ON m.route = p.route AND m.polyline_idx = p.polyline_idx AND m.segment_idx = p.segment_idx""",
        f"jumps_{tag}": f"""
SELECT *, CASE WHEN pass THEN (SELECT s.stop_name FROM stops s WHERE s.route = j.route AND s.stop_ord = j.polyline_idx) END AS passed_stop
FROM (SELECT *, coalesce(route = lag(route) OVER w AND polyline_idx = lag(polyline_idx) OVER w + 1 AND seen_stop IS NULL
                AND lag(seen_stop) OVER w IS NULL AND dist_to_route IS NOT NULL AND lag(dist_to_route) OVER w IS NOT NULL, false) AS pass,
             coalesce(lag(round(dist_to_route, 9)) OVER w < round(dist_to_route, 9), false) AS earlier
      FROM progress_{tag} WINDOW w AS {order}) j""",
        f"l3_{tag}": f"""
SELECT * EXCLUDE (given), coalesce(given, CASE WHEN pass AND NOT earlier THEN passed_stop END, seen_stop) AS stop_name
FROM (SELECT *, lead(CASE WHEN pass AND earlier THEN passed_stop END) OVER {order} AS given FROM jumps_{tag}) g""",
    }


L4 = """
SELECT t.*, (SELECT min(s.t_us) FROM l3 s WHERE s.vehicle_id = t.vehicle_id AND s.segment_no = t.segment_no
             AND s.stop_name IS NOT NULL AND s.t_us > t.t_us) AS next_us
FROM l3 t JOIN (SELECT vehicle_id, segment_no, max((t_us, ping_id)) AS last_at FROM l3 WHERE stop_name IS NOT NULL
                GROUP BY vehicle_id, segment_no) z ON z.vehicle_id = t.vehicle_id AND z.segment_no = t.segment_no
WHERE (t.t_us, t.ping_id) <= z.last_at"""

PAIRS = """
SELECT * FROM (SELECT *, lead(t_us) OVER w AS next_at, lead(stop_name) OVER w AS next_stop
               FROM l3 WHERE stop_name IS NOT NULL
               WINDOW w AS (PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id)) x WHERE next_at > t_us"""

TRAVEL = """
SELECT route, polyline_idx, avg((next_at - t_us) / 1e6) AS avg_s, coalesce(stddev_samp((next_at - t_us) / 1e6), 0) AS std_s,
       count(*) AS n, min((next_at - t_us) / 1e6) AS min_s, max((next_at - t_us) / 1e6) AS max_s
FROM pairs WHERE route IS NOT NULL AND polyline_idx IS NOT NULL GROUP BY route, polyline_idx"""

STAGES = {k: v.format(**DUCK) for k, v in CHAIN.items()}
STAGES.update({"placed": PLACED, "per_line": PER_LINE, "best": BEST, "l1": L1, "measured": MEASURED})
STAGES.update(trips("std", 15, 0.020))
STAGES.update(trips("stop", 30, 0.005))
STAGES["l2"] = l2("std", 3)
STAGES["l2s"] = l2("stop", 3)
STAGES["l2live"] = l2("std", 1)
STAGES.update(l3("l2s", "s"))
STAGES.update(l3("l2live", "v"))
STAGES["l3"] = "SELECT * FROM l3_s"
STAGES["live"] = "SELECT * FROM l3_v"
STAGES["l4"] = "SELECT *, (next_us - t_us) / 1e6 AS eta_seconds FROM (" + L4 + ") e"
STAGES["pairs"] = PAIRS
STAGES["travel"] = TRAVEL
STAGES["geofence_events"] = """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS vehicle_id, ts AS event_time,
       CASE WHEN event_type = 'signup' THEN 'geofenceEntry' ELSE 'geofenceExit' END AS event_type
FROM events WHERE event_type IN ('signup', 'error')"""
STAGES["vehicles"] = """
SELECT id, substr(lpad(id, 3, '0'), -3) AS name, 'vehicle' AS asset_type, concat('FAKE', substr(lpad(id, 3, '0'), -3)) AS license_plate
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events) v"""

_needs = dict(NEEDS)
_needs.update({
    "placed": ["pings", "segments"], "per_line": ["placed"], "best": ["per_line"], "l1": ["best", "per_line"],
    "measured": ["segments"], "l2": ["l2_std_all"], "l2s": ["l2_stop_all"], "l2live": ["l2_std_all"], "l3": ["l3_s"],
    "live": ["l3_v"], "l4": ["l3"], "pairs": ["l3"], "travel": ["pairs"]})
for t in ("std", "stop"):
    _needs.update({f"cut_{t}": ["l1"], f"numbered_{t}": [f"cut_{t}"], f"ballots_{t}": [f"numbered_{t}"],
                   f"voted_{t}": [f"numbered_{t}", f"ballots_{t}"], f"refined_{t}": [f"voted_{t}", "per_line"],
                   f"l2_{t}_all": [f"refined_{t}"]})
for t, src in (("s", "l2s"), ("v", "l2live")):
    _needs.update({f"near_{t}": [src, "stops"], f"progress_{t}": [f"near_{t}", "measured", src],
                   f"jumps_{t}": [f"progress_{t}", "stops"], f"l3_{t}": [f"jumps_{t}"]})


def sql(names: str, body: str, **extra: str) -> str:
    """``body`` behind the WITH clause of the stages it names; ``extra`` adds sub-queries of its own."""
    chain = ordered(names.split(), _needs)
    ctes = {n: STAGES[n] for n in chain} | extra
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in ctes.items()) + "\n" + body
