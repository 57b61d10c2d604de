"""Sequences, splits, speed forecasts and time-to-stop models."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.oracle import sql
from queries.registry import SLICE, query, stage
from wayfleet.operators import arrival, forecast, likelihood, live, stops
from wayfleet.operators.scale import cut
from wayfleet.operators.trips import ORDER, TRIP

ORDERED = "(PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id)"


@query("w12_next_timestamp", sql("pings", """
SELECT vehicle_id, max(t_us) AS t_us, CASE WHEN count(g) = 0 THEN 5e0 ELSE round(greatest(1, least(60, avg(g))), 6) END AS step_seconds
FROM (SELECT *, floor((t_us - older) / 1e6) AS g FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk,
         CASE WHEN row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) < 5 THEN lead(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) END AS older
  FROM pings) a WHERE rk <= 5) b GROUP BY vehicle_id"""))
def _(spark, sf):
    return rounded(forecast.next_timestamp(stage(spark, sf, "pings")), ["step_seconds"]).drop("next_us")


@query("w13_last_sequence", sql("live", """
SELECT vehicle_id, arg_max(route, (t_us, ping_id)) AS route, max(t_us) AS t_us, round(sum(latitude), 4) AS lat_sum, round(sum(coalesce(speed_kmh, 0)), 4) AS speed_sum, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM live) x WHERE rk <= 10 GROUP BY vehicle_id
HAVING count(*) = 10 AND max(CASE WHEN rk = 1 THEN route END) IS NOT NULL AND max(CASE WHEN rk = 1 THEN polyline_idx END) IS NOT NULL"""))
def _(spark, sf):
    s = forecast.last_sequence(stage(spark, sf, "live"))
    total = lambda k: F.expr(f"aggregate(filter(sequence, (x, i) -> i % 4 = {k}), 0D, (a, x) -> a + x)")
    return s.select("vehicle_id", "route", "t_us", F.round(total(0), 4).alias("lat_sum"), F.round(total(2), 4).alias("speed_sum"),
                    (F.size("sequence") / 4).cast("long").alias("n"))


def sequences(spark, sf, n=3):
    rows = stage(spark, sf, "l4").filter("eta_seconds IS NOT NULL")
    return forecast.training_sequences(rows, n, ["speed_kmh", "dist_to_end"], slice_seconds=SLICE, rows_per_slice=8)


LAGS = "SELECT *, " + ", ".join(f"lag({c}, {k}) OVER w AS {a}{k}" for c, a in (("s", "s"), ("d", "d")) for k in (1, 2, 3)) + f""", lag(ping_id, 3) OVER w AS full_
FROM (SELECT *, coalesce(speed_kmh, 0) AS s, coalesce(dist_to_end, 0) AS d FROM l4 WHERE eta_seconds IS NOT NULL) x WINDOW w AS {ORDERED}"""


@query("w14_training_sequences", sql("l4", """
SELECT ping_id, round(s3, 4) AS x0, round(d3, 6) AS x1, round(s1, 4) AS x4, round(d1, 6) AS x5, round(eta_seconds, 6) AS target FROM lags WHERE full_ IS NOT NULL""", lags=LAGS))
def _(spark, sf):
    s = sequences(spark, sf)
    at = lambda i, places: F.round(F.col("sequence")[i], places).alias(f"x{i}")
    return s.select("ping_id", at(0, 4), at(1, 6), at(4, 4), at(5, 6), F.round("target", 6).alias("target"))


@query("g17_feature_scaler", sql("l4", """
SELECT CAST(f AS INT) AS feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM (
  SELECT 0 AS f, unnest([s1, s2, s3]) AS x FROM lags WHERE full_ IS NOT NULL UNION ALL SELECT 1, unnest([d1, d2, d3]) FROM lags WHERE full_ IS NOT NULL) u GROUP BY f""", lags=LAGS))
def _(spark, sf):
    return rounded(forecast.scaler(sequences(spark, sf), 2), ["mean", "std"])


@query("w15_l5_split_by_trip", sql("l2", """
SELECT l.ping_id, t.is_test FROM l2 l JOIN (
  SELECT vehicle_id, segment_no, (upto - n < floor(0.2 * sum(n) OVER ()) OR upto = n) AS is_test FROM (
    SELECT *, sum(n) OVER (ORDER BY h, vehicle_id, segment_no ROWS UNBOUNDED PRECEDING) AS upto FROM (
      SELECT vehicle_id, segment_no, count(*) AS n, md5(concat('42|', vehicle_id, '|', CAST(segment_no AS VARCHAR))) AS h FROM l2 GROUP BY vehicle_id, segment_no) a) b) t
ON t.vehicle_id = l.vehicle_id AND t.segment_no = l.segment_no"""))
def _(spark, sf):
    return forecast.split_by_trip(stage(spark, sf, "l2")).select("ping_id", "is_test")


@query("w19_recent_history", sql("l2", """
SELECT vehicle_id, ping_id, age FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS INT) AS age FROM l2) x WHERE age <= 20"""))
def _(spark, sf):
    return forecast.recent_history(stage(spark, sf, "l2"), 20).select("vehicle_id", "ping_id", "age")


# First-order forecasts: regression over the earlier pairs of the trip. Compressed time makes some speeds
# enormous; their logarithm keeps the two engines' rounding comparable.
AR1 = f"""
SELECT *, CASE WHEN pairs >= 2 THEN CASE WHEN spread > 1e-6 THEN slope_ ELSE 0 END END AS slope,
  CASE WHEN pairs >= 2 THEN CASE WHEN spread > 1e-6 THEN intercept_ + slope_ * x ELSE level END END AS predicted
FROM (SELECT *, var_pop(x) OVER e AS spread, count(x) OVER e AS pairs, avg(CASE WHEN x IS NOT NULL THEN y END) OVER e AS level, regr_slope(y, x) OVER e AS slope_, regr_intercept(y, x) OVER e AS intercept_
      FROM (SELECT vehicle_id, segment_no, t_us, ping_id, ln(1 + speed_kmh) AS y, lag(ln(1 + speed_kmh)) OVER w AS x, row_number() OVER w - 1 AS pos FROM l2 WHERE speed_kmh IS NOT NULL WINDOW w AS {ORDERED}) a
      WINDOW e AS (PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b WHERE pos >= 4"""


def ar1(spark, sf):
    rows = stage(spark, sf, "l2").withColumn("log_speed", F.log1p("speed_kmh"))
    return forecast.expanding_ar1(rows, 4, "log_speed", slice_seconds=SLICE, rows_per_slice=8)


@query("w17_expanding_ar1", sql("l2", "SELECT ping_id, pos, round(y, 4) AS actual, round(slope, 3) AS slope, round(predicted, 3) AS predicted FROM ar1", ar1=AR1))
def _(spark, sf):
    return rounded(rounded(ar1(spark, sf).select("ping_id", "pos", "actual", "slope", "predicted"), ["actual"], 4), ["slope", "predicted"], 3)


ERRORS = """round(avg((y - predicted) * (y - predicted)), 3) AS mse, round(sqrt(avg((y - predicted) * (y - predicted))), 3) AS rmse, round(avg(abs(y - predicted)), 3) AS mae,
       count(*) AS n, count(predicted) AS n_ok, round(count(predicted) / count(*), 6) AS success_rate"""


def error_columns(df):
    return rounded(rounded(df, ["mse", "rmse", "mae"], 3), ["success_rate"])


@query("g15_m2_forecast_errors", sql("l2", f"SELECT vehicle_id, segment_no, {ERRORS} FROM ar1 GROUP BY vehicle_id, segment_no", ar1=AR1))
def _(spark, sf):
    return error_columns(forecast.forecast_errors(ar1(spark, sf), ["vehicle_id", "segment_no"]))


@query("g15_pooled_errors", sql("l2", f"SELECT {ERRORS} FROM ar1", ar1=AR1))
def _(spark, sf):
    return error_columns(forecast.forecast_errors(ar1(spark, sf)))


@query("g20_mean_errors", sql("l2", """
SELECT count(*) AS n_models, round(avg(r), 3) AS mean_rmse, round(avg(a), 3) AS mean_mae FROM (
  SELECT sqrt(avg((y - predicted) * (y - predicted))) AS r, avg(abs(y - predicted)) AS a FROM ar1 GROUP BY vehicle_id, segment_no) e""", ar1=AR1))
def _(spark, sf):
    return rounded(forecast.mean_errors(forecast.forecast_errors(ar1(spark, sf), ["vehicle_id", "segment_no"])), ["mean_rmse", "mean_mae"], 3)


# Orders (1,0,0) and (1,1,0): regressions over the earlier pairs of the trip, of levels and of steps.
FIRST_ORDERS = [(1, 0, 0), (1, 1, 0)]
BY_ORDER = f"""
SELECT vehicle_id, segment_no, t_us, ping_id, pos, y, 1 AS p, d, 0 AS q,
  CASE WHEN pairs > 2 THEN back + CASE WHEN spread > 1e-9 THEN intercept_ + slope_ * x ELSE level END END AS predicted
FROM (SELECT *, var_pop(x) OVER e AS spread, count(x) OVER e AS pairs, avg(CASE WHEN x IS NOT NULL THEN z END) OVER e AS level,
             regr_slope(z, x) OVER e AS slope_, regr_intercept(z, x) OVER e AS intercept_
      FROM (SELECT vehicle_id, segment_no, t_us, ping_id, pos, y, 0 AS d, y AS z, prev AS x, 0e0 AS back FROM logs
            UNION ALL SELECT vehicle_id, segment_no, t_us, ping_id, pos, y, 1, y - prev, prev - prev2, prev FROM logs) a
      WINDOW e AS (PARTITION BY vehicle_id, segment_no, d ORDER BY t_us, ping_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b WHERE pos >= 4"""
LOGS = f"""
SELECT vehicle_id, segment_no, t_us, ping_id, ln(1 + speed_kmh) AS y, lag(ln(1 + speed_kmh)) OVER w AS prev, lag(ln(1 + speed_kmh), 2) OVER w AS prev2,
       row_number() OVER w - 1 AS pos FROM l2 WHERE speed_kmh IS NOT NULL WINDOW w AS {ORDERED}"""
SCORES = """
SELECT vehicle_id, segment_no, p, d, q, avg((y - predicted) * (y - predicted)) AS mse, sqrt(avg((y - predicted) * (y - predicted))) AS rmse, count(predicted) AS n_ok
FROM by_order GROUP BY vehicle_id, segment_no, p, d, q"""
ROLLED = """
SELECT p, d, q, round(sum(mse * n_ok) / sum(n_ok), 3) AS weighted_mse, round(sum(rmse * n_ok) / sum(n_ok), 3) AS weighted_rmse, round(avg(mse), 3) AS mean_mse,
       round(stddev_pop(mse), 3) AS std_mse, round(avg(rmse), 3) AS mean_rmse, count(*) AS n_trips, sum(n_ok)::BIGINT AS total_weight FROM scores WHERE mse IS NOT NULL GROUP BY p, d, q"""
ROLLED_COLUMNS = ["weighted_mse", "weighted_rmse", "mean_mse", "std_mse", "mean_rmse"]


def log_speeds(spark, sf, name="l2"):
    return stage(spark, sf, name).withColumn("speed_kmh", F.log1p("speed_kmh"))


def searched(spark, sf, orders):
    return forecast.grid_search(log_speeds(spark, sf), orders, 4, slice_seconds=SLICE, rows_per_slice=8)


@query("w17_expanding_forecasts", sql("l2", "SELECT ping_id, pos, p, d, q, round(y, 4) AS actual, round(predicted, 3) AS predicted FROM by_order", logs=LOGS, by_order=BY_ORDER))
def _(spark, sf):
    made = forecast.expanding_forecasts(log_speeds(spark, sf), FIRST_ORDERS, 4, slice_seconds=SLICE, rows_per_slice=8)
    return rounded(rounded(made.select("ping_id", "pos", "p", "d", "q", "actual", "predicted"), ["actual"], 4), ["predicted"], 3)


@query("g16_rollup_orders", sql("l2", ROLLED, logs=LOGS, by_order=BY_ORDER, scores=SCORES))
def _(spark, sf):
    return rounded(searched(spark, sf, FIRST_ORDERS), ROLLED_COLUMNS, 3)


@query("m3_grid_search", sql("l2", ROLLED, logs=LOGS, by_order=BY_ORDER, scores=SCORES))
def _(spark, sf):
    """A larger order in the grid changes nothing for the smaller ones."""
    rolled = searched(spark, sf, [*FIRST_ORDERS, (4, 0, 0)]).filter("p = 1")
    return rounded(rolled, ROLLED_COLUMNS, 3)


@query("t5_best_orders", sql("l2", "SELECT * FROM (" + ROLLED + ") r ORDER BY weighted_mse, p, d, q LIMIT 1", logs=LOGS, by_order=BY_ORDER, scores=SCORES))
def _(spark, sf):
    return rounded(forecast.best_orders(searched(spark, sf, FIRST_ORDERS), 1), ROLLED_COLUMNS, 3)


@query("m1_first_order_speed", sql("live", """
SELECT vehicle_id, CASE WHEN n >= 4 THEN round(greatest(0, CASE WHEN spread > 1e-9 THEN b + a * last ELSE level END), 3) END AS speed_kmh FROM (
  SELECT vehicle_id, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, var_pop(CASE WHEN x IS NOT NULL THEN x END) AS spread,
         avg(CASE WHEN x IS NOT NULL THEN y END) AS level, arg_min(y, age) AS last
  FROM (SELECT *, lag(y) OVER (PARTITION BY vehicle_id ORDER BY age DESC) AS x FROM (
    SELECT vehicle_id, coalesce(ln(1 + speed_kmh), 0) AS y, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS age FROM live) r WHERE age <= 200) s
  GROUP BY vehicle_id) f WHERE n >= 5"""))
def _(spark, sf):
    return rounded(forecast.forecast_speed(log_speeds(spark, sf, "live"), 1, 0, 0).select("vehicle_id", "speed_kmh"), ["speed_kmh"], 3)


# -- fitted models: no SQL form -------------------------------------------------------------------

@query("m1_forecast_speed")
def _(spark, sf):
    return rounded(forecast.forecast_speed(stage(spark, sf, "live")), ["speed_kmh"], 3)


@query("w17_shock_orders")
def _(spark, sf):
    made = forecast.expanding_forecasts(stage(spark, sf, "l2"), [(2, 0, 1)], 10, slice_seconds=SLICE)
    return rounded(made.select("vehicle_id", "segment_no", "pos", "actual", "predicted"), ["actual", "predicted"], 3)


@query("m3_best_orders")
def _(spark, sf):
    grid = forecast.order_grid((0, 1, 2), (0, 1), (0, 1))
    rolled = forecast.grid_search(stage(spark, sf, "l2"), grid, 10, 20, slice_seconds=SLICE)
    return rounded(forecast.best_orders(rolled), ROLLED_COLUMNS, 2)


@query("l9_speed_forecast_job")
def _(spark, sf):
    split = forecast.split_by_trip(stage(spark, sf, "l2"))
    made = forecast.expanding_forecasts(split.filter("is_test"), [(3, 0, 2)], 10, slice_seconds=SLICE)
    return error_columns(forecast.forecast_errors(cut(made, "forecasts"), ["vehicle_id", "segment_no"]))


def trained(spark, sf, ridges=(1e-6,)):
    models, test = forecast.train_eta(stage(spark, sf, "l4"), n=4, ridges=ridges, slice_seconds=SLICE)
    return cut(models, "models"), test


@query("m4_m8_train_eta_models")
def _(spark, sf):
    models, _ = trained(spark, sf)
    return forecast.list_models(models)


@query("m5_evaluate_eta")
def _(spark, sf):
    models, test = trained(spark, sf)
    return error_columns(forecast.evaluate_eta(test, models))


@query("m6_search_eta")
def _(spark, sf):
    models, test = trained(spark, sf, (1e-8, 1e-4, 1e-2, 1.0))
    return rounded(forecast.search_eta(forecast.evaluate_eta(test, models)), ["rmse", "mae"], 3)


@query("l10_eta_model_job")
def _(spark, sf):
    models, test = trained(spark, sf)
    return rounded(forecast.mean_errors(forecast.evaluate_eta(test, models)), ["mean_rmse", "mean_mae"], 2)


# Given coefficients: an intercept by polyline, a weight by place in the sequence.
GIVEN = """SELECT route, polyline_idx, 1e0 * polyline_idx AS b0 FROM (SELECT DISTINCT route, polyline_idx FROM segments) s WHERE NOT (route = 'WEST' AND polyline_idx = 3)"""
ETAS = """
SELECT vehicle_id, route, polyline_idx, t_us, greatest(0, b0 + dot) AS predicted FROM (
  SELECT x.vehicle_id, x.route, x.polyline_idx, x.t_us, g.b0, sum(0.25e0 * (11 - y.rk) * coalesce(y.speed_kmh, 0) / 10 - 0.5e0 * coalesce(y.dist_to_end, 0) + 0.01e0 * y.latitude) AS dot, count(*) AS n
  FROM recent x JOIN recent y ON y.vehicle_id = x.vehicle_id JOIN given g ON g.route = x.route AND g.polyline_idx = x.polyline_idx WHERE x.rk = 1 GROUP BY ALL) z WHERE n = 10"""
RECENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM live) l WHERE rk <= 10"


def given(spark, sf):
    keys = fx.network(spark, sf).segments.select("route", "polyline_idx").distinct().filter("NOT (route = 'WEST' AND polyline_idx = 3)")
    steps = F.expr("flatten(transform(sequence(1, 10), i -> array(0.01D, 0D, 0.25D * i / 10, -0.5D)))")
    return keys.withColumn("coefficients", F.concat(F.array(F.col("polyline_idx").cast("double")), steps))


@query("m7_predict_eta", sql("live segments", "SELECT vehicle_id, route, polyline_idx, round(predicted, 4) AS predicted, round((t_us + round(predicted * 1e6)) / 1e6, 3) AS eta_s FROM etas",
                             recent=RECENT, given=GIVEN, etas=ETAS))
def _(spark, sf):
    e = forecast.predict_eta(stage(spark, sf, "live"), given(spark, sf))
    return e.select("vehicle_id", "route", "polyline_idx", F.round("predicted", 4).alias("predicted"), F.round(F.col("eta_us") / F.lit(1e6), 3).alias("eta_s"))


# All stop times of a route: visited, next and later stops.
PROJECTED = """
SELECT p.vehicle_id, p.route, s.stop_ord, s.stop_name, CASE WHEN s.stop_ord < p.target THEN 'visited' WHEN s.stop_ord = p.target THEN 'next' ELSE 'later' END AS kind,
  CASE WHEN s.stop_ord < p.target THEN (SELECT max(v.t_us) FROM live v WHERE v.vehicle_id = p.vehicle_id AND v.stop_name = s.stop_name)
       WHEN (SELECT count(*) FROM travel t WHERE t.route = p.route AND t.polyline_idx BETWEEN p.target AND s.stop_ord - 1) = s.stop_ord - p.target
       THEN p.eta_us + coalesce((SELECT CAST(round(sum(t.avg_s) * 1e6) AS BIGINT) FROM travel t WHERE t.route = p.route AND t.polyline_idx BETWEEN p.target AND s.stop_ord - 1), 0) END AS stop_us
FROM (SELECT r.vehicle_id, r.route, r.eta_us, r.polyline_idx + 1 + CASE WHEN st.stop_ord = r.polyline_idx THEN 1 ELSE 0 END AS target
      FROM (SELECT e.vehicle_id, e.route, e.polyline_idx, e.t_us + CAST(round(e.predicted * 1e6) AS BIGINT) AS eta_us, l.stop_name FROM etas e JOIN recent l ON l.vehicle_id = e.vehicle_id AND l.rk = 1) r
      LEFT JOIN stops st ON st.route = r.route AND st.stop_name = r.stop_name) p
JOIN stops s ON s.route = p.route WHERE p.target < 5"""


@query("w11_project_stop_times", sql("live segments stops travel", """
SELECT vehicle_id, route, stop_ord, stop_name, kind, round(stop_us / 1e6, 3) AS stop_s FROM projected WHERE stop_us IS NOT NULL""", recent=RECENT, given=GIVEN, etas=ETAS, projected=PROJECTED))
def _(spark, sf):
    rows = stage(spark, sf, "live")
    ids = rows.select("vehicle_id").distinct()
    latest = live.latest_match(rows, ids).select("vehicle_id", "route", "polyline_idx", "stop_name")
    etas = forecast.predict_eta(rows, given(spark, sf)).select("vehicle_id", "eta_us")
    travel = stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE)
    out = stops.project_stop_times(latest, stops.last_visit_per_stop(rows), etas, travel, fx.network(spark, sf))
    return out.select("vehicle_id", "route", "stop_ord", "stop_name", "kind", F.round(F.col("stop_us") / F.lit(1e6), 3).alias("stop_s"))


@query("m1_likelihood_forecast")
def _(spark, sf):
    return rounded(likelihood.forecast_speed(stage(spark, sf, "live")), ["speed_kmh"], 2)


@query("m1_likelihood_simple_orders", sql("live", """
SELECT vehicle_id, round(greatest(0, avg(v)), 4) AS by_mean, round(greatest(0, arg_min(v, age)), 4) AS by_last
FROM (SELECT vehicle_id, coalesce(speed_kmh, 0) AS v, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS age FROM live) x
WHERE age <= 200 GROUP BY vehicle_id HAVING count(*) >= 5"""))
def _(spark, sf):
    """Two orders whose best forecast is known: the mean without any lag, the last value of a random walk."""
    rows = stage(spark, sf, "live")
    made = lambda order, name: likelihood.forecast_speed(rows, *order).select("vehicle_id", F.col("speed_kmh").alias(name))
    return rounded(made((0, 0, 0), "by_mean").join(made((0, 1, 0), "by_last"), "vehicle_id"), ["by_mean", "by_last"], 4)


@query("m2_forecast_methods")
def _(spark, sf):
    """Errors of likelihood and two-stage regression on each vehicle's last speed."""
    return rounded(likelihood.compare_methods(stage(spark, sf, "live")), ["rmse", "mae"], 2)


def arrival_parts(spark, sf):
    rows = stage(spark, sf, "l4").select(*TRIP, *ORDER, *forecast.MODEL_KEY, *forecast.ETA_FEATURES, "eta_seconds")
    return cut(arrival.three_parts(rows), "parts")


@query("m6_random_search")
def _(spark, sf):
    _, trials = arrival.search(arrival_parts(spark, sf), arrival.draw(3, 42, windows=(2, 4), hidden=(0, 16)), SLICE)
    return rounded(trials.drop("ridge"), ["rmse", "mae"], 2)


@query("m4_nonlinear_eta")
def _(spark, sf):
    """The chosen model on the trips that neither training nor search has seen."""
    parts = arrival_parts(spark, sf)
    model, _ = arrival.search(parts, arrival.draw(2, 42, windows=(2, 4), hidden=(16,)), SLICE)
    return rounded(arrival.test_errors(model, parts, SLICE).select("window", "hidden", "rmse", "mae", "n"), ["rmse", "mae"], 2)
