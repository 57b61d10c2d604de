import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from queries import fixture as fx
from wayfleet.operators.scale import cut
from wayfleet.plans import enrich
from wayfleet.streaming import jobs, state

SF = "/root/testdata/sf0.001"
COLUMNS = ["vehicle_id", "ping_id", "segment_no", "route", "polyline_idx", "segment_idx", "stop_name"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS, F.round("speed_kmh", 6)).collect())


@pytest.mark.parametrize("batch_of, parts, delay", [("t_us", 3, 20.0), ("ping_id * 7919 % 3", 3, 3600.0)])
def test_streamed_trips_equal_the_batch_result(spark, tmp_path, batch_of, parts, delay):
    """In time order with a short delay, and scrambled with one that covers everything; then a last row far ahead lets all others leave."""
    net, pings = fx.network(spark, SF), cut(fx.pings(spark, SF))
    whole = rows(enrich.live_job(pings, net))
    matched = cut(enrich.preprocess(pings, net).select("vehicle_id", *state.COLUMNS))
    first, last = matched.agg(F.min("t_us"), F.max("t_us")).first()
    no = F.expr(batch_of) if "%" in batch_of else F.floor((F.col("t_us") - first) / ((last - first) // parts + 1))
    end = matched.limit(1).withColumn("vehicle_id", F.lit("end")).withColumn("t_us", F.lit(last + int((delay + 400) * 1e6)))
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in [*(matched.filter(no == i) for i in range(parts)), matched.filter(no == parts - 1).limit(0).union(end)]:
        part.coalesce(1).write.mode("append").parquet(path)
        query = state.stateful_enrich(state.read_matched(spark, path), net, out, cp, None, delay)
        query.awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.drop("batch")) == whole
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    assert progress and got.groupBy("vehicle_id", "ping_id").count().filter("count > 1").count() == 0


def test_numbers_go_on_from_the_last_row():
    frame = lambda *r: pd.DataFrame([(t, d, n) for t, d, n in r], columns=["t_us", "dist_to_route", "segment_no"])
    held, last = state.number(frame((0, 0.0, None), (10, 0.0, None), (40, 0.0, None), (50, 9.0, None), (60, 0.0, None), (70, np.nan, None), (200, 0.0, None)),
                              (None, False, 0, -1), 100, 15, 1.0)
    assert held["segment_no"].tolist()[:6] == [1, 1, 2, 3, 4, 4] and pd.isna(held["segment_no"][6]) and last == (70, False, 4, -1)
    held, last = state.number(frame((70, 0.0, 4), (80, 0.0, None)), last, 100, 15, 1.0)
    assert held["segment_no"].tolist() == [4, 4] and last == (80, False, 4, -1)


SECOND = 1_000_000


def held(*given):
    """Columns of rows ``(vehicle, seconds, ping, dist, number)``."""
    names = {"vehicle_id": 0, "t_us": 1, "ping_id": 2, "dist_to_route": 3, "segment_no": 4}
    value = lambda c, r: (r[2] is not None) if c == "has_ping" else r[names[c]] if c in names else None
    known = {"vehicle_id": lambda v: v, "t_us": lambda v: int(v * SECOND), "dist_to_route": lambda v: np.nan if v is None else v}
    part = {c: [known.get(c, lambda v: v or 0)(value(c, r)) for r in given] for c in state.HELD}
    return {c: np.array([None] * len(given) if c == "route" else part[c], t) for c, t in state.HELD.items()}


def advance(rows, last, watermark):
    return state.advanced(rows, last, watermark * SECOND, 15 * SECOND, 0.02, 120 * SECOND)


def told(columns, *names):
    return sorted(zip(*(columns[c].tolist() for c in names)), key=str)


def plain_cutter():
    """A ``TripCutter`` with its state in memory."""
    rows, value = SimpleNamespace(kept=[]), SimpleNamespace(held=None)
    rows.get, rows.put = lambda: iter(rows.kept), lambda new: setattr(rows, "kept", new)
    value.get, value.update = lambda: value.held, lambda new: setattr(value, "held", new)
    cutter = state.TripCutter(15.0, 0.02, 120.0)
    cutter.init(SimpleNamespace(getListState=lambda *_: rows, getValueState=lambda *_: value, registerTimer=lambda at: None))
    return cutter


def test_vehicles_of_a_group_do_not_mix():
    """Several vehicles at once, one without an id, rows delivered again and two pings of one time, as each alone, in columns and in plain rows."""
    draw = np.random.default_rng(3)
    both, alone = (state.joined([], state.HELD), state.joined([], state.LAST)), {}
    plain = {}
    for batch in range(6):
        at = batch * 150
        new = [(v, at + 1 + int(draw.integers(0, 300)), int(draw.integers(1, 99)) if draw.random() > 0.1 else None, draw.choice([0.0, 0.01, 0.5]), 0)
               for v in ("a", "b", None) for _ in range(int(draw.integers(0, 30)))]
        new += new[:5]
        emitted, *both, due = advance(state.joined([both[0], held(*new)], state.HELD), both[1], at)
        parts, dues, home = [], [], []
        for v in ("a", "b", None):
            rows, last = alone.get(v, (state.joined([], state.HELD), state.joined([], state.LAST)))
            part, *alone[v], first = advance(state.joined([rows, held(*(r for r in new if r[0] == v))], state.HELD), last, at)
            parts.append(part)
            dues += [first] if first is not None else []
            plain.setdefault(v, plain_cutter())
            given = [(p, t * SECOND, *[0.0] * 2, d, *[0.0] * 2, *[None] * 4) for w, t, p, d, _ in new if w == v]
            home += [(v, r["t_us"], r["ping_id"] is not None, r["ping_id"] or 0, r["segment_no"], True) for r in plain[v]._advance((v,), given, at * SECOND) if r["_home"]]
        columns = ("vehicle_id", "t_us", "has_ping", "ping_id", "segment_no", "_home")
        assert told(emitted, *columns) == sorted((r for p in parts for r in told(p, *columns)), key=str) and due == min(dues, default=None)
        assert [r for r in told(emitted, *columns) if r[-1]] == sorted(home, key=str)
    assert told(both[0], "vehicle_id", "t_us", "segment_no") == sorted((r for v in alone for r in told(alone[v][0], "vehicle_id", "t_us", "segment_no")), key=str)
    for types, columns in zip((state.HELD, state.LAST), both):
        again = state.unpacked(state.packed(columns, types))
        assert all(np.array_equal(again[c], columns[c], equal_nan=types[c] == "float64") for c in types)


def test_only_the_context_of_the_same_trip_goes_along():
    rows = held(*[("a", 10 * i, i, 0.0, 0) for i in range(30)], ("a", 400, 90, 0.0, 0), ("a", 410, 91, 0.0, 0))
    emitted, stay, last, due = advance(rows, state.joined([], state.LAST), 320)
    assert told(emitted, "t_us", "_home", "segment_no") == told({"t_us": np.arange(29) * 10 * SECOND, "_home": np.arange(29) <= 20, "segment_no": np.ones(29, int)},
                                                                "t_us", "_home", "segment_no") and due == 330 * SECOND
    emitted, stay, last, due = advance(stay, last, 600)
    assert emitted["t_us"][~emitted["_home"]].tolist() == [i * 10 * SECOND for i in range(13, 21)] and emitted["segment_no"].tolist()[-2:] == [2, 2] and due is None


class Handle:
    """A state store in memory that counts what it is asked."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        return Value(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.values.get(self.name)

    def update(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    def clear(self):
        self.handle.calls += 1
        del self.handle.values[self.name]


def test_state_is_asked_per_group_not_per_vehicle():
    """Fifty vehicles in one group cost a handful of calls a batch, and one timer."""
    class Times:
        def __init__(self, seconds):
            self.getCurrentWatermarkInMs = lambda: seconds * 1000

    class Expired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    handle, cutter = Handle(), state.GroupCutter(15.0, 0.02, 120.0)
    cutter.init(handle)
    batch = lambda first: pd.DataFrame({c: v for c, v in held(*[(f"v{k}", first + 10 * i, i, 0.0, 0) for k in range(50) for i in range(10)]).items() if c != "segment_no"})
    assert not list(cutter.handleInputRows((1,), iter([batch(0)]), Times(0))) and handle.calls <= 6 and handle.timers == {119_999}
    (out,) = cutter.handleInputRows((1,), iter([batch(100)]), Times(150))
    assert handle.calls <= 12 and len(handle.timers) == 1 and out["_home"].sum() == 50 * 4 and set(out["segment_no"]) == {1}
    (fired,) = handle.timers
    (out,) = cutter.handleExpiredTimer((1,), Times(500), Expired(fired))
    assert handle.calls <= 18 and handle.timers == {fired} and out["_home"].sum() == 50 * 16    # Spark removes the one that fired


def test_rows_leave_as_soon_as_the_watermark_allows(spark, tmp_path, monkeypatch):
    """Also those of vehicles whose later rows still wait, to the millisecond, and without asking the state twice for a batch."""
    times = {"early": [0, 10, 20, 200], "edge": [160.0, 170.0], "beyond": [160.001], None: [5], "end": [300]}
    given = [(v, i, int((1000 + t) * SECOND), 42.7325, -73.676, 0.0, 42.7325, -73.676, "NORTH", 3, 0) for v, ts in times.items() for i, t in enumerate(ts)]
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(given, f"vehicle_id string, {state.PAYLOAD}").coalesce(1).write.parquet(path)
    finish, seen = state.finish_batch, []

    def watched(emitted, *rest):
        seen.append(emitted._jdf.queryExecution().logical().toString())
        return finish(emitted, *rest)

    monkeypatch.setattr(state, "finish_batch", watched)
    state.stateful_enrich(state.read_matched(spark, path), fx.network(spark, SF), out, cp, None, 20.0).awaitTermination()
    got = spark.read.parquet(out).select("vehicle_id", "t_us", "segment_no").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((v, (1000 + t) * SECOND, 1) for v, t in [("early", 0), ("early", 10), ("early", 20), ("edge", 160), (None, 5)]), key=str)
    assert seen and not any("TransformWithState" in plan for plan in seen)
