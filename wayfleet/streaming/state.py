"""Trips on a stream, the state of each vehicle being a bounded tail of its rows.

Matched pings arrive in any order within the watermark's delay. A vehicle's rows wait in keyed state until
the watermark has passed them; then their order is settled and trips are cut and numbered with the
off-route rule. A row leaves once the watermark is also ``reach`` seconds beyond it, together with the
rows around it, so what looks at neighbours (votes, steps, stop repair) needs nothing but the batch it
comes in. Kept are the rows that have not left, ``reach`` seconds of those before, and one trip number.

The state store is asked per group of vehicles, not per vehicle: a group's rows are one value of the state,
in Arrow's format, and are handled as columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wayfleet.operators import matching, stops, trips
from wayfleet.operators.scale import cut, drop_halo
from wayfleet.plans import enrich
from wayfleet.sources.network import Network
from wayfleet.streaming import jobs

# Keyed state with timers needs RocksDB; with a changelog a batch uploads what changed, not zipped snapshots of every partition.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
CONTEXT_ROWS = enrich.VOTE_WINDOW + 3     # neighbours that votes, steps and stop repair can reach together
VEHICLE_GROUPS = 512                      # the state's keys; a stream keeps the number it began with
BATCH = ("vehicle_id", "_batch", "segment_no")
PAYLOAD = ("ping_id long, t_us long, latitude double, longitude double, dist_to_route double, closest_lat double, closest_lon double, "
           "route string, polyline_idx int, segment_idx int")
COLUMNS = [c.split()[0] for c in PAYLOAD.split(", ")]
PING, T_US, DIST, NUMBER = COLUMNS.index("ping_id"), COLUMNS.index("t_us"), COLUMNS.index("dist_to_route"), len(COLUMNS)
EMITTED = f"vehicle_id string, {PAYLOAD}, segment_no long, _home boolean"
MADE = Row("vehicle_id", *COLUMNS, "segment_no", "_home")
# Rows are columns of these types: missing numbers are NaN, a missing ping is 0 without ``has_ping``, a trip number that is not settled 0.
HELD = {"vehicle_id": "object", "has_ping": "bool", "segment_no": "int64",
        **{c: {"long": "int64", "string": "object"}.get(kind, "float64") for c, kind in (f.split() for f in PAYLOAD.split(", "))}}
LAST = {"vehicle_id": "object", "seen": "bool", "t_us": "int64", "off": "bool", "segment_no": "int64", "left_us": "int64"}
ARROW = {"object": pa.string(), "bool": pa.bool_(), "int64": pa.int64(), "float64": pa.float64()}
NEVER = -2**62
Columns = dict[str, np.ndarray]


class TripCutter(StatefulProcessor):
    """Cuts one vehicle's rows into numbered trips, in the order of their times.

    The plain form, which asks the state per vehicle; the job uses ``GroupCutter``, and tests compare the two.
    """

    def __init__(self, max_gap: float, max_dist: float, reach: float):
        self.gap_us, self.max_dist, self.reach_us = int(max_gap * 1e6), max_dist, int(reach * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"{PAYLOAD}, segment_no long")
        self.at = handle.getValueState("at", "t_us long, off boolean, segment_no long, left_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(*(None if v != v else v for v in map(r.__getitem__, COLUMNS)), None) for r in rows]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: list[tuple], watermark: int) -> Iterator[Row]:
        stored, kept = self.at.get(), list(self.rows.get())
        last = stored or (None, False, 0, -2**62)
        # A row that is delivered again counts once; of rows of one time the last ping stays, unless one has a number already.
        order = lambda r: (r[T_US], r[NUMBER] is not None, r[PING] is None, r[PING] or 0)
        held = list({r[T_US]: r for r in sorted([*kept, *new], key=order)}.values())
        numbers, last = numbered([(r[T_US], r[DIST], r[NUMBER]) for r in held], last, watermark, self.gap_us, self.max_dist)
        held = [(*r[:NUMBER], no) for r, no in zip(held, numbers)]
        leaving = [r[T_US] for r in held if last[3] < r[T_US] <= watermark - self.reach_us]
        if leaving:
            low, high, left = leaving[0] - self.reach_us, leaving[-1] + self.reach_us, last[3]
            for r in held:
                if low <= r[T_US] <= high:
                    yield MADE(key[0], *r, left < r[T_US] <= leaving[-1])
            last = (*last[:3], leaving[-1])
        stay = [r for r in held if r[T_US] >= last[3] - self.reach_us]
        if stay != kept:
            self.rows.put(stay)
        if last[0] is not None and last != stored:
            self.at.update(last)
        if held and held[-1][T_US] > last[3]:
            self.handle.registerTimer((held[-1][T_US] + self.reach_us) // 1000 + 1)

    def close(self) -> None:
        pass


def numbered(held: Iterable[tuple], last: tuple, watermark: int, gap_us: int, max_dist: float) -> tuple[list, tuple]:
    """Trip numbers of ``(t_us, dist_to_route, number)`` in order of time: those there were, and new ones for the rows that the
    watermark has passed since ``last`` (time, off the route, number, time left)."""
    before, was_off, no, left = last
    since, numbers = before, []
    for t, dist, number in held:
        if number is None and t <= watermark and (since is None or t > since):
            off = dist is not None and dist > max_dist
            no += before is None or t - before > gap_us or off or was_off
            number, before, was_off = no, t, off
        numbers.append(number)
    return numbers, (before, was_off, no, left)


def number(held: pd.DataFrame, last: tuple, watermark: int, gap_us: int, max_dist: float) -> tuple[pd.DataFrame, tuple]:
    """``numbered`` on a frame."""
    known = [None if pd.isna(n) else int(n) for n in held["segment_no"]]
    numbers, last = numbered(zip(held["t_us"].tolist(), held["dist_to_route"], known), last, watermark, gap_us, max_dist)
    return held.assign(segment_no=pd.Series(numbers, dtype=object)), last


class GroupCutter(StatefulProcessor):
    """Cuts the rows of a group of vehicles into numbered trips, each vehicle's in the order of their times."""

    def __init__(self, max_gap: float, max_dist: float, reach: float):
        self.gap_us, self.max_dist, self.reach_us = int(max_gap * 1e6), max_dist, int(reach * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "held binary")
        self.at = handle.getValueState("at", "last binary, timer_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance([{c: np.zeros(len(r), "int64") if c == "segment_no" else r[c].to_numpy() for c in HELD} for r in rows],
                                 timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, new: list[Columns], watermark_ms: int, expired_ms: int | None = None) -> Iterator[pd.DataFrame]:
        rows, at = self.rows.get(), self.at.get()
        last, timer_ms = (unpacked(at[0]), at[1]) if at else (joined([], LAST), None)
        held = joined([unpacked(rows[0]), *new] if rows else new, HELD)
        emitted, stay, last, due_us = advanced(held, last, watermark_ms * 1000, self.gap_us, self.max_dist, self.reach_us)
        if emitted["t_us"].size:
            yield as_emitted(emitted)
        if stay["t_us"].size:
            self.rows.update((packed(stay, HELD),))
        elif rows:
            self.rows.clear()
        # One timer per group, of the next row to leave. It fires when the watermark is later than it, and Spark removes it then.
        due_ms = None if due_us is None else -(-due_us // 1000) - 1
        if due_ms != timer_ms:
            if timer_ms is not None and timer_ms != expired_ms:
                self.handle.deleteTimer(timer_ms)
            if due_ms is not None:
                self.handle.registerTimer(due_ms)
        self.at.update((packed(last, LAST), due_ms))

    def close(self) -> None:
        pass


def joined(parts: list[Columns], types: dict[str, str]) -> Columns:
    return {c: np.concatenate([np.zeros(0, t), *(p[c] for p in parts)]).astype(t, copy=False) for c, t in types.items()}


def picked(columns: Columns, rows: np.ndarray) -> Columns:
    return {c: v[rows] for c, v in columns.items()}


def packed(columns: Columns, types: dict[str, str]) -> bytes:
    batch = pa.record_batch({c: pa.array(columns[c], ARROW[t], from_pandas=t == "object") for c, t in types.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(stored: bytes) -> Columns:
    batch = pa.ipc.open_stream(stored).read_next_batch()
    return {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}


def ends_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and where they end."""
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    return np.r_[0, new], np.r_[new, at.size] - 1


def advanced(held: Columns, last: Columns, watermark: int, gap_us: int, max_dist: float,
             reach_us: int) -> tuple[Columns, Columns, Columns, int | None]:
    """(rows that leave and the rows around them, rows that stay, ``last``, when the next row may leave) at a watermark.

    ``last`` has a row per vehicle: time of its last numbered row, whether that was off the route, its number, time left.
    """
    at, vehicles = pd.factorize(np.concatenate([last["vehicle_id"], held["vehicle_id"]]), use_na_sentinel=False)
    at, known = at[last["vehicle_id"].size:], last["vehicle_id"].size
    fresh = {"seen": False, "t_us": 0, "off": False, "segment_no": 0, "left_us": NEVER}
    last = {"vehicle_id": np.where(pd.isna(vehicles), None, vehicles),
            **{c: np.concatenate([last[c], np.full(len(vehicles) - known, v, LAST[c])]) for c, v in fresh.items()}}
    # A row that is delivered again counts once; of rows of one time the last ping stays, unless one has a number already.
    order, t = np.lexsort((held["ping_id"], ~held["has_ping"], held["segment_no"] > 0, held["t_us"], at)), held["t_us"]
    is_last = np.ones(t.size, "bool")
    is_last[:-1] = (at[order[1:]] != at[order[:-1]]) | (t[order[1:]] != t[order[:-1]])
    order = order[is_last]
    held, at, t = picked(held, order), at[order], t[order]
    no = held["segment_no"] = numbered_columns(at, t, held["dist_to_route"], held["segment_no"], last, watermark, gap_us, max_dist)
    left, leaving = last["left_us"], np.flatnonzero((last["left_us"][at] < t) & (t <= watermark - reach_us))
    home = around = np.zeros(t.size, "bool")
    if leaving.size:
        (heads, ends), i = (leaving[x] for x in ends_of(at[leaving])), np.arange(t.size)
        first, final, high = np.full(len(vehicles), t.size), np.full(len(vehicles), -1), np.full(len(vehicles), NEVER)
        first[at[heads]], final[at[ends]], high[at[ends]] = heads, ends, t[ends]
        first, final = first[at], final[at]
        inside = (first <= i) & (i <= final)
        # Around them rows of the same trip as the first and the last one, as many as neighbours can reach.
        before = (i < first) & (i >= first - CONTEXT_ROWS) & (final >= 0) & (no == no[np.minimum(first, t.size - 1)])
        after = (i > final) & (i <= final + CONTEXT_ROWS) & (final >= 0) & (no == no[final])
        home, around = inside & (left[at] < t), inside | before | after
        left = last["left_us"] = np.maximum(left, high)
    waits = t[t > left[at]]
    return ({**picked(held, around), "_home": home[around]}, picked(held, t >= left[at] - reach_us), picked(last, last["seen"]),
            int(waits.min()) + reach_us if waits.size else None)


def numbered_columns(at: np.ndarray, t: np.ndarray, dist: np.ndarray, numbers: np.ndarray, last: Columns, watermark: int,
                     gap_us: int, max_dist: float) -> np.ndarray:
    """``numbered`` of many vehicles, the rows in order of vehicle (``at``, its place in ``last``) and time; ``last`` goes on with them."""
    seen, before, was_off, no = (last[c] for c in ("seen", "t_us", "off", "segment_no"))
    numbers, fresh = numbers.copy(), np.flatnonzero((numbers == 0) & (t <= watermark) & (~seen[at] | (t > before[at])))
    if not fresh.size:
        return numbers
    at, t, off = at[fresh], t[fresh], dist[fresh] > max_dist
    heads, ends = ends_of(at)
    previous, after_off = np.r_[0, t[:-1]], np.r_[False, off[:-1]]
    previous[heads], after_off[heads] = before[at[heads]], was_off[at[heads]]
    starts = (t - previous > gap_us) | off | after_off
    starts[heads] |= ~seen[at[heads]]
    count = np.cumsum(starts)
    numbers[fresh] = count + np.repeat(no[at[heads]] - count[heads] + starts[heads], ends - heads + 1)
    now = at[ends]
    seen[now], before[now], was_off[now], no[now] = True, t[ends], off[ends], numbers[fresh[ends]]
    return numbers


def as_emitted(rows: Columns) -> pd.DataFrame:
    known = {"ping_id": rows["has_ping"], "segment_no": rows["segment_no"] > 0, **{c: ~np.isnan(rows[c]) for c in ("polyline_idx", "segment_idx")}}
    kind = {"ping_id": "int64", "segment_no": "int64", "polyline_idx": "int32", "segment_idx": "int32"}
    whole = {c: pd.arrays.IntegerArray(np.where(k, rows[c], 0).astype(kind[c]), ~k) for c, k in known.items()}
    return pd.DataFrame({c: whole.get(c, rows[c]) for c in ("vehicle_id", *COLUMNS, "segment_no", "_home")}, copy=False)


def match_stream(pings: DataFrame, network: Network, path: str, checkpoint: str, cadence: str | None = jobs.CADENCE) -> StreamingQuery:
    """Matched pings under ``path``, a folder per batch; a repeated batch replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        matched = matching.match_route(trips.ping_frame(batch), network)
        matched.select("vehicle_id", *COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return jobs.paced(pings.writeStream.foreachBatch(write), checkpoint, cadence).start()


def read_matched(spark: SparkSession, path: str) -> DataFrame:
    return jobs.read_stream(spark, path, f"vehicle_id string, {PAYLOAD}")


def cut_trips(matched: DataFrame, delay: float = jobs.LATE_AFTER_SECONDS, max_gap: float = enrich.TRIP_GAP_SECONDS,
              max_dist: float = enrich.TRIP_DIST_KM, groups: int = VEHICLE_GROUPS) -> DataFrame:
    """Every row once, with its trip number and ``_home`` set, and the rows around it with ``_home`` not set.

    Rows behind the watermark, ``delay`` seconds after the newest, are dropped, as Spark does; rows without a time are left out.
    """
    timed = matched.filter("t_us IS NOT NULL").withColumn("event_time", F.timestamp_micros("t_us")).withWatermark("event_time", f"{int(delay * 1000)} milliseconds")
    placed = timed.withColumns({"has_ping": F.col("ping_id").isNotNull(), "ping_id": F.coalesce("ping_id", F.lit(0).cast("long")),
                                "vehicle_group": F.pmod(F.xxhash64("vehicle_id"), F.lit(groups)).cast("int")})
    cutter = GroupCutter(max_gap, max_dist, CONTEXT_ROWS * max_gap)
    return placed.groupBy("vehicle_group").transformWithStateInPandas(cutter, EMITTED, "Append", "EventTime")


def finish_batch(emitted: DataFrame, network: Network, max_gap: float = enrich.TRIP_GAP_SECONDS) -> DataFrame:
    """The enriched rows of one batch of ``cut_trips``: votes, refined matches, steps, stops."""
    df = trips.vote_route(emitted.withColumn("_batch", F.lit(0)), enrich.VOTE_WINDOW, BATCH)
    df = matching.match_target_polyline(df, network)
    df = trips.speed(trips.distance_delta(df, BATCH), BATCH)
    df = matching.polyline_progress(matching.match_stop(df, network), network, rematch=False)
    return drop_halo(stops.repair_missed_stops(df, network, BATCH)).drop("_batch")


def stateful_enrich(matched: DataFrame, network: Network, path: str, checkpoint: str, cadence: str | None = jobs.CADENCE,
                    delay: float = jobs.LATE_AFTER_SECONDS, max_gap: float = enrich.TRIP_GAP_SECONDS, max_dist: float = enrich.TRIP_DIST_KM) -> StreamingQuery:
    """Append finished rows under ``path``; nothing that was written is read or written again.

    The state store is set up for this query alone.
    """
    spark = matched.sparkSession
    def write(batch: DataFrame, batch_id: int) -> None:
        # Stored first: what reads a batch twice, as looking up stops does, would ask the state store twice.
        finish_batch(cut(batch, "emitted", f"{path}/_work"), network, max_gap).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        return jobs.paced(cut_trips(matched, delay, max_gap, max_dist).writeStream.outputMode("append").foreachBatch(write), checkpoint, cadence).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
