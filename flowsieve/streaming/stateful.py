"""Streams that need state of their own and event-time timers: order of windows, life of rules, running features.

A row is looked at once the watermark has passed the end of its window, in the order of event time; what has come too early
waits in the state. So arrival within the watermark's delay does not matter, and a restart goes on from the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowsieve.schemas import FEATURES


def _millis(ts: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in ts]


def _due(state: GroupState, moments: list[int]) -> None:
    """Wake up at the first moment; never in the past."""
    state.setTimeoutTimestamp(max(min(moments), state.getCurrentWatermarkMs() + 1))


ORDER = "run_id string, window_index int, expected int, status string"
ORDER_STATE = "last int, ts array<bigint>, index array<int>"


def _order(seconds: int, keep: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ts, index = state.get if state.exists else (-1, [], [])
        waiting = list(zip(ts, index))
        for f in () if state.hasTimedOut else frames:
            waiting += zip(_millis(f["window_ts"]), f["window_index"].tolist())
        closed = state.getCurrentWatermarkMs() - seconds * 1000
        ready, waiting = sorted(w for w in waiting if w[0] <= closed), [w for w in waiting if w[0] > closed]
        out = []
        for _, i in ready:
            out.append((key[0], i, last + 1, "ok" if i == last + 1 else "gap" if i > last + 1 else "step_back"))
            last = i
        if state.hasTimedOut and not ready and not waiting:
            # nothing for the time a run is kept: its place goes
            state.remove()
        else:
            state.update((last, [w[0] for w in waiting], [w[1] for w in waiting]))
            _due(state, [w[0] + seconds * 1000 for w in waiting] or [state.getCurrentWatermarkMs() + keep * 1000])
        yield pd.DataFrame(out, columns=["run_id", "window_index", "expected", "status"]).astype({"window_index": "int32", "expected": "int32"})
    return run


def window_order(windows: DataFrame, seconds: int, delay: int, keep: int = 30 * 86_400) -> DataFrame:
    """Each closed window of a run with the index that was due and ``ok``, ``gap`` or ``step_back``.

    Needs run_id, window_index and ``window_ts``, the start of the window. After a wrong index the next one follows it. A repeated window
    is a step back. State is the last index and the windows that are still open; a run is forgotten after ``keep`` seconds without windows.
    """
    rows = windows.select("run_id", "window_index", "window_ts").withWatermark("window_ts", f"{delay} seconds")
    return rows.groupBy("run_id").applyInPandasWithState(_order(seconds, keep), ORDER, ORDER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


LIVES = "run_id string, window_index int, target_source string, active_from bigint, active_until bigint"
LIVES_STATE = "active array<string>, ts array<bigint>, index array<int>, target array<string>, ttl array<int>"


def _lives(seconds: int) -> Callable:
    length = seconds * 1000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, *kept = state.get if state.exists else ([], [], [], [], [])
        waiting = list(zip(*kept))
        for f in () if state.hasTimedOut else frames:
            limits = (f["action"] == "RATE_LIMIT") & f["target_source"].notna()
            waiting += zip(_millis(f["window_ts"]), f["window_index"].tolist(), f["target_source"].where(limits, "").tolist(), f["rule_ttl_seconds"].tolist())
        now, out = state.getCurrentWatermarkMs(), []
        ready, waiting = sorted(w for w in waiting if w[0] + length <= now), [w for w in waiting if w[0] + length > now]
        # the rule in force: index, target, lifetime, event time of its hard end
        rule = (int(active[0]), active[1], int(active[2]), int(active[3])) if active else None

        def close(seen: int) -> None:
            start = (rule[0] + 1) * seconds
            out.append((key[0], rule[0], rule[1], start, start + seen))

        for ts, i, target, ttl in ready:
            if rule:
                # the next window's decision replaces or takes away the rule
                close(min(rule[2], seconds) if i == rule[0] + 1 else rule[2])
            rule = (i, target, ttl, ts + length + ttl * 1000) if target else None
        if rule and now >= rule[3]:
            close(rule[2])
            rule = None
        if rule or waiting:
            state.update(([str(v) for v in rule] if rule else [], *([w[k] for w in waiting] for k in range(4))))
            _due(state, [w[0] + length for w in waiting] + ([rule[3]] if rule else []))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["run_id", "window_index", "target_source", "active_from", "active_until"]).astype(
            {"window_index": "int32", "active_from": "int64", "active_until": "int64"})
    return run


def rule_lives(decisions: DataFrame, seconds: int, delay: int) -> DataFrame:
    """Rules that have ended, as ``gate.rule_lifetimes`` gives them: at their hard limit, or with the next window's decision.

    Needs the decision's columns and ``window_ts``. State is the rule in force and the decisions of open windows; a timer ends a rule that no decision follows.
    """
    rows = decisions.select("run_id", "window_index", "window_ts", "action", "target_source", "rule_ttl_seconds").withWatermark("window_ts", f"{delay} seconds")
    return rows.groupBy("run_id").applyInPandasWithState(_lives(seconds), LIVES, LIVES_STATE, "append", GroupStateTimeout.EventTimeTimeout)


KEYS = ["run_id", "window_start", "switch_id", "dst_ip"]
_KEYS = "run_id string, window_start bigint, switch_id string, dst_ip string"
SUMS = ["add_events", "add_log", "add_unique", "add_pkt", "add_byte", "add_flow"]
DELTAS = _KEYS + ", closes timestamp, " + ", ".join(f"{c} double" for c in SUMS)
LIVE = _KEYS + ", change bigint, " + ", ".join(f"{c} double" for c in FEATURES)
#: Parts of a window's sources; a destination that most sources name is so many keys, not one.
SPREAD = 16


def _xlogx(n: float) -> float:
    return n * np.log2(n) if n > 0 else 0.0


class SourceCounts(StatefulProcessor):
    """Counts by source of one part of a window: a map in the state store. A batch gives out what it has added to the sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.counts = handle, handle.getMapState("counts", "src string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added, sums, closes = {}, np.zeros(3), None
        for f in rows:
            closes = f["closes"].iloc[0]
            for src, n in f["src_ip"].value_counts(dropna=False).items():
                src = None if pd.isna(src) else src
                added[src] = added.get(src, 0) + int(n)
            sums += f[["packet_count", "byte_count", "flow_count"]].fillna(0).sum().to_numpy(float)
        if closes is None:
            return
        log = new = 0.0
        for src, n in added.items():
            # a null source is counted under a name that no address has
            name = ("\x00",) if src is None else (src,)
            before = (self.counts.getValue(name) or (0,))[0]
            self.counts.updateValue(name, (before + n,))
            log, new = log + _xlogx(before + n) - _xlogx(before), new + (before == 0 and src is not None)
        self.handle.registerTimer(int(pd.Timestamp(closes).value // 1_000_000))
        yield pd.DataFrame([(*key[:4], closes, float(sum(added.values())), log, new, *sums)], columns=[*KEYS, "closes", *SUMS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


class RunningFeatures(StatefulProcessor):
    """Six sums of a window; each batch that changes them gives out the features as they are now."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getValueState("sums", ", ".join(f"{c} double" for c in SUMS) + ", change bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get() if self.sums.exists() else None
        total, change = (np.array(held[:6], float), held[6]) if held else (np.zeros(6), 0)
        closes = None
        for f in rows:
            total, closes = total + f[SUMS].sum().to_numpy(float), f["closes"].iloc[0]
        if closes is None:
            return
        self.sums.update((*(float(v) for v in total), change + 1))
        self.handle.registerTimer(int(pd.Timestamp(closes).value // 1_000_000))
        n, log, unique, pkt, byte, flow = total
        flows = flow if flow > 0 else n
        values = {"pkt_rate": pkt / self.seconds, "byte_rate": byte / self.seconds, "pkt_sum": pkt, "events": n, "unique_src": unique,
                  "src_ip_entropy": max(np.log2(n) - log / n, 0.0), "flow_count": flows, "flow_rate": flows / self.seconds}
        yield pd.DataFrame([(*key, change + 1, *(float(values[c]) for c in FEATURES))], columns=[*KEYS, "change", *FEATURES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_windows(events: DataFrame, seconds: int, delay: int, spread: int = SPREAD) -> DataFrame:
    """Features of every open window after each batch that changes it, straight from the stream; ``change`` counts from 1.

    A source's count and the sum of n log n change by its own row alone, so the entropy never needs the other sources again. A window's sources are
    dealt to ``spread`` parts, which give out one row of changes a batch; those are summed by window. State goes at the window's end, and rows behind
    the watermark are dropped. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    start = F.window("event_ts", f"{seconds} seconds")
    rows = events.withWatermark("event_ts", f"{delay} seconds").withColumn("_w", start).select(
        "run_id", F.unix_seconds(F.col("_w.start")).alias("window_start"), "switch_id", "dst_ip", F.pmod(F.xxhash64("src_ip"), F.lit(spread)).alias("part"),
        F.col("_w.end").alias("closes"), "src_ip", "packet_count", "byte_count", "flow_count", "event_ts")
    parts = rows.groupBy(*KEYS, "part").transformWithStateInPandas(SourceCounts(), DELTAS, "Append", "EventTime", eventTimeColumnName="closes")
    return parts.groupBy(*KEYS).transformWithStateInPandas(RunningFeatures(seconds), LIVE, "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
