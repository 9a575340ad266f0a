"""Active insulin, carbs and alcohol as a stream, on a grid without an end.

The state of a subject is what still acts on it. Every event moves the subject's time on, and the instants passed are told;
where nothing comes, timers at the end of each effect do. A late event within the delay tells again the instants that it
changes, an event that is delivered again changes none, and what has worn off leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glycoflow.functions import carbs as carb_fn
from glycoflow.plans.state import carb_events, dose_events, drink_events

#: What the state needs; set before the stream starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "subject_id long, at_ms long, iob double, cob double, alcohol_in_system double, sensitivity_modifier double, revised boolean"
_VALUES = "ms long, ends long, a double, b double, c double, d double, e double"
_PARTS = {
    "dose": (dose_events, ("dose", "slow", "fast")),
    "grams": (carb_events, ("grams", "peak", "half_life", "minutes")),
    "drink": (drink_events, ("grams", "half_life", "gone_per_hour", "lowest", "effect")),
}


def effects(events: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """One row per event and part that acts, with the numbers of its curve, and a bare one that only tells the time."""
    rows = events.select("subject_id", F.unix_millis("ts").alias("ms"), "id", F.lit("").alias("part"), F.unix_millis("ts").alias("ends"),
                         *[F.lit(0.0).alias(n) for n in "abcde"])
    for part, (build, numbers) in _PARTS.items():
        ends = F.ceil(F.col("ms").cast("double") + F.col("minutes") * 60000.0).cast("long")
        values = [F.col(n) for n in numbers] + [F.lit(0.0)] * (5 - len(numbers))
        acting = build(events, params).select("subject_id", "ms", "id", F.lit(part).alias("part"), ends.alias("ends"),
                                              *[v.cast("double").alias(n) for n, v in zip("abcde", values, strict=True)])
        rows = rows.unionByName(acting)
    return rows.withColumn("at", F.timestamp_millis("ms"))


def _add(sums: dict[str, np.ndarray], part: str, since: np.ndarray, a: float, b: float, c: float, d: float, e: float, on: np.ndarray) -> None:
    """Add one event's effects `since` minutes after it, where it is on."""
    t = since[on]
    if part == "dose":
        sums["iob"][on] += a * np.clip((b * np.exp(-t / b) - c * np.exp(-t / c)) / (b - c), 0, 1)
    elif part == "grams":
        rising = a * (t / b) ** (b / c) * t / ((b / c + 1) * d)
        falling = a * carb_fn.AT_PEAK + a * (1 - carb_fn.AT_PEAK) * (1 - np.exp((b - t) / c))
        sums["cob"][on] += a - np.clip(np.where(t < b, rising, falling), 0, a)
    elif part == "drink":
        taken = a * (1 - np.exp(-t / b))
        sums["alcohol_in_system"][on] += np.maximum(0, taken - np.minimum(taken, c * t / 60))
        back = d + (1 - d) * (t - 60) / (e - 60)
        sums["sensitivity_modifier"][on] *= np.where(t >= e, 1.0, np.where(t < 60, 1 - (1 - d) * t / 60, back))


class _Acting(StatefulProcessor):
    """What acts on one subject: (id, part) to its curve, and the last instant told."""

    def __init__(self, step_ms: int, delay_ms: int) -> None:
        self.step, self.delay = step_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.acting = handle.getMapState("acting", "id string, part string", _VALUES)
        self.told = handle.getValueState("told", "ms long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        acting = dict(self.acting.iterator())
        told = self.told.get()[0] if self.told.exists() else None
        newest, changed = told, []
        for frame in rows:
            for r in frame[["id", "part", "ms", "ends", *"abcde"]].itertuples(index=False):
                newest = r.ms if newest is None else max(newest, r.ms)
                name, value = (r.id, r.part), (r.ms, r.ends, r.a, r.b, r.c, r.d, r.e)
                before = acting.get(name)
                if not r.part or before == value or r.ends <= r.ms:
                    continue
                changed += [value[:2]] + ([before[:2]] if before else [])
                acting[name] = value
                self.acting.updateValue(name, value)
        if newest is not None:
            yield from self._tell(key, acting, told, newest, changed, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            told = self.told.get()[0]
            # The instant after an end, so that it is told once that nothing acts any more.
            until = max(told, expiredTimerInfo.getExpiryTimeInMs())
            yield from self._tell(key, dict(self.acting.iterator()), told, until, [], timerValues)

    def _instants(self, first: int, last: int) -> np.ndarray:
        """Instants of the grid from first to last, both included."""
        return np.arange(-(-first // self.step), last // self.step + 1, dtype=np.int64) * self.step

    def _tell(self, key, acting: dict, told: int | None, newest: int, changed: list, timers) -> Iterator[pd.DataFrame]:
        begun = newest + 1 if told is None else told + 1
        wanted = [self._instants(max(v[0], begun) if told is not None else v[0], min(newest, v[1] + self.step)) for v in acting.values()]
        if told is not None:
            wanted += [self._instants(a, min(told, b)) for a, b in changed]
        at = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, dtype=np.int64)
        if len(at):
            sums = {n: np.zeros(len(at)) for n in ("iob", "cob", "alcohol_in_system")} | {"sensitivity_modifier": np.ones(len(at))}
            for (_, part), (ms, ends, *numbers) in acting.items():
                _add(sums, part, (at - ms) / 60000.0, *numbers, (at >= ms) & (at < ends))
            revised = at <= told if told is not None else np.zeros(len(at), dtype=bool)
            yield pd.DataFrame({"subject_id": key[0], "at_ms": at, **sums, "revised": revised})
        # Late events reach back by the delay at most, so what ended before that is not needed again.
        for name, value in list(acting.items()):
            if value[1] + self.step <= newest - self.delay:
                self.acting.removeKey(name)
                del acting[name]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if acting:
            self.told.update((newest,))
            pending = [v[1] + self.step for v in acting.values() if v[1] + self.step > newest]
            next_end = min(pending) if pending else min(v[1] for v in acting.values()) + self.step + self.delay
            self.handle.registerTimer(max(next_end, timers.getCurrentWatermarkInMs() + 1))
        else:
            self.told.clear()

    def close(self) -> None:
        pass


def open_decay(events: DataFrame, step_minutes: int = 5, delay_minutes: int = 10, params: DataFrame | None = None) -> DataFrame:
    """Sums per subject and instant of the grid (multiples of the step since the epoch), as long as something acts.

    For a sink in update mode. An instant may come again, marked `revised`, when a late event changes it; the last row
    holds. Rows more than the delay behind the newest event of the stream are dropped. Set `configured` first.
    """
    rows = effects(events, params).withWatermark("at", f"{delay_minutes} minutes")
    processor = _Acting(step_minutes * 60_000, delay_minutes * 60_000)
    return rows.groupBy("subject_id").transformWithStateInPandas(processor, OUT, "Update", "EventTime")


def configured(spark: SparkSession) -> SparkSession:
    """Choose the state store that keeps maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark
