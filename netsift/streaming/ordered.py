"""Ordered folds over streams: rows wait until the watermark has passed their second, then meet their rule in time order.

Files may come late and out of order. A batch's rows of a key are put together by second and appended to the list of what
waits in its state, many at a time (a call to the state costs more than a row); a timer per key, on event time, wakes
it when the watermark has passed its earliest waiting second, and everything up to the watermark is released in order.
State that can no longer change a result is dropped by a timer of its own. The rules are those of ``operators.folds``, so
a stream gives the rows of the batch fold, whatever the order of the files, as long as no row is later than the watermark
allows. Rows that are, Spark drops before the fold; ``jobs.Ingest`` is where they are kept.

Needs the RocksDB state store, see :func:`netsift.streaming.jobs.run_to_end`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import catalogues as C


_SENT = 1000  # waiting seconds in one call


class Rule:
    """What a fold does with one second of one key.

    ``item`` is the type of what waits for a second, ``state`` that of what the key keeps, ``out`` that of the rows it
    gives. ``add`` puts a row (or None for an empty second) into an item, ``join`` two items of the same second.
    """

    key: str
    item: str
    state: str
    out: str

    def add(self, item: tuple | None, row: Row) -> tuple:
        raise NotImplementedError

    def join(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple | None, key: Any, sec: int, item: tuple) -> tuple[tuple, list[Row]]:
        raise NotImplementedError

    def until(self, state: tuple) -> int | None:
        """The second from which on the state says nothing any more; None: it always does."""
        return None


class Ordered(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"sec long, {self.rule.item}")
        self.kept = handle.getValueState("kept", self.rule.state)
        self.timer = handle.getValueState("timer", "sec long")

    def _wake(self, sec: int, now: int | None) -> None:
        """Keep one timer per key, at the earliest second it is needed; ``now``: the one that is set."""
        if now is not None and now <= sec:
            return
        if now is not None:
            self.handle.deleteTimer(now * 1000)
        self.handle.registerTimer(sec * 1000)
        self.timer.update((sec,))

    def _append(self, rows: list[tuple]) -> None:
        for at in range(0, len(rows), _SENT):
            self.waiting.appendList(rows[at : at + _SENT])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, tuple] = {}
        for row in rows:
            fresh[row["sec"]] = self.rule.add(fresh.get(row["sec"]), row)
        self._append([(sec, *item) for sec, item in fresh.items()])
        if fresh:
            timer = self.timer.get()
            self._wake(min(fresh) + 1, timer[0] if timer else None)  # a second is over when the next one begins
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        kept = self.kept.get()
        state = tuple(kept) if kept is not None else None
        due: dict[int, tuple] = {}
        left = []
        for sec, *item in self.waiting.get() if self.waiting.exists() else ():
            if sec + 1 > now:
                left.append((sec, *item))
            else:
                due[sec] = self.rule.join(due[sec], tuple(item)) if sec in due else tuple(item)
        for sec in sorted(due):
            state, out = self.rule.step(state, key[0], sec, due[sec])
            yield from out
        if due:
            self.waiting.clear()
            self._append(left)
        end = None if state is None else self.rule.until(state)
        if end is not None and end <= now:
            state, end = None, None
        if state is not None:
            self.kept.update(state)
        elif kept is not None:
            self.kept.clear()
        wake = [s for s in [min(sec for sec, *_ in left) + 1 if left else None, end] if s is not None]
        if wake:
            self._wake(min(wake), None)
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


class Dealt(Ordered):
    """The same walk for many keys at once: a state holds the keys of one deal, so its calls are shared by them."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key string, sec long, {self.rule.item}")
        self.kept = handle.getListState("kept", f"key string, {self.rule.state}")
        self.timer = handle.getValueState("timer", "sec long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[tuple, tuple] = {}
        for row in rows:
            at = (row[self.rule.key], row["sec"])
            fresh[at] = self.rule.add(fresh.get(at), row)
        self._append([(*at, *item) for at, item in fresh.items()])
        if fresh:
            timer = self.timer.get()
            self._wake(min(sec for _, sec in fresh) + 1, timer[0] if timer else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        states = {k: tuple(state) for k, *state in (self.kept.get() if self.kept.exists() else ())}
        had = bool(states)
        due: dict[tuple, tuple] = {}
        left = []
        for k, sec, *item in self.waiting.get() if self.waiting.exists() else ():
            if sec + 1 > now:
                left.append((k, sec, *item))
            else:
                due[sec, k] = self.rule.join(due[sec, k], tuple(item)) if (sec, k) in due else tuple(item)
        for sec, k in sorted(due):
            states[k], out = self.rule.step(states.get(k), k, sec, due[sec, k])
            yield from out
        if due:
            self.waiting.clear()
            self._append(left)
        ends = {k: self.rule.until(state) for k, state in states.items()}
        states = {k: state for k, state in states.items() if ends[k] is None or ends[k] > now}
        if had:
            self.kept.clear()
        rest = [(k, *state) for k, state in states.items()]
        for at in range(0, len(rest), _SENT):
            self.kept.appendList(rest[at : at + _SENT])
        wake = [sec + 1 for _, sec, *_ in left] + [ends[k] for k in states if ends[k] is not None]
        if wake:
            self._wake(min(wake), None)
        else:
            self.timer.clear()


_DEALS = 4096


def run_dealt(stream: DataFrame, rule: Rule) -> DataFrame:
    """As :func:`run`, for rules of many keys (strings, none null) with few rows each."""
    deal = F.pmod(F.xxhash64(rule.key), F.lit(_DEALS)).alias("_deal")
    return stream.select(deal, *stream.columns).groupBy("_deal").transformWithState(Dealt(rule), rule.out, "append", "eventTime")


def run(stream: DataFrame, rule: Rule) -> DataFrame:
    """``stream`` has the rule's key, ``sec`` and an event-time column with a watermark."""
    return stream.groupBy(rule.key).transformWithState(Ordered(rule), rule.out, "append", "eventTime")


class Windows(Rule):
    """Alerts: the first sent one opens a window of ``ttl`` seconds; repeats inside it go and do not extend it."""

    key = "fingerprint"
    item = "type string, severity string, device string, detail string, ttl long"
    state = "until long"
    out = "fingerprint string, type string, severity string, device string, detail string, sec long"

    def add(self, item, row):
        return item or (row["type"], row["severity"], row["device"], row["detail"], row["ttl"])

    def join(self, a, b):
        return a  # a fingerprint's alerts of a second are one

    def step(self, state, key, sec, item):
        if state is not None and sec < state[0]:
            return state, []
        kind, severity, device, detail, ttl = item
        return (sec + ttl,), [Row(fingerprint=key, type=kind, severity=severity, device=device, detail=detail, sec=sec)]

    def until(self, state):
        return state[0]


class Rate(Rule):
    """A window opens at a hit; the hit that reaches ``count`` fires, the rest of the window is silent."""

    key, item, state, out = "src", "n long", "start long, hits long", "src string, sec long"

    def __init__(self, count: int = C.RATE_COUNT, seconds: int = C.RATE_SECONDS):
        self.count, self.seconds = count, seconds

    def add(self, item, row):
        return ((item[0] if item else 0) + row["n"],)

    def join(self, a, b):
        return (a[0] + b[0],)

    def step(self, state, key, sec, item):
        start, hits = state if state is not None and sec < state[0] + self.seconds else (sec, 0)
        fires = hits < self.count <= hits + item[0]
        return (start, hits + item[0]), [Row(src=key, sec=sec)] if fires else []

    def until(self, state):
        return state[0] + self.seconds


class Samples(Rule):
    """A second holds samples in the order of their numbers; null samples only move the clock."""

    item = "ids array<long>, samples array<double>"

    def add(self, item, row):
        ids, samples = item or ([], [])
        return [*ids, row["seq"]], [*samples, row["sample"]]

    def join(self, a, b):
        return [*a[0], *b[0]], [*a[1], *b[1]]

    @staticmethod
    def in_order(item) -> list[float]:
        return [s for _, s in sorted(zip(*item), key=lambda x: x[0]) if s is not None]


class Failures(Samples):
    """Fires exactly at the third failure in a row (samples: 1 success, 0 failure); a success starts over."""

    key, state, out = "probe", "fails long", "probe string, sec long"

    def __init__(self, threshold: int = C.FAILURE_THRESHOLD):
        self.threshold = threshold

    def step(self, state, key, sec, item):
        fails, out = state[0] if state else 0, []
        for ok in self.in_order(item):
            fails = 0 if ok else fails + 1
            if fails == self.threshold:
                out.append(Row(probe=key, sec=sec))
        return (fails,), out


class Load(Samples):
    """Sustained load: a ring of the last ``window`` samples; alerts when its mean is high and the last alert is old, the
    elevated mark clears when the mean of the last ``reset`` samples is low. Gives alerts (elevated) and clears (not)."""

    key, out = "host", "host string, sec long, mean double, elevated boolean"
    state = "ring array<double>, last long, elevated boolean"

    def __init__(self, window: int = C.GAUGE_WINDOW, reset: int = C.GAUGE_RESET_WINDOW, threshold: float = C.GAUGE_THRESHOLD,
                 reset_below: float = C.GAUGE_RESET_BELOW, realert: int = C.GAUGE_REALERT_HOURS * 3600):
        self.window, self.reset, self.threshold, self.reset_below, self.realert = window, reset, threshold, reset_below, realert

    def step(self, state, key, sec, item):
        ring, last, elevated = state or ([], None, False)
        ring, out = list(ring), []
        for sample in self.in_order(item):
            ring = [*ring[1 - self.window :], sample]
            if len(ring) < self.window:
                continue
            mean, short = sum(ring) / self.window, sum(ring[-self.reset :]) / self.reset
            if elevated and short < self.reset_below:
                elevated = False
                out.append(Row(host=key, sec=sec, mean=mean, elevated=False))
            if mean >= self.threshold and (last is None or sec - last >= self.realert):
                last, elevated = sec, True
                out.append(Row(host=key, sec=sec, mean=mean, elevated=True))
        return (ring, last, elevated), out


class First(Rule):
    """The first second a key is seen."""

    item, state = "n long", "first long"

    def __init__(self, key: str):
        self.key, self.out = key, f"{key} string, sec long"

    def add(self, item, row):
        return (1,)

    def join(self, a, b):
        return a

    def step(self, state, key, sec, item):
        return (state, []) if state is not None else ((sec,), [Row(**{self.key: key, "sec": sec})])


def seconds(ts: str = "ts"):
    return F.unix_timestamp(ts).alias("sec")
