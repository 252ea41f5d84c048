"""The life of alerts as a stateful stream: opened, repeated, acknowledged, resolved, expired."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIFE = "rule string, alert int, status string, ts timestamp, value double, firings int, peak double"
_ALERT = "alert int, active boolean, acknowledged boolean, last long, notice long, timer long, firings int, peak double"
#: The state store that holds values with timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertLife(StatefulProcessor):
    """State of a rule: its current or last alert. Times are event time, in milliseconds."""

    def __init__(self, cooldown: int, expiry: int):
        self.cooldown, self.expiry = cooldown * 1000, expiry * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", _ALERT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        number, active, seen, last, notice, timer, firings, peak = self.alert.get() if self.alert.exists() else (0, False, False, None, None, None, 0, None)
        out, held = [], timer
        batch = pd.concat(list(rows)).sort_values(["ts", "value"], kind="stable")
        for ts, firing, value, action in zip(batch["ts"], batch["firing"], batch["value"], batch["action"], strict=True):
            now, status = int(ts.timestamp() * 1000), None
            if active and now - last > self.expiry:  # it has been silent too long before this row
                out.append((key[0], number, "expired", pd.Timestamp(last + self.expiry, unit="ms"), None, firings, peak))
                active = False
            if isinstance(action, str) and action:
                if active and action == "acknowledge" and not seen:
                    seen, status = True, "acknowledged"
                elif active and action == "resolve":
                    active, status = False, "resolved"
            elif firing and active:
                last, firings, peak = max(last, now), firings + 1, max(peak, value)
                if not seen and now - notice >= self.cooldown:
                    notice, status = now, "repeated"
            elif firing and (notice is None or now - notice >= self.cooldown):
                number, active, seen, last, notice, firings, peak, status = number + 1, True, False, now, now, 1, value, "opened"
            elif not firing and active:
                active, status = False, "resolved"
            if status:
                out.append((key[0], number, status, ts, float(value), firings, peak))
        timer = last + self.expiry + 1 if active else None
        if held != timer:
            if held is not None:
                self.handle.deleteTimer(held)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.alert.update((number, active, seen, last, notice, timer, firings, peak))
        if out:
            yield pd.DataFrame(out, columns=["rule", "alert", "status", "ts", "value", "firings", "peak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.alert.exists():
            number, active, seen, last, notice, _, firings, peak = self.alert.get()
            self.alert.update((number, False, seen, last, notice, None, firings, peak))
            if active:
                yield pd.DataFrame([(key[0], number, "expired", pd.Timestamp(last + self.expiry, unit="ms"), None, firings, peak)], columns=["rule", "alert", "status", "ts", "value", "firings", "peak"])

    def close(self) -> None:
        pass


def alert_life(checks: DataFrame, cooldown: int = 300, expiry: int = 3600, late: str = "10 minutes") -> DataFrame:
    """What happens to each rule's alerts in a stream of checks: (rule, alert, status, ts, value, firings, peak).

    ``checks`` has (rule, ts, firing, value, action). A firing check opens the rule's alert, unless its last notice is under
    ``cooldown`` seconds old; further ones are counted and told once a cooldown, or not at all after an ``acknowledge``. A
    check that doesn't fire resolves it, as the action ``resolve`` does. An alert without a firing check for ``expiry``
    seconds expires, by the next row or by a timer of event time when none comes. Later rows than ``late`` are dropped.
    One small value a rule is kept. Checks of one rule and time are taken by value. The session's state store has to be
    ``ROCKSDB``.
    """
    rows = checks.select("rule", "ts", "firing", "value", "action").withWatermark("ts", late)
    return rows.groupBy("rule").transformWithStateInPandas(AlertLife(cooldown, expiry), LIFE, "Append", "EventTime")
