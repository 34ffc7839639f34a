"""Product lifecycle: active, review, archived, discontinued; as a batch fold and as a stream.

An absence (not_found) within a day of the one before is ignored; the second that counts archives the product, the
first sends it to review. A success restores it and resets the count. Other outcomes prove nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
SUCCESS = ("priced", "on_request", "no_price")
STATE = "state string, missing int, last_absence double, events int"


def step(state: str, missing: int, last: float | None, status: str, at: float) -> tuple[str, int, float | None, str | None]:
    """State, absences that count, time of the last, and the event, after one check."""
    if status in SUCCESS:
        event = "discovered" if state == "new" else "restored" if state != "active" else None
        return "active", 0, None, event
    if status != "not_found" or (last is not None and at - last < DAY):
        return state, missing, last, None
    missing += 1
    to = "archived" if missing >= 2 else "review"
    return to, missing, at, to if to != state else None


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    state, missing, last, events = "new", 0, None, 0
    for status, at in zip(pdf.status, pdf["at"], strict=True):
        state, missing, last, event = step(state, missing, last, status, at)
        events += event is not None
    return pd.DataFrame({"rule_id": pdf.rule_id.iloc[:1], "state": [state], "missing": [missing], "events": [events]})


def fold(checks: DataFrame) -> DataFrame:
    """checks(rule_id, checked_at, obs_id, status) -> state of each product after all of them.

    Checks that change nothing are dropped before they are gathered: repeats of a success, and failures that prove
    nothing. So a product's group holds its changes only.
    """
    at = F.unix_micros(F.col("checked_at").cast("timestamp")) / 1e6
    w = Window.partitionBy("rule_id").orderBy("checked_at", "obs_id")
    kept = checks.where(F.col("status").isin(*SUCCESS, "not_found")).withColumn("before", F.lag("status").over(w))
    kept = kept.where((F.col("status") == "not_found") | F.col("before").isNull() | (F.col("before") == "not_found"))
    rows = kept.select("rule_id", "status", at.alias("at"), "obs_id")
    return rows.groupBy("rule_id").applyInPandas(lambda pdf: _fold(pdf.sort_values(["at", "obs_id"])), "rule_id long, state string, missing int, events int")


class Lifecycle(StatefulProcessor):
    """The same machine over a stream: one state for each product, an event row for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lifecycle", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, missing, last, events = self.state.get() if self.state.exists() else ("new", 0, None, 0)
        out = []
        checks = pd.concat(list(rows)).sort_values(["at", "obs_id"])
        for status, at, obs_id in zip(checks.status, checks["at"], checks.obs_id, strict=True):
            state, missing, last, event = step(state, missing, last, status, at)
            if event:
                events += 1
                out.append((key[0], obs_id, event, state))
        self.state.update((state, missing, last, events))
        yield pd.DataFrame(out, columns=["rule_id", "obs_id", "event", "state"])

    def close(self) -> None:
        pass


def events(stream: DataFrame) -> DataFrame:
    """A stream of checks(rule_id, at in seconds, obs_id, status) -> a stream of lifecycle events."""
    return stream.groupBy("rule_id").transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType="rule_id long, obs_id long, event string, state string", outputMode="append", timeMode="none")


def monthly_memory(stream: DataFrame) -> DataFrame:
    """The first success of each product and month: a stream of checks(rule_id, checked_at, status) without the later ones."""
    kept = stream.where(F.col("status").isin(*SUCCESS)).withWatermark("checked_at", "31 days")
    return kept.withColumn("month", F.date_trunc("month", "checked_at")).dropDuplicatesWithinWatermark(["rule_id", "month"])
