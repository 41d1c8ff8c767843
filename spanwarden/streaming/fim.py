"""File integrity as a stream with state, and cycles over many targets of which one may fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import keep

FINDINGS = "target string, path string, rule_id string, severity int, seen timestamp"
STATE = "digest string, mode string, seen timestamp"


def integrity(observed: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings of a stream of observations (target, path, digest, mode, seen timestamp): files created, changed, permissions changed, removed.

    The state is a file's last digest and mode, keyed by target and path. The first observation of a file is its
    baseline. A file that nothing has seen for `gap` of event time is removed: a timer says so once and the state goes.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = pd.Timedelta(gap)

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, path = key
        rows = []
        if state.hasTimedOut:
            rows.append((target, path, "fim.file-removed", 3, state.get[2] + wait))
            state.remove()
        else:
            last = state.get if state.exists else None
            seen = pd.concat(list(batches)).sort_values(["seen", "digest"])
            for digest, mode, at in zip(seen["digest"], seen["mode"], seen["seen"], strict=True):
                if last is not None and at >= last[2]:
                    if digest != last[0]:
                        rows.append((target, path, "fim.content-changed", 3, at))
                    elif mode != last[1]:
                        rows.append((target, path, "fim.permission-changed", 2, at))
                if last is None or at >= last[2]:
                    last = (digest, mode, at)
            state.update(last)
            due = int((last[2] + wait).timestamp() * 1000)
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(rows, columns=["target", "path", "rule_id", "severity", "seen"])

    keyed = observed.withWatermark("seen", late).groupBy("target", "path")
    return keyed.applyInPandasWithState(step, FINDINGS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cycle(spark: SparkSession, targets: list[str], step: Callable[[str], DataFrame]) -> DataFrame:
    """The findings of step(target) over all targets, with a target column; a target whose step fails gives a finding in place of its own, the others go on.

    Each target's findings are written before the next one starts, so a failure while they are computed is its own.
    """
    out = spark.createDataFrame([], "target string, rule_id string, severity int, snippet string")
    for target in targets:
        try:
            found = keep(step(target), "cycle").withColumn("target", F.lit(target))
        except Exception as e:  # noqa: BLE001  whatever a target's step raises is reported
            found = spark.createDataFrame([(target, "cycle.target-failed", 2, f"{type(e).__name__}: {e}"[:200])], "target string, rule_id string, severity int, snippet string")
        out = out.unionByName(found, allowMissingColumns=True)
    return out
