"""Live state of runs with the rules of the batch report, in any order of arrival.

The state of a run is a map with an entry per log of it: a few numbers that tell what its lines have said so far, each with the place of the line
that said it. So a percentage or an end mark before the log's last error can be told from one after it, as in the batch report,
though lines of a log may come in any order. A run that has not been heard of for some time is dropped by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.logs import classify_lines, round_percent

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which a run that has sent nothing is forgotten.
EXPIRY_MS = 7 * 24 * 3600 * 1000
_FACTS = (
    "role string, error_at bigint, percent double, percent_at bigint, end_at bigint, total_steps bigint, total_at bigint, step bigint, finished boolean"
)
_OUT = "run_path string, model string, percent double, step bigint, total_steps bigint, finished boolean, out_logs bigint, ended_logs bigint, has_error boolean, expired boolean"


@dataclass
class Facts:
    """What the lines of one log have said; each ``_at`` is the place of the line that counts."""

    role: str
    error_at: int | None = None
    percent: float | None = None
    percent_at: int | None = None
    end_at: int | None = None
    total_steps: int | None = None
    total_at: int | None = None
    step: int | None = None
    finished: bool = False

    def add(self, other: Facts) -> None:
        """Take in more lines, whichever came first."""
        self.error_at = _larger(self.error_at, other.error_at)
        self.end_at = _larger(self.end_at, other.end_at)
        self.step = _larger(self.step, other.step)
        self.finished |= other.finished
        if other.percent_at is not None and (self.percent_at is None or other.percent_at > self.percent_at):
            self.percent, self.percent_at = other.percent, other.percent_at
        if other.total_at is not None and (self.total_at is None or other.total_at < self.total_at):
            self.total_steps, self.total_at = other.total_steps, other.total_at

    def counts(self, at: int | None) -> bool:
        """Whether a line at this place stands on or after the last error of an out-log."""
        return at is not None and (self.role != "adcirc_out" or self.error_at is None or at >= self.error_at)


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _facts_of(frame: pd.DataFrame) -> Iterator[tuple[str, Facts]]:
    """Facts of each log in a frame of classified lines."""
    for (name, role), lines in frame.groupby(["file_name", "role"], sort=False):
        out = Facts(role)
        top = lambda rows: int(rows["line_no"].max()) if len(rows) else None
        out.error_at = top(lines[lines["is_error"]])
        out.end_at = top(lines[lines["is_end"]])
        done = lines[lines["percent"].notna() & (lines["percent"] != 0)]
        if len(done):
            last = done.loc[done["line_no"].idxmax()]
            out.percent, out.percent_at = float(last["percent"]), int(last["line_no"])
        begun = lines[lines["total_steps"].notna()]
        if len(begun):
            first = begun.loc[begun["line_no"].idxmin()]
            out.total_steps, out.total_at = int(first["total_steps"]), int(first["line_no"])
        steps = lines["step"].dropna()
        out.step = int(steps.max()) if len(steps) else None
        out.finished = bool(lines["is_finished"].any())
        yield name, out


class RunStates(StatefulProcessor):
    """A map of facts per log, and one timer, for every run."""

    def __init__(self, expiry_ms: int) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logs = handle.getMapState("logs", "file_name string", _FACTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, Facts] = {}
        for frame in rows:
            for name, facts in _facts_of(frame):
                fresh.setdefault(name, Facts(facts.role)).add(facts)
        for name, facts in fresh.items():
            if self.logs.containsKey((name,)):
                held = Facts(*self.logs.getValue((name,)))
                held.add(facts)
                facts = held
            self.logs.updateValue((name,), astuple(facts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry_ms)
        yield self._row(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._row(key[0], True)
        self.logs.clear()
        yield out

    def _row(self, run: str, expired: bool) -> pd.DataFrame:
        logs = sorted((name[0], Facts(*facts)) for name, facts in self.logs.iterator())
        every = [f for _, f in logs]
        out_logs = [f for f in every if f.role in ("adcirc_out", "schism_out")]
        stepping = [f for f in every if f.role == "schism_output"]
        percents = [f.percent for f in every if f.role == "adcirc_out" and f.counts(f.percent_at)]
        schism = any(f.role.startswith("schism") for f in every)
        error = any(f.error_at is not None or f.role in ("adcirc_err", "schism_err") for f in every)
        row = {
            "run_path": run,
            "model": "SCHISM" if schism else "ADCIRC",
            "percent": percents[0] if percents else None,
            "step": max((f.step for f in stepping if f.step is not None), default=None),
            "total_steps": max((f.total_steps for f in stepping if f.total_steps is not None), default=None),
            "finished": any(f.finished for f in stepping),
            "out_logs": len(out_logs),
            "ended_logs": sum(f.counts(f.end_at) for f in out_logs),
            "has_error": error,
            "expired": expired,
        }
        kinds = {"percent": "Float64", "step": "Int64", "total_steps": "Int64"}
        return pd.DataFrame([row]).astype(kinds)


def live_run_status(log_lines: DataFrame, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """``run_path, model, progress, ended, has_error, status, expired`` of the runs that a batch of lines changed (output mode ``update``).

    ``log_lines`` is a stream of ``run_path, file_name, line_no, line``, as ``tail_log_lines`` gives it; lines may come in any order and
    more than once. Progress and end marks count as in the batch report without ``verbose``: of an out-log only from its last error line on.
    Lines that tell nothing are dropped before the shuffle, but for the first of a log. What is kept of a run is an
    entry per log; ``expiry_ms`` after its last line a run gives one more row, with ``expired`` true, and is forgotten.
    Run paths and file names that are null are left out. The session must keep its state in RocksDB (``use_rocksdb``).
    """
    lines = classify_lines(log_lines).where("run_path IS NOT NULL AND role IS NOT NULL")
    telling = (
        F.coalesce(F.col("is_error") | F.col("is_end") | F.col("is_finished"), F.lit(False))
        | F.col("percent").isNotNull()
        | F.col("step").isNotNull()
        | F.col("total_steps").isNotNull()
        | (F.col("line_no") == 0)
    )
    facts = lines.where(telling).drop("line")
    states = facts.groupBy("run_path").transformWithStateInPandas(
        RunStates(expiry_ms), outputStructType=_OUT, outputMode="Update", timeMode="ProcessingTime"
    )
    share = round_percent(F.try_divide((F.lit(100) * F.col("step")).cast("double"), F.col("total_steps").cast("double")))
    stepped = F.when(F.col("finished"), F.lit(100.0)).otherwise(share)
    ended = (F.col("out_logs") > 0) & (F.col("ended_logs") == F.col("out_logs"))
    return states.select(
        "run_path",
        "model",
        F.coalesce(F.when(F.col("model") == "SCHISM", stepped).otherwise(F.col("percent")), F.lit(0.0)).alias("progress"),
        ended.alias("ended"),
        "has_error",
        F.when(F.col("out_logs") == 0, "not_started").when(F.col("has_error"), "error").when(ended, "completed").otherwise("running").alias("status"),
        "expired",
    )


def use_rocksdb(spark) -> None:
    """Keep the state of streams that start from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
