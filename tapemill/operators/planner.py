"""Calendars, missing dates, backfill plans and resumable runs."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Responses of the last days may come later.
AMBIGUOUS_DAYS = 2
STALE_LOCK_SECONDS = 6 * 3600
STATES = ("successful", "non_trading", "temporary_unavailable", "failed")


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(date, is_weekend) of every day from start to end."""
    if start > end:
        raise ValueError("start after end")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return days.withColumn("is_weekend", F.weekday("date") >= 5)


def missing_dates(days: DataFrame, available: DataFrame) -> DataFrame:
    """Days without data."""
    return days.select("date").join(available.select("date").distinct(), "date", "left_anti")


def empty_response(day: Column, today: Column) -> Column:
    """What a response without rows means for its date (T4)."""
    age = F.datediff(today, day)
    return F.when(F.weekday(day) >= 5, "non_trading").when(age <= AMBIGUOUS_DAYS, "temporary_unavailable").otherwise("non_trading")


def latest_states(events: DataFrame) -> DataFrame:
    """(date, state, attempts) from an event log: a date is in the state of its last event (T5)."""
    return events.groupBy("date").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.count("*").alias("attempts"))


def backfill_plan(days: DataFrame, available: DataFrame, states: DataFrame, today: date, retry_failed: bool = False) -> DataFrame:
    """(date, plan), a row for each of a day's labels.

    ``existing``; ``weekend``; ``unresolved``, a temporary skip that is not there, or a working day not before today;
    ``non_trading`` and ``failed`` as recorded; ``request``, a past working day that is neither there, known not to be traded,
    nor failed unless ``retry_failed``. ``states`` has one row per date.
    """
    have = available.select("date").distinct().withColumn("_have", F.lit(True))
    rows = days.join(have, "date", "left").join(states.select("date", "state"), "date", "left")
    there, weekend, late = F.coalesce("_have", F.lit(False)), F.col("is_weekend"), F.col("date") >= F.lit(today)
    was = lambda s: F.coalesce(F.col("state") == s, F.lit(False))
    labels = {
        "existing": there, "weekend": weekend, "unresolved": ~there & (was("temporary_unavailable") | (~weekend & late)), "non_trading": was("non_trading"), "failed": was("failed"),
        "request": ~there & ~weekend & ~late & ~was("non_trading") & (~was("failed") | F.lit(retry_failed)),
    }
    return rows.select("date", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in labels.items()]))).alias("plan"))


def plan_totals(plan: DataFrame, delay: float) -> DataFrame:
    """(plan, dates, minimum_seconds): the pauses between requests, none after the last."""
    if delay < 0:
        raise ValueError("delay below 0")
    n = F.count("*")
    return plan.groupBy("plan").agg(n.alias("dates"), F.when(F.first("plan") == "request", F.greatest(F.lit(0), n - 1) * F.lit(float(delay))).otherwise(0.0).alias("minimum_seconds"))


@dataclass
class RunState:
    """Progress of a backfill; a date is in one state at most."""

    start: str
    end: str
    dates: dict[str, str] = field(default_factory=dict)
    status: str = "running"
    last_attempted: str | None = None
    last_successful: str | None = None

    def record(self, day: date, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"unknown state {state}")
        self.dates[day.isoformat()] = state
        self.last_attempted = day.isoformat()
        if state == "successful":
            self.last_successful = day.isoformat()

    def save(self, path: Path) -> None:
        write_json(path, asdict(self))

    @classmethod
    def load(cls, path: Path) -> RunState | None:
        """The saved state; None if there is none or it is malformed."""
        try:
            state = cls(**json.loads(Path(path).read_text()))
            assert set(state.dates.values()) <= set(STATES)
            for d in state.dates:
                date.fromisoformat(d)
            return state
        except (OSError, ValueError, TypeError, AssertionError, AttributeError):
            return None


def write_json(path: Path, value: object) -> None:
    """Sorted, indented JSON that replaces the file at once (K2)."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    partial = path.with_name(f".{path.name}.{os.getpid()}")
    with open(partial, "w") as out:
        json.dump(value, out, sort_keys=True, indent=2)
        out.flush()
        os.fsync(out.fileno())
    os.replace(partial, path)


def run_backfill(days: list[date], fetch: Callable[[date], int], state: RunState, path: Path, today: date, most: int | None = None, stop: Callable[[], bool] = lambda: False, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> RunState:
    """Fetch days one by one, save after each, go on after failures; ``fetch`` gives the rows written."""
    todo = [d for d in days if state.dates.get(d.isoformat()) not in ("successful", "non_trading")]
    state.status = "running"
    for i, day in enumerate(todo[:most]):
        if stop():
            break
        if i and delay:
            sleep(delay)
        try:
            rows = fetch(day)
            recent = (today - day).days <= AMBIGUOUS_DAYS
            outcome = "successful" if rows else "temporary_unavailable" if recent and day.weekday() < 5 else "non_trading"
        except Exception:  # noqa: BLE001  one day's failure is no other's
            outcome = "failed"
        state.record(day, outcome)
        state.save(path)
    left = [d for d in days if state.dates.get(d.isoformat()) not in ("successful", "non_trading")]
    state.status = "paused" if left else "completed"
    state.save(path)
    return state


@contextlib.contextmanager
def update_lock(path: Path, now: Callable[[], float] = time.time) -> Iterator[None]:
    """An exclusive lock file across processes; one older than six hours is taken over; only the owner removes it."""
    path = Path(path)
    owner = f"{os.getpid()} {now()}"
    for attempt in (0, 1):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if attempt or now() - path.stat().st_mtime < STALE_LOCK_SECONDS:
                raise RuntimeError("another update is running") from None
            path.unlink()
    with os.fdopen(handle, "w") as out:
        out.write(owner)
    try:
        yield
    finally:
        with contextlib.suppress(OSError):
            if path.read_text() == owner:
                path.unlink()


def run_stages(stages: list[tuple[str, Callable[[], object]]]) -> dict[str, dict]:
    """Run every stage in order whatever becomes of the ones before; (state, result or error) of each."""
    out = {}
    for name, stage in stages:
        began = datetime.now()
        try:
            out[name] = {"state": "success", "result": stage()}
        except Exception as error:  # noqa: BLE001
            out[name] = {"state": "failed", "error": str(error)}
        out[name]["seconds"] = (datetime.now() - began).total_seconds()
    return out
