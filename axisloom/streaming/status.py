"""Progress of runs: heartbeats as small JSON files, and running statistics."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.sources.store import RunFolder

STALE_AFTER = 60.0


@dataclass
class Status:
    """Counts of a node's cells, with times."""

    total: int | None
    started: int = 0
    done: int = 0
    failed: int = 0
    began: float | None = None
    ended: float | None = None

    def start(self, n: int = 1) -> None:
        self.began = self.began or time.monotonic()
        self.started += n

    def finish(self, n: int = 1, failed: int = 0) -> None:
        self.done += n
        self.failed += failed
        if self.total is not None and self.done + self.failed >= self.total:
            self.ended = time.monotonic()

    @property
    def share(self) -> float:
        return 0.0 if not self.total else (self.done + self.failed) / self.total

    @property
    def elapsed(self) -> float:
        return 0.0 if self.began is None else (self.ended or time.monotonic()) - self.began

    @property
    def remaining(self) -> float | None:
        return None if not self.share else self.elapsed * (1 - self.share) / self.share


@dataclass
class Running:
    """Mean, deviation and maximum of values that come one by one."""

    count: int = 0
    mean: float = 0.0
    squares: float = 0.0
    most: float = field(default=float("-inf"))

    def add(self, x: float) -> None:
        self.count += 1
        step = x - self.mean
        self.mean += step / self.count
        self.squares += step * (x - self.mean)
        self.most = max(self.most, x)

    @property
    def deviation(self) -> float:
        return 0.0 if self.count < 2 else (self.squares / (self.count - 1)) ** 0.5


def running_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """The same statistics of groups, as partial aggregates; the deviation of one value is 0."""
    v = F.col(value).cast("double")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.nullif(F.stddev_samp(v), F.lit(float("nan"))), F.lit(0.0)), 6).alias("deviation"), F.max(v).alias("most"))


def write_heartbeat(spark: SparkSession, folder: str, progress: Mapping[str, Any]) -> None:
    """Note the progress of a run in its folder."""
    run, path = RunFolder(spark, folder), f"{folder.rstrip('/')}/heartbeat"
    note = f"{path}-{time.time_ns():020d}.json"
    run._write_text(note, json.dumps({"at": time.time(), "progress": dict(progress)}))
    for old in _notes(run):
        if f"{run.path}/{old}" < note:
            run._delete(f"{run.path}/{old}")


def _notes(run: RunFolder) -> list[str]:
    return sorted(n for n in run._list(run.path) if n.startswith("heartbeat-") and n.endswith(".json"))


class Heartbeat:
    """Notes the progress of a run every so often while a block runs, and once at its end."""

    def __init__(self, spark: SparkSession, folder: str, progress: Callable[[], Mapping[str, Any]], every: float = 10.0) -> None:
        self.spark, self.folder, self.progress, self.every = spark, folder, progress, every
        self._over = threading.Event()
        self._thread = InheritableThread(target=self._beat, session=spark)
        self._thread.daemon = True

    def _beat(self) -> None:
        while not self._over.wait(self.every):
            write_heartbeat(self.spark, self.folder, self.progress())

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, *_: Any) -> None:
        self._over.set()
        self._thread.join()
        write_heartbeat(self.spark, self.folder, self.progress())


def read_heartbeat(spark: SparkSession, folder: str, now: float | None = None) -> dict[str, Any] | None:
    """The last note, its age, and whether it is stale."""
    run = RunFolder(spark, folder)
    notes = _notes(run)
    if not notes:
        return None
    found = json.loads(run._read_text(f"{run.path}/{notes[-1]}"))
    age = (time.time() if now is None else now) - found["at"]
    return found | {"age": age, "stale": age > STALE_AFTER}
