"""What a long run is doing: a bar with speed and remaining time on standard error, from Spark's own task counts."""

from __future__ import annotations

import sys
import threading
import time

from pyspark.sql import SparkSession

# Length of the bar, seconds between two prints.
BAR, EVERY = 40, 0.5


def time_text(seconds: float) -> str:
    """The two largest units, as formatting.format_time_delta."""
    s = int(seconds)
    for size, unit, below, small in ((86400, "d", 3600, "h"), (3600, "h", 60, "m"), (60, "m", 1, "s")):
        if s >= size:
            return f"{s // size}{unit} {s % size // below}{small}"
    return f"{s}s"


def speed_text(done: int, seconds: float) -> str:
    """Units a second, or a minute if there are fewer than four a second; four digits at most."""
    if seconds <= 0:
        return "unknown"
    rate, unit = done / seconds, "sec"
    if rate < 4:
        rate, unit = rate * 60, "min"
    return (f"{int(rate):4d}" if rate < 10_000 else ">999") + f"/{unit}"


def bar_text(label: str, done: int, todo: int, seconds: float) -> str:
    share = min(1.0, done / todo) if todo else 1.0
    left = seconds / share - seconds if share else 0.0
    full = int(share * BAR)
    return f"{label}: {'=' * full}{' ' * (BAR - full)} {100 * share:5.1f}% in {time_text(seconds)} [ {speed_text(done, seconds)} ] [ ETA {time_text(left):>8} ]"


def finished_text(label: str, done: int, todo: int, seconds: float) -> str:
    return f"{label}: {'=' * BAR} {done}/{todo} in {time_text(seconds)} [ {speed_text(done, seconds)} ]"


class Progress:
    """``with Progress(spark, "Hashing files"):`` shows the tasks of the jobs that run meanwhile."""

    def __init__(self, spark: SparkSession, label: str, shown: bool = True, out=None):
        self.tracker, self.label, self.shown, self.out = spark.sparkContext.statusTracker(), label, shown, out or sys.stderr
        self.seen: dict[int, tuple[int, int]] = {}
        self.stop = threading.Event()

    def poll(self) -> tuple[int, int]:
        """(done, known) tasks of all stages seen so far."""
        active = set(self.tracker.getActiveStageIds())
        for stage in active:
            if info := self.tracker.getStageInfo(stage):
                self.seen[stage] = info.numCompletedTasks, info.numTasks
        for stage in set(self.seen) - active:
            self.seen[stage] = self.seen[stage][1], self.seen[stage][1]
        return sum(d for d, _ in self.seen.values()), sum(n for _, n in self.seen.values())

    def _run(self) -> None:
        while not self.stop.wait(EVERY):
            done, todo = self.poll()
            if todo:
                self.out.write(bar_text(self.label, done, todo, time.time() - self.began) + "\r")
                self.out.flush()

    def __enter__(self) -> Progress:
        self.began = time.time()
        if self.shown:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *error) -> None:
        self.stop.set()
        if self.shown:
            self.thread.join()
            done, todo = self.poll()
            self.out.write(" " * 120 + "\r" + finished_text(self.label, done, todo, time.time() - self.began) + "\n")
