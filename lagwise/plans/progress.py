"""K8: progress of running jobs, from Spark's own status tracker, without touching the plan."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from lagwise.functions.render import duration


def line(done: int, total: int, elapsed: float) -> str:
    """Tasks done, time passed, time a task and the time that the rest will take at this rate."""
    if not done:
        return f"0/{total} tasks, {duration(int(elapsed * 1000))}"
    each = 1000 * elapsed / done
    return f"{done}/{total} tasks, {duration(int(elapsed * 1000))}, {each:.0f} ms a task, {duration(int(each * (total - done)))} left"


class Progress:
    """While the block runs, a line every ``every`` seconds about the stages at work."""

    def __init__(self, spark: SparkSession, every: float = 5.0, say: Callable[[str], None] | None = None):
        self.tracker, self.every = spark.sparkContext.statusTracker(), every
        self.say = say or (lambda text: print(text, file=sys.stderr))
        self.stop, self.begun = threading.Event(), {}

    def _look(self) -> None:
        while not self.stop.wait(self.every):
            for stage in self.tracker.getActiveStageIds():
                info = self.tracker.getStageInfo(stage)
                if info is not None and info.numTasks:
                    begun = self.begun.setdefault(stage, time.time())
                    self.say(f"stage {stage}: {line(info.numCompletedTasks, info.numTasks, time.time() - begun)}")

    def __enter__(self) -> Progress:
        self.thread = threading.Thread(target=self._look, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
