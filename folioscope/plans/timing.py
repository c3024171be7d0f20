"""Wall-clock times of the stages of a run, kept on the driver and read back as a table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from folioscope import schemas


class Stopwatch:
    """Seconds per run and stage; a stage timed again replaces its earlier time."""

    def __init__(self) -> None:
        self._seconds: dict[tuple[str, str], float] = {}

    @contextmanager
    def stage(self, question_id: str, name: str) -> Iterator[None]:
        """Time the block; the time is kept when the block raises, too."""
        begun = time.perf_counter()
        try:
            yield
        finally:
            self._seconds[question_id, name] = time.perf_counter() - begun

    def table(self, spark: SparkSession) -> DataFrame:
        """``question_id, stage, seconds``."""
        rows = [(question, stage, seconds) for (question, stage), seconds in self._seconds.items()]
        return spark.createDataFrame(rows, schemas.TIMINGS)


@contextmanager
def timed(watch: Stopwatch | None, question_id: str, name: str) -> Iterator[None]:
    """Time the block when there is a stopwatch."""
    if watch is None:
        yield
        return
    with watch.stage(question_id, name):
        yield
