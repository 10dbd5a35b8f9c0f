"""Progress observers for batch jobs and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Table that counts its rows, and other metrics, while it is written."""
    watch = Observation(name)
    counted = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()])
    return counted, watch


class ProgressListener(StreamingQueryListener):
    """Calls back with the progress of every micro-batch of every stream."""

    def __init__(self, on_progress: Callable[[dict], None]):
        self._on_progress = on_progress

    def onQueryStarted(self, event) -> None:
        self._on_progress({"stage": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._on_progress({"stage": "running", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._on_progress({"stage": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self._on_progress({"stage": "ended", "id": str(event.id), "error": event.exception})
