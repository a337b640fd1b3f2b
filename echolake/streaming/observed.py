"""Counters of a running stream, without a second pass over it, and maintenance by the clock."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from echolake.operators.metrics import counter_columns, finished

NAME = "cache_counters"


def observed(log: DataFrame, name: str = NAME) -> DataFrame:
    """``log``, batch or stream, which reports its counters as it flows by, whatever it is written to."""
    return log.observe(name, *counter_columns())


class Counters(StreamingQueryListener):
    """Adds up what the micro-batches of :func:`observed` logs report; to be added to ``spark.streams``.

    A micro-batch that is repeated after a restart is counted once: batches are known by query and number.
    """

    def __init__(self, name: str = NAME):
        self.name, self.parts, self.lock = name, {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.lock:
                self.parts[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict:
        """The sums so far, under the names of :func:`counter_columns`; least and greatest latencies are null where there was none."""
        with self.lock:
            parts = list(self.parts.values())
        out: dict = {}
        for part in parts:
            for name, v in part.items():
                if name.startswith(("min_", "max_")):
                    both = [x for x in (out.get(name), v) if x is not None]
                    out[name] = (min if name.startswith("min_") else max)(both, default=None)
                else:
                    out[name] = out.get(name, 0) + v
        return out

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """One row as :func:`echolake.operators.metrics.counters` gives it for all that has flowed by; none before the first batch."""
        held = self.totals()
        kinds = {n: "long" for n in held}
        schema = ", ".join(f"{n} {t}" for n, t in kinds.items()) or "requests long"
        sums = spark.createDataFrame([tuple(held.values())] if held else [], schema)
        return finished(sums) if held else sums


def every(spark: SparkSession, run: Callable[[int], None], checkpoint: str, interval: str = "60 seconds") -> StreamingQuery:
    """Calls ``run`` with the number of the round once an ``interval``, on the driver: for reports, purges and new index versions.

    It is a streaming query over Spark's own clock source, so that it is seen, stopped and restarted as other queries are; a round that
    takes longer than the interval delays the next one, and none runs beside another.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("false")
    return ticks.writeStream.foreachBatch(lambda _, number: run(number)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
