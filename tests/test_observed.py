"""Counters of streams as they flow by equal those of the batch; rounds come by the clock."""

from __future__ import annotations

import random
import time

from echolake.operators import metrics
from echolake.streaming import observed

SCHEMA = "seq long, outcome string, latency_ms long, prompt_tokens long, completion_tokens long"


def test_counters_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(metrics.OUTCOMES), rng.choice([None, rng.randrange(900)]), rng.randrange(50), rng.randrange(90)) for i in range(300)]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    counts = observed.Counters()
    spark.streams.addListener(counts)
    try:
        assert counts.snapshot(spark).count() == 0
        for k in range(3):  # a restart from the checkpoint each time
            spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            log = observed.observed(spark.readStream.schema(SCHEMA).parquet(source))
            log.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # the listener hears of a batch soon after
            if counts.totals().get("requests") == sum(o in ("hit", "stream_hit", "miss", "stream_miss") for _, o, *_ in rows):
                break
            time.sleep(0.1)
        got = counts.snapshot(spark).first().asDict()
    finally:
        spark.streams.removeListener(counts)
    assert got == metrics.counters(spark.createDataFrame(rows, SCHEMA)).first().asDict()


def test_rounds_by_the_clock(spark, tmp_path):
    rounds: list[int] = []
    query = observed.every(spark, rounds.append, str(tmp_path / "clock"), "1 second")
    try:
        for _ in range(200):
            if len(rounds) >= 2:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert rounds[:2] == [0, 1]
