"""Streams of several batches."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quern.streaming.events import drain, folded_state, replay


def test_update_keeps_keys_of_earlier_batches(spark, tmp_path):
    for k, rows in enumerate([[(1, 5.0)], [(2, 7.0)], [(1, 1.0), (3, 2.0)]]):  # a file a batch; key 2 changes once only
        spark.createDataFrame([(key, datetime.datetime(2024, 1, 1 + k), k, x) for key, x in rows], "key long, ts timestamp, event_id long, value double").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    s = spark.readStream.schema("key long, ts timestamp, event_id long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    out = s.groupBy("key").applyInPandasWithState(folded_state(lambda now, x: (now[0] + x, now[1] + 1), (0.0, 0)), "key long, level double, flag long", "level double, flag long", "update", GroupStateTimeout.NoTimeout)
    assert sorted(tuple(r) for r in drain(out, "update", ("key",)).collect()) == [(1, 6.0, 2), (2, 7.0, 1), (3, 2.0, 1)]
    counted = s.groupBy("key").agg(F.count("*").alias("n"))
    assert sorted(tuple(r) for r in drain(counted, "update", ("key",)).collect()) == sorted(tuple(r) for r in drain(counted, "complete").collect()) == [(1, 2), (2, 1), (3, 1)]


def test_replay_has_several_batches(spark, sf_dir):
    seen = []
    q = replay(spark, sf_dir, 3).writeStream.foreachBatch(lambda df, n: seen.append((n, df.count()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and sum(n for _, n in seen) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
