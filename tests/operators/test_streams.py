from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.streaming import live


def test_late_rows_of_every_micro_batch_are_counted(spark, tmp_path):
    """150 micro-batches, which is more than a query remembers; all but the first have a row that is too late."""
    start = datetime(2026, 1, 1)
    rows = [(k, start + timedelta(hours=k)) for k in range(150)] + [(k, start - timedelta(days=9)) for k in range(2, 150)]
    df = spark.createDataFrame(rows, "k INT, at TIMESTAMP")
    for k in range(150):
        df.where(F.col("k") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = stream.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour")).count()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    with live.LateRows(spark) as late:
        query = counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert late.of(query) == 148
    assert len(query.recentProgress) <= 100


def in_batches(spark, path, df, n):
    """df (batch, ...) as a stream, a file and so a micro-batch for each number."""
    for k in range(n):
        df.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain_alerts(samples, hold, forget=None):
    """(since, fired_at) of one alert's samples (second, value) by a walk in the order of time."""
    out, since, fired, seen = [], None, False, None
    for at, value in sorted(samples):
        if not value or (forget is not None and seen is not None and at - seen > forget):
            since, fired = None, False
        if value:
            since = at if since is None else since
            if not fired and at - since >= hold:
                fired = True
                out.append((since, at))
        seen = at
    return out


@pytest.mark.parametrize("forget", [None, 90])
def test_alerts_are_told_in_the_order_of_time(spark, tmp_path, forget):
    """Samples that come up to 300 s late, over 6 micro-batches, and a repeated one, are met as a walk over all of them in order does; a null is not true."""
    rng, start = np.random.default_rng(1), datetime(2026, 1, 1)
    rows = [(alert, s, bool(rng.random() < 0.85)) for alert in "abc" for s in sorted(rng.choice(6000, 200, replace=False).tolist())]
    dealt = [(min(5, (s + int(rng.integers(0, 300)) * (k % 4 == 0)) // 1000), alert, start + timedelta(seconds=s), v) for k, (alert, s, v) in enumerate(rows)]
    end = [(5, "end", start + timedelta(seconds=9000), None)]
    df = spark.createDataFrame([*dealt, dealt[0], *end], "batch INT, alert STRING, at TIMESTAMP, value BOOLEAN")
    stream = in_batches(spark, str(tmp_path / "in"), df, 6)
    alerts, got = live.alert_stream(stream, 60, late="20 minutes", forget_s=forget), []
    run = alerts.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = [(alert, a, b) for alert in "abc" for a, b in plain_alerts([(s, v) for x, s, v in rows if x == alert], 60, forget)]
    assert len(want) > 10
    assert sorted((r.alert, int((r.since - start).total_seconds()), int((r.fired_at - start).total_seconds())) for r in got) == sorted(want)


def test_first_responses_survive_a_loss_between_micro_batches(spark, tmp_path):
    """The query is lost after an epoch was written and before it was noted; run again, nothing counts twice and the first response stays."""
    start = datetime(2026, 1, 1)
    rows = [(k, run, q, 100 * k + q, q, float(k == 0), None, "a", 1.0, 10**k, 1, start - timedelta(days=k)) for k in range(4) for run in (1, 2, None) for q in range(k, 6)]
    df = spark.createDataFrame([*rows, rows[0]], "batch INT, run_id LONG, question_id LONG, response_id LONG, position LONG, score DOUBLE, error_type STRING, raw_response STRING, latency_ms DOUBLE, input_tokens LONG, output_tokens LONG, created_at TIMESTAMP")
    stream = in_batches(spark, str(tmp_path / "in"), df.withColumn("estimated_cost", F.lit(1).cast("decimal(20,8)")), 4)
    sink = live.FirstResponses(str(tmp_path / "first"), buckets=3, block=4)

    def lost(batch, epoch):
        sink(batch, epoch)
        if epoch == 2:
            raise RuntimeError("lost")

    def run(fn):
        stream.writeStream.foreachBatch(fn).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(lost)
    run(sink)
    got = {(r.run_id, r.block_index): (r.responses, r.score_sum, r.known_input_tokens) for r in sink.progress(spark).collect()}
    assert got == {(run, block): (n, float(n), n) for run in (1, 2, None) for block, n in ((0, 4), (1, 2))}
