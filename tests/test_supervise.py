"""Jobs that fail, start again and leave a table of what they did."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException

from hazardlens.streaming import jobs, supervise

SCHEMA = "id string, time timestamp"


def landed(spark, folder, *moments):
    spark.createDataFrame([(str(i), m) for i, m in enumerate(moments)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_bad_batch_is_run_again_and_told(spark, tmp_path):
    late, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    for moments in ([now, now], [now], [late]):
        landed(spark, tmp_path / "in", *moments)
    failed, seen, pauses = [], [], []

    def write(batch, batch_id):
        batch.count()
        if batch_id == 1 and len(failed) < 2:
            failed.append(batch_id)
            raise ValueError("bad batch")
        seen.append(batch_id)

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        unique = jobs.dedupe_stream(jobs.watermarked(stream))
        return unique.writeStream.queryName("kept").trigger(**jobs.DRAIN).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).start()

    told = supervise.ProgressTable(spark, str(tmp_path / "told"))
    spark.streams.addListener(told)
    try:
        assert supervise.keep_running(start, supervise.Restarts(first=0.5), pauses.append) == 2
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(told)
    told.flush()
    assert pauses == [0.5, 1.0] and sorted(set(seen)) == list(range(max(seen) + 1))
    table = told.table()
    assert [e for (e,) in rows(table.filter("event <> 'batch'"), "event")] == ["ended", "failed", "failed"] + ["started"] * 3
    assert all("bad batch" in r["error"] and r["query"] == "kept" for r in table.filter("event = 'failed'").collect())
    sums = table.filter("event = 'batch'").selectExpr("sum(input_rows)", "max(state_rows)", "sum(late_rows)", "max(watermark)").first()
    assert sums[0] >= 4 and sums[1] >= 2 and sums[2] >= 1 and sums[3] == now - dt.timedelta(hours=2)


def test_too_many_failures(spark, tmp_path):
    landed(spark, tmp_path / "in", dt.datetime(2024, 1, 1))

    def write(batch, batch_id):
        raise ValueError("always")

    def start():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        return stream.writeStream.trigger(**jobs.DRAIN).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).start()

    pauses = []
    with pytest.raises(StreamingQueryException, match="always"):
        supervise.keep_running(start, supervise.Restarts(most=1), pauses.append)
    assert pauses == [1.0]


def test_pauses():
    rule = supervise.Restarts(most=3, within=100, first=1, longest=3)
    assert [rule.pause([0.0, 1.0, 2.0][: i + 1], float(i)) for i in range(3)] == [1, 2, 3]
    assert rule.pause([0.0, 1.0, 2.0, 3.0], 3.0) is None
    assert rule.pause([0.0, 1.0, 2.0, 300.0], 300.0) == 1
