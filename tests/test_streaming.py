from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.operators import service
from palimpsest.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2026, 1, 1, h, m), k, v) for i, (h, m, k, v) in enumerate([(0, 1, 1, 1.25), (0, 59, 1, 2.0), (1, 0, 1, 0.5), (0, 1, 2, 3.0), (0, 1, 1, 1.0)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    df.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    got = windows.run_complete(windows.hourly_spend(stream()), "t_spend")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, service.spend_buckets(df).collect()))
    # a second run is one of its own
    again = windows.run_complete(windows.hourly_spend(stream()), "t_spend")
    assert again.count() == got.count() == 3
    busy = windows.run_complete(windows.requests_per_minute(stream(), 1), "t_busy").collect()
    assert [(r.user_id, r.requests) for r in busy] == [(1, 2)]
    assert service.rate_limited(df, 1).count() == 1


def test_files_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-")
    windows.once(windows.arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("length").collect()[0][0] == 5
    jobs = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 2)), ("b", datetime(2026, 1, 1))], "job_id string, received_at timestamp")
    jobs.write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    windows.once(windows.latest_per_job(stream), str(tmp_path / "jobs_out")).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "jobs_out")).collect()) == ["a", "b"]


def test_grouped_cuts_across_batches(spark):
    from palimpsest.plans.runtime import grouped

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 9).alias("k"), F.when(F.col("id") % 4 > 0, "x").alias("n"), "id")
        got = {(r.k, r.n): r.ids for r in grouped(df, ["k", "n"], ["id"], lambda c: [(c["k"][0], c["n"][0], ",".join(map(str, c["id"])))], "k long, n string, ids string").collect()}
        want: dict = {}
        for i in range(100):
            want.setdefault((i % 9, "x" if i % 4 else None), []).append(str(i))
        assert got == {k: ",".join(v) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
