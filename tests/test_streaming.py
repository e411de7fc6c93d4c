"""Streams over several batches return what batch operators do."""

import random
import tempfile

import duckdb
from pyspark.sql import functions as F

from radarq.functions import clock
from radarq.operators import dedup, replies, stats, timing
from radarq.plans import queries as Q
from radarq.plans.oracles import ORACLES
from radarq.plans.streams import drain, quantiles
from radarq.streaming import live


def in_files(df, order, n=4):
    """A stream over n files that come one after the other, one a batch."""
    spark, folder = df.sparkSession, tempfile.mkdtemp(prefix="spark-") + "/rows"
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows(spark, small):
    plots = Q.delays(spark, small).withColumn("event_time", clock.timestamp_of(F.col("ts")))
    last = plots.agg(F.max("ts")).first()[0]
    got = live.finish(drain(live.delay_windows(in_files(plots, "ts")))).filter(F.col("window_start") + 300 <= last - 10)
    want = stats.delay_windows(Q.delays(spark, small)).filter(F.col("window_start") + 300 <= last - 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_quantiles(spark):
    """Exact, between values as SQL has them, without all values in one task."""
    r = random.Random(8)
    for n, most in ((1, 10), (2, 10), (7, 3), (1000, 50), (1001, 10**9)):
        values = [r.randrange(-most, most) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "us long").repartition(3)
        want = duckdb.sql(f"SELECT quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]) FROM (SELECT unnest({values})::BIGINT AS v)").fetchall()[0][0]
        assert quantiles(df, "us", [0.0, 0.25, 0.5, 0.75, 1.0], slot=max(1, most // 20)) == want


def test_late_windows_are_dealt_once_by_many_tasks(spark, tmp_path):
    """Deliveries of several files are a batch each, and equal the SQL."""
    rows = [(i, 10**6 * (1_704_067_200 + 37 * i), i % 50, ("click", "view", "error")[i % 3], i % 9 / 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.expr("timestamp_micros(us)").cast("timestamp_ntz")).drop("us")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = c.sql(ORACLES["stream_late_windows"])
    out = Q.QUERIES["stream_late_windows"](spark, str(tmp_path))
    assert sorted(map(tuple, out.select(*rel.columns).collect())) == sorted(rel.fetchall())
    inputs = out.inputFiles()
    folder = inputs[0].split("/windows/")[0]
    assert spark.read.parquet(f"{folder}/windows/bins").select("batch").distinct().count() == 4
    assert len(spark.read.parquet(f"{folder}/rows").inputFiles()) > 4


def test_duplicates(spark, small):
    rows = Q.repeated(spark, small).withColumn("event_time", clock.timestamp_of(F.col("ts") + 1_000_000))
    got = drain(live.drop_duplicates(in_files(rows, "ts")))
    want = dedup.drop_duplicates(Q.repeated(spark, small))
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())


def test_rough_duplicates(spark, small):
    rows = Q.repeated(spark, small).withColumn("event_time", clock.timestamp_of(F.col("ts") + 1_000_000))
    assert 0 < drain(live.drop_duplicates_roughly(in_files(rows, "ts"))).count() <= rows.count()


def test_full_times(spark, small):
    rows = Q.truncated(spark, small)
    got = drain(live.full_times(in_files(rows, "seq")))
    want = timing.full_times(rows)
    assert sorted((r.seq, r.tod_full or -1.0) for r in got.collect()) == sorted((r.seq, r.tod_full or -1.0) for r in want.collect())


def test_reply_plots(spark):
    r, rows = random.Random(3), []
    for source in ("a", "b"):
        azimuth = 0.0
        for i in range(600):
            azimuth = (azimuth + r.choice((0.01, 0.02, 0.3))) % 180 if r.random() > 0.01 else r.random() * 180
            rows.append((source, i, azimuth, r.choice((1.0, 1.03, 5.0)) + r.random() * 0.01, r.random() < 0.95))
        rows.append((source, 600, None, None, False))
    df = spark.createDataFrame(rows, "source string, seq long, azimuth double, dist double, is_true boolean")
    told = df.withColumn("event_time", clock.timestamp_of(F.col("seq") * 0.01 + 1_000_000))
    got = drain(live.plots(in_files(told, "seq", 5)), rocks=True)
    batch = replies.cluster(df, slot=50)
    want = replies.plot_sizes(batch).join(batch.groupBy("source", "cluster").agg(F.min("seq").alias("first_seq")), ["source", "cluster"])
    columns = ["source", "cluster", "first_seq", "n_followers"]
    assert want.count() > 20 and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_reply_plots_close_when_nothing_comes(spark):
    """A source that falls silent: its cluster closes by time, while another goes on."""
    rows = [("a", i, 10.0 + i * 0.001, 1.0, True, i * 0.1) for i in range(8)] + [("b", i, 10.0, 1.0, True, i * 10.0) for i in range(20)]
    df = spark.createDataFrame(rows, "source string, seq long, azimuth double, dist double, is_true boolean, t double").withColumn("event_time", clock.timestamp_of(F.col("t") + 1_000_000)).orderBy("t")
    got = drain(live.plots(in_files(df, "t", 6), idle="30 seconds"), rocks=True).filter("source = 'a'").collect()
    assert [(x.cluster, x.first_seq, x.n_followers) for x in got] == [(0, 0, 7)]
