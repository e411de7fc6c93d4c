"""Streaming queries run to the end of what is there: each reads its table as a stream and returns what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import replies, stats
from ..streaming import live
from . import queries as Q
from . import synthetic as S
from .scratch import shared_folder


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, rocks: bool = False, clock_timers: bool = False) -> DataFrame:
    """Run a stream over all that its source has now; its rows as a table.

    rocks: with the state store that lists, maps and timers need. clock_timers: its timers go by the clock on the wall and would
    keep it running for ever, so it is stopped once a batch has brought nothing.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE, None)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append")
    if rocks:
        spark.conf.set(STORE, ROCKS)
    try:
        if clock_timers:
            query = writer.trigger(processingTime="1 second").start()
            while query.isActive and not any(p.numInputRows == 0 and p.batchId > 0 for p in query.recentProgress):
                query.awaitTermination(0.5)
            query.stop()
            if query.exception():
                raise query.exception()
        else:
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        if rocks:
            spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; its last letter is a pattern, as a stream reads folders or patterns only."""
    schema = S.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@Q.query
def stream_delay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.delays(spark, sf_dir, streamed)
    closed = drain(live.delay_windows(rows.withColumn("event_time", clock.timestamp_of(F.col("ts")))))
    return live.finish(closed).drop("mode")


@Q.query
def stream_simple_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.delays(spark, sf_dir, streamed)
    closed = drain(live.simple_windows(rows.withColumn("event_time", clock.timestamp_of(F.col("ts"))), period=3600))
    return closed.select(*stats.WINDOW, "cuenta", "media")


@Q.query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.repeated(spark, sf_dir, streamed)
    return drain(live.drop_duplicates(rows.withColumn("event_time", clock.timestamp_of(F.col("ts") + 1_000_000)))).select("seq", "ts")


@Q.query
def stream_full_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(live.full_times(Q.truncated(spark, sf_dir, streamed), wide=True)).select("seq", "cat", "tod_full")


@Q.query
def stream_reply_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots of a live stream of replies; the last reply of each lap is followed by the end of its source."""
    found = replies.project(Q.reply_records(spark, sf_dir, streamed))
    ends = F.when(F.col("seq") % 1000 == 999, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = found.withColumn("end", F.explode(ends)).withColumn("azimuth", F.when(F.col("end") == 0, F.col("azimuth")))
    rows = rows.withColumns({"seq": F.col("seq") * 2 + F.col("end"), "event_time": clock.timestamp_of(F.col("seq") * 0.01 + 1_000_000)})
    out = drain(live.plots(rows), rocks=True)
    return out.select("source", "cluster", F.expr("first_seq div 2").alias("first_seq"), "n_followers")


@Q.query
def stream_live_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each sensor by the clock on the wall, told at the end of the stream, behind the last event."""
    rows = Q.delays(spark, sf_dir, streamed)
    ends = F.when(F.col("seq") < 5000, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))  # among these is every sensor
    marked = rows.select(*stats.SENSOR, "delay", F.explode(ends).alias("end"))
    told = drain(live.histograms(marked, period=86400), rocks=True, clock_timers=True)
    return stats.statistics_of(told, stats.SENSOR).select(*stats.SENSOR, "cuenta", "max", "min", "media", "mode", "p99")


@Q.query
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of pipeline_counters, observed while the stream runs."""
    p = S.plots(spark, sf_dir, streamed)
    told = live.Counters()
    spark.streams.addListener(told)
    try:
        seen = p.observe(told.name, *stats.counters(F.col("sac") != 3, F.col("cat") != 34, ~F.col("flag_test"), F.col("seq") % 10 != 0, F.col("n_bytes")))
        run = seen.writeStream.format("noop").option("checkpointLocation", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
        run.awaitTermination()
        sums = told.wait(run.runId)
    finally:
        spark.streams.removeListener(told)
    return spark.createDataFrame([tuple(sums.values())], ", ".join(f"{k} long" for k in sums))


def quantiles(rows: DataFrame, column: str, parts: list[float], slot: int = 60_000_000) -> list[float]:
    """Quantiles of a column of integers, between two of its values by their distance, as SQL's quantile_cont; exact, and no task holds all values.

    Values are counted by slots, and numbered in the slots that hold one sought.
    """
    told = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.floor(F.col(column) / slot).alias("s"))
    so_far = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    slots = told.groupBy("s").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).persist()
    try:
        n = slots.agg(F.sum("n")).first()[0]
        if not n:
            return [float("nan")] * len(parts)
        places = [(n - 1) * q for q in parts]
        sought = sorted({min(x, n - 1) for p in places for x in (int(p), int(p) + 1)})
        held = slots.select("s", "before", F.explode(F.array(*map(F.lit, sought))).alias("place")).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
        least = held.groupBy("s").agg(F.first("before").alias("before"), F.collect_set("place").alias("places"))  # as many as are sought, at most
        values = told.join(F.broadcast(least), "s").groupBy("s", "v").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("places").alias("places"))
        values = values.withColumn("to", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("v")))
        found = values.select("v", F.explode("places").alias("place"), "to", "n").filter((F.col("place") < F.col("to")) & (F.col("place") >= F.col("to") - F.col("n"))).collect()
    finally:
        slots.unpersist()
    at = {r.place: r.v for r in found}
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


#: Deliveries that a stream takes one by one, and which event comes how many deliveries late.
LATE_FILES, LATE_EACH = 4, 7


@Q.query
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four deliveries by time; every seventh of the first two comes with the next delivery but one, late, and corrects its window."""
    rows = Q.delays(spark, sf_dir)
    edges = quantiles(rows, "us", [k / LATE_FILES for k in range(1, LATE_FILES)])
    own = F.lit(0)
    for k in range(LATE_FILES - 1):
        own = own + (F.col("us") > F.lit(edges[k])).cast("int")
    dealt = rows.withColumn("own", own).withColumn("file", F.when((F.col("own") < 2) & (F.col("seq") % LATE_EACH == 0), F.col("own") + 2).otherwise(F.col("own"))).select("sac", "sic", "cat", "ts", "delay", "file")
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    taken = live.LateRows(spark, f"{folder}/windows", period=3600)
    # dealt once: a filter on the delivery would be moved below what makes it, and work that out for each row many times over
    dealt.write.partitionBy("file").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    for k in range(LATE_FILES):  # one delivery after the other, each a batch of its own, of as many files as tasks write
        dealt.filter(F.col("file") == k).drop("file").write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(dealt.drop("file").schema).parquet(f"{folder}/rows")
        stream.writeStream.foreachBatch(taken.take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return taken.windows().select(*stats.WINDOW, "n_late", "cuenta", "media", "mode", "p99")
