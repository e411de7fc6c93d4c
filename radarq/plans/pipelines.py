"""The three ways in: batch latency reports, the recorder and live statistics."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock
from ..operators import acas, admission, decode, dedup, filters, header, output, stats, timing
from ..sources import recording, writer
from ..streaming import live
from .options import RecorderOptions


def midnight_of_name() -> Column:
    """Midnight of a recording's day, from the date and time in its name (output.file_name)."""
    day = F.regexp_extract("source", r"([0-9]{6})(?:-[^/]*-)?[0-9]{6}[.][^/]*$", 1)
    return F.unix_date(F.to_date(day, "yyMMdd")).cast("long") * 86400


def received(blocks: DataFrame, midnight: int | Column) -> DataFrame:
    """Blocks with their time of reception: source, seq, cat, payload, tod_stamp and ts, in seconds since 1970."""
    told = timing.unwrap_days(header.with_header(blocks))
    return told.select("source", "seq", "cat", "payload", F.col("recv_tod").alias("tod_stamp"), (F.col("abs_tod") + midnight).alias("ts"))


def plots_of(blocks: DataFrame, midnight: int | Column, cat21: bool = False) -> DataFrame:
    """Decoded plots of recorded blocks with tod_stamp, ts (seconds since 1970), full times and delay.

    blocks: source, seq, recv_tod, payload; midnight: of each recording's first day, in seconds since 1970: a
    number for all, or a column of source, as midnight_of_name().
    """
    kept = received(blocks, midnight)
    # only categories 1, 2 and 19 take part in completing times; the others go past that shuffle
    timed = F.col("cat").isin(1, 2, 19)
    short = decode.decode(kept.filter(timed), categories=(1, 2, 19)).withColumn("at", F.col("seq") * 10_000 + F.col("rec_index"))
    full = timing.full_times(short, key=("source", "sac", "sic"), order="at", slot=65536 * 10_000).withColumn("tod", F.col("tod_full")).drop("tod_full", "at")
    rest = decode.decode(kept.filter(~timed), cat21=cat21, categories=tuple(c for c in decode.CATEGORIES if c not in (1, 2, 19)))
    return timing.with_delay(full.unionByName(rest))


def latency_report(spark: SparkSession, path: str | list[str], midnight: int | Column, region: str = "", include_last: bool = False, format: str = "gps1") -> DataFrame:
    """Rows of the availability table for recordings: delays by sensor, category and five minutes."""
    blocks = recording.read_recording(spark, path, format)
    counted = filters.sane_delay(filters.timed(decode.statistics_admission(plots_of(blocks, midnight))))
    windows = stats.delay_windows(filters.persisted(counted), include_last=include_last, received=received(blocks, midnight))
    return stats.availability(windows, region)


def advisories_report(spark: SparkSession, path: str | list[str], midnight: int | Column, format: str = "gps1") -> DataFrame:
    """Collision-avoidance advisories of recordings, one for each sensor and time."""
    return acas.upsert_advisories(acas.resolution_advisories(plots_of(recording.read_recording(spark, path, format), midnight)), ("source", "seq", "rec_index"))


def admitted_blocks(packets: DataFrame, options: RecorderOptions) -> DataFrame:
    """Blocks of the packets that a source takes: flow, seq, recv_tod, ts, src_ip, cat, payload; without duplicates in that mode."""
    taken = admission.admit(packets, options.sources(packets.sparkSession))
    blocks = header.with_header(header.split_packets(taken)).withColumn("seq", F.col("packet_id") * 10_000 + F.col("block_index"))
    blocks = blocks.select("flow", "seq", "recv_tod", "ts", F.col("source_ip").alias("src_ip"), "cat", "payload")
    return dedup.drop_duplicates(blocks) if options.mode_scrm else blocks


def recorder(packets: DataFrame, options: RecorderOptions, folder: str, lap: int = 600) -> DataFrame:
    """Write what a batch of packets holds to files named by lap; returns its counters by flow."""
    blocks = admitted_blocks(packets, options)
    if options.dest_filter_selection == "ground":
        blocks = filters.drop_ground(blocks, key=("flow", "seq"))
    start: Column = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), output.lap(F.col("ts"), lap))
    name = output.file_name(start, options.dest_file_region, options.dest_file_extension, not options.dest_file_nodirectory, options.dest_file_timestamp)
    format = {"gps": "gps1"}.get(options.dest_file_format, options.dest_file_format)
    writer.write_recording(blocks.withColumn("source", name), folder, format, named=True, compression="bzip2" if options.dest_file_compress else "none")
    return stats.flow_bandwidth(blocks.withColumn("n_bytes", F.length("payload")), options.timed_stats_interval or 60)


def record(packets: DataFrame, options: RecorderOptions, folder: str, checkpoint: str) -> StreamingQuery:
    """The recorder on a live feed, a folder for each batch; stops by itself after options.timed seconds, if any."""

    def write(batch: DataFrame, number: int) -> None:
        recorder(batch, options, f"{folder}/batch-{number}")

    query = packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    if options.timed:
        timer = threading.Timer(options.timed, query.stop)
        timer.daemon = True
        timer.start()
    return query


def live_statistics(plots: DataFrame, checkpoint: str) -> StreamingQuery:
    """Latency windows of a stream of plots on the console, every five minutes."""
    told = plots.withColumn("event_time", clock.timestamp_of(F.col("ts")))
    return live.simple_windows(told).writeStream.format("console").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="5 minutes").start()
