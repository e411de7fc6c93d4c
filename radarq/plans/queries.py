"""The registered queries: each operator over whole tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import clock, codes
from ..operators import acas, admission, decode, dedup, filters, header, output, replies, stats, timing, transcode
from ..sources import archive, recording, stored, writer
from . import pipelines
from . import synthetic as S
from .scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c in columns})


def delays(spark: SparkSession, sf_dir: str, table: S.Table = S.table) -> DataFrame:
    return timing.with_delay(S.plots(spark, sf_dir, table))


@query
def delay_windows_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.delay_windows(delays(spark, sf_dir)).drop("mode")


@query
def delay_windows_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = delays(spark, sf_dir).withColumn("window_start", clock.floor_to(F.floor("ts").cast("long"), 86400))
    return stats.delay_statistics(told, ("cat", "window_start")).select("cat", "window_start", "cuenta", "mode", "p99")


@query
def delay_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(delays(spark, sf_dir)).select("sac", "sic", "cat", "bin", "n")


@query
def delay_windows_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.delay_windows(delays(spark, sf_dir), include_last=False, period=86400)
    return out.select(*stats.WINDOW, "cuenta", "media")


@query
def delay_windows_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = delays(spark, sf_dir).withColumn("window_start", F.lit(0).cast("long"))
    return stats.delay_statistics(told, compat=True).select("sac", "sic", "cat", "cuenta", "p99")


@query
def delay_day_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays(spark, sf_dir).filter(F.abs(F.col("tod_stamp") - F.col("tod")) > 43200).select("seq", "tod_stamp", "tod", "delay")


@query
def delay_over_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots measured before midnight and received after, and the other way round."""
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    stamp, late = F.col("seq") * 331 % 256 - 128, F.col("seq") * 17 % 1024 - 512
    times = e.select("seq", *((F.pmod(t, F.lit(S.DAY128)) / 128.0).alias(n) for n, t in (("tod_stamp", stamp), ("tod", stamp - late))))
    return timing.with_delay(times)


@query
def delay_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = filters.without_tests(filters.timed(delays(spark, sf_dir)))
    return filters.sane_delay(told).select("seq", "delay")


def availability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of windows: the later one holds all delays, the earlier those of half of the rows."""
    told = delays(spark, sf_dir)
    parts = []
    for seq, plots in ((1, told.filter(F.col("seq") % 2 == 0)), (2, told)):
        windows = stats.delay_windows(plots, period=3600)
        parts.append(stats.availability(windows, "north").withColumn("cat", F.substring("sac_sic_cat", 9, 3).cast("int")).withColumn("seq", F.lit(seq)))
    return parts[0].unionByName(parts[1])


@query
def availability_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.upsert_availability(availability_rows(spark, sf_dir)).drop("cat", "seq")


@query
def availability_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries of availability_upsert, one after the other, and the second again, into a table that is there."""
    rows = availability_rows(spark, sf_dir).filter(F.col("cat").isin(list(filters.PERSISTED)))
    shape = rows.drop("cat", "seq").schema
    table = stored.StoredTable(spark, f"{shared_folder(spark)}/availability-{uuid.uuid4().hex}", shape, ("sac_sic_cat", "region", "timestamp"), buckets=16)
    for batch in (1, 2, 2):
        table.upsert(rows.filter(F.col("seq") == batch), ("seq",), batch, "north")
    return table.read()


@query
def archive_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """availability_rollup by increments: windows of even hours, then of odd ones, and these again."""
    windows = stats.delay_windows(delays(spark, sf_dir)).persist()  # else each increment, and each look at one, would make them anew
    kept = archive.Archive(spark, f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}")
    try:
        for batch in (0, 1, 1):
            kept.add(windows.filter(F.floor(F.col("window_start") / 3600) % 2 == batch), batch)
    finally:
        windows.unpersist()
    return rounded(kept.read(), "avg_media", "max_media", "min_media")


@query
def availability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.archive(stats.delay_windows(delays(spark, sf_dir)))
    return rounded(out.select("steps", *stats.SENSOR, "slot_start", "n_windows", "avg_media", "max_media", "min_media"), "avg_media", "max_media", "min_media")


@query
def archive_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = output.archive_update(stats.delay_windows(delays(spark, sf_dir), period=3600))
    return out.select(*stats.WINDOW, "cuenta", "mode", "min", "max")


@query
def flow_bandwidth_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = S.plots(spark, sf_dir).withColumn("flow", F.format_string("radar%d", "sac"))
    return rounded(stats.flow_bandwidth(packets, 3600), "bytes_per_s")


@query
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.plots(spark, sf_dir)
    return stats.pipeline_counters(p, F.col("sac") != 3, F.col("cat") != 34, ~F.col("flag_test"), F.col("seq") % 10 != 0, F.col("n_bytes"))


SOURCES = [(1, "alpha", "239.0.0.1", 5000, "0.0.0.0"), (2, "beta", "239.0.0.1", 5000, "10.0.0.2"), (3, "gamma", "239.0.0.1", 5001, "10.0.0.3"), (4, "delta", "239.0.0.2", 5000, "10.0.0.1"), (5, "omega", "239.0.0.2", 5000, "0.0.0.0")]


def sources_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "position int, name string, group_ip string, port int, source_ip string")


@query
def admit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    packets = e.select(
        F.col("event_id").alias("packet_id"), F.format_string("239.0.0.%d", F.col("user_id") % 3 + 1).alias("group_ip"), (F.col("event_id") % 2 + 5000).cast("int").alias("port"), F.format_string("10.0.0.%d", F.col("event_id") % 4 + 1).alias("source_ip")
    )
    return admission.admit(packets, sources_table(spark)).select("packet_id", "flow")


@query
def source_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.subscriptions(sources_table(spark)).select("position", "name")


def _plain(df: DataFrame) -> DataFrame:
    return df.select("seq", "sac", "sic", "cat")


@query
def filter_category_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.category(S.plots(spark, sf_dir), keep=48))


@query
def filter_category_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.category(S.plots(spark, sf_dir), drop=48))


@query
def filter_category_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.category_signed(S.plots(spark, sf_dir), -10))


@query
def filter_sensor_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.sensor(S.plots(spark, sf_dir), 2, 3))


@query
def filter_sensor_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = S.plots(spark, sf_dir).withColumn("sic", F.when(F.col("seq") % 9 != 0, F.col("sic")))
    return _plain(filters.sensor(some, 2, 3, drop=True))


@query
def filter_sensor_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.sensor_signed(S.plots(spark, sf_dir), (1, 2), (3, 4)))


@query
def filter_sensor_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.sensor_signed(S.plots(spark, sf_dir), (-2, -3)))


@query
def filter_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.persisted(S.plots(spark, sf_dir)))


@query
def filter_time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.time_of_day(S.plots(spark, sf_dir), "22:30", "01:15", column="tod_stamp"))


@query
def filter_polar_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filters.polar_band(S.plots(spark, sf_dir), (90.0, 180.0), (10.0, 200.0)))


@query
def filter_ground_reframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    record = lambda k: (S.b(0xC1), S.b(0x01), S.b(0x02), S.b(20), S.b((F.col("seq") + k) % 256), S.b(F.col("seq") * 331 % S.DAY128, 3), S.b((F.col("seq") + k) % 4 * 1024, 2))
    blocks = e.select(F.lit("events").alias("source"), "seq", F.lit(48).alias("cat"), F.when(F.col("seq") % 5 == 0, S.block(48, *record(1))).otherwise(S.block(48, *record(0), *record(1), *record(2))).alias("payload"))
    return filters.drop_ground(blocks).select("seq", F.hex("payload").alias("payload"))


@query
def merge_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") - F.col("event_id") % 4) * 3.5 + 70000.0).alias("at"))
    parts = [e.filter(F.col("seq") % 2 == k).select("seq", F.pmod("at", F.lit(86400.0)).alias("recv_tod")) for k in (0, 1)]
    return timing.merge_recordings(*parts).select("ordinal", "source", "seq", "abs_tod")


@query
def sensor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header.sensors(S.blocks(spark, sf_dir, 48).unionByName(S.blocks(spark, sf_dir, 34)).drop("cat"))


@query
def sensor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header.sensor_list(S.blocks(spark, sf_dir, 48).unionByName(S.blocks(spark, sf_dir, 34)).drop("cat"))


@query
def sensor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation").filter("n_nationkey < 14").withColumn("k", F.col("n_nationkey"))
    names = n.select((F.col("k") % 2 + 1).cast("int").alias("sac"), (F.floor(F.col("k") / 2) + 1).cast("int").alias("sic"), F.upper(F.substring("n_name", 1, 2)).alias("sac_short"), F.col("n_name").alias("sac_long"), F.substring("n_name", 1, 3).alias("sic_short"), F.col("n_name").alias("sic_long"))
    return header.with_names(S.plots(spark, sf_dir), names).select("seq", "sac_short", "sic_long")


@query
def sensor_names_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as names of sensors, more than there are; sensors without one keep nulls."""
    k = F.col("n_nationkey")
    n = S.table(spark, sf_dir, "nation")
    names = n.select((k % 2 + 1).cast("int").alias("sac"), (F.floor(k / 2) + 1).cast("int").alias("sic"), F.upper(F.substring("n_name", 1, 2)).alias("sac_short"), F.col("n_name").alias("sac_long"), F.substring("n_name", 1, 3).alias("sic_short"), F.col("n_name").alias("sic_long"))
    return header.with_names(S.plots(spark, sf_dir), names).select("seq", "sac_short", "sac_long", "sic_short", "sic_long")


@query
def header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = S.blocks(spark, sf_dir, 48).unionByName(S.blocks(spark, sf_dir, 2)).drop("cat")
    return header.with_header(both).select("seq", "cat", "len", "sac", "sic")


@query
def split_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = S.blocks(spark, sf_dir, 34), S.blocks(spark, sf_dir, 48).select("seq", F.col("payload").alias("other"))
    packets = one.join(two, "seq").select("seq", F.concat("payload", "other", "payload").alias("payload"))
    return header.with_header(header.split_packets(packets)).select("seq", "block_index", "cat", "len")


def decoded(cat: int, *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode.decode(S.blocks(spark, sf_dir, cat)).select("seq", "rec_index", *columns)

    run.__name__ = f"decode_cat{cat:02d}"
    return run


PLACE = ("sac", "sic", "tod", "type", "type_name")
for _cat, _columns in {
    1: ("sac", "sic", "type", "rho", "theta", "modea", "modea_v", "modea_g", "modea_l", "modec", "responses", "flag_fixed", "tod_trunc"),
    2: PLACE, 8: PLACE, 19: PLACE, 34: PLACE,
    10: ("sac", "sic", "type", "channel", "plot_type", "rho", "theta", "track_number", "tod"),
    20: ("sac", "sic", "type", "x", "y", "tod"),
    21: ("sac", "sic", "flag_ground", "flag_sim", "flag_test", "flag_fixed", "tod"),
    48: ("sac", "sic", "type", "rho", "theta", "modea", "modea_v", "modec", "modes", "aid", "com", "stat", "si", "b1b", "track_number", "tod"),
}.items():
    query(decoded(_cat, *_columns))


@query
def statistics_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.statistics_admission(decode.decode(S.blocks(spark, sf_dir, 10))).select("seq", "type", "plot_type")


@query
def decode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [S.blocks(spark, sf_dir, c) for c in (1, 48)]
    odd = S.blocks(spark, sf_dir, 34).withColumn("cat", F.lit(62))
    cut = S.blocks(spark, sf_dir, 2).withColumn("payload", F.expr("CASE WHEN seq % 3 = 0 THEN substring(payload, 1, 8) ELSE payload END"))
    return decode.record_counts(parts[0].unionByName(parts[1]).unionByName(odd).unionByName(cut))


@query
def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode.decode(S.blocks(spark, sf_dir, 48))
    return out.select("seq", "rec_index", F.hex(F.try_element_at("bds", F.lit("10"))).alias("bds10"))


@query
def decode_acas_ra(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = acas.resolution_advisories(decode.decode(S.blocks(spark, sf_dir, 48)))
    return out.select("seq", "rec_index", *(f"bds30_{k}" for k in ("ara41", "ara47", "rac55", "rac56", "rac57", "rac58", "rat", "mte", "tti", "tid", "tida", "tidr", "tidb")))


@query
def ras_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = decode.decode(S.blocks(spark, sf_dir, 48)).withColumn("tod", F.floor(F.col("tod") / 60) * 60.0)
    found = acas.resolution_advisories(plots).select("sac", "sic", "tod", "seq", "rec_index", "modes", "bds30_tti")
    return acas.upsert_advisories(found, ("seq", "rec_index")).select("sac", "sic", "tod", "modes", "bds30_tti")


@query
def latest_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = decode.decode(S.blocks(spark, sf_dir, 48)).filter("rec_index = 0").withColumn("modes", F.substring("modes", 5, 2))
    return acas.latest_capabilities(plots).select("modes", "com", "si", "b1b", F.hex("bds10").alias("bds10"))


@query
def latest_capabilities_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest_capabilities over all records and whole addresses."""
    plots = decode.decode(S.blocks(spark, sf_dir, 48))
    return acas.latest_capabilities(plots, ("seq", "rec_index")).select("modes", "com", "si", "b1b", F.hex("bds10").alias("bds10"))


@query
def latest_capabilities_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest_capabilities over all records, with addresses that come again: their last three digits."""
    plots = decode.decode(S.blocks(spark, sf_dir, 48)).withColumn("modes", F.substring("modes", 4, 3))
    return acas.latest_capabilities(plots, ("seq", "rec_index")).select("modes", "com", "si", "b1b", F.hex("bds10").alias("bds10"))


def truncated(spark: SparkSession, sf_dir: str, table: S.Table = S.table, start: int = 0) -> DataFrame:
    """North marks with full times and plots with truncated ones up to 80/128 s before; start: of the first event, in 1/128 s."""
    e = table(spark, sf_dir, "events")
    full = (F.col("event_id") * 37 + start) % S.DAY128
    before = full - F.col("event_id") % 5 * 20
    before = F.pmod(before, F.lit(S.DAY128)) if start else before
    plot = F.col("event_type") != "view"
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 3 + 1).cast("int").alias("sac"), F.lit(1).alias("sic"), F.when(plot, 1).otherwise(2).alias("cat"),
        F.when(~plot, full / 128.0).alias("tod"), F.when(plot, F.pmod(before, F.lit(65536)) / 128.0).alias("tod_trunc"),
    )


@query
def truncated_time_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.full_times(truncated(spark, sf_dir), wide=True).select("seq", "cat", "tod_full")


@query
def truncated_time_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truncated_time_asof around midnight: plots of the day before come after marks of the new one."""
    return timing.full_times(truncated(spark, sf_dir, start=S.DAY128 - 18_500), wide=True).select("seq", "cat", "tod_full")


def repeated(spark: SparkSession, sf_dir: str, table: S.Table = S.table) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 0.125).alias("ts"), F.concat_ws("/", F.col("user_id") % 11, "event_type").cast("binary").alias("payload"))


@query
def dedup_4s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_duplicates(repeated(spark, sf_dir)).select("seq", "ts")


@query
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark, sf_dir).select("seq", F.lower(F.md5("payload")).alias("md5"), F.length("payload").alias("n"))


@query
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark, sf_dir).select("seq", codes.block_key(F.col("payload")).alias("key"))


@query
def gps_v1_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir, 34).withColumn("recv_tod", F.col("seq") * 331 % S.DAY128 / 128.0).withColumn("src_ip", F.format_string("10.181.%d.17", F.col("seq") % 256))
    return writer.framed(b, "gps1").select("seq", F.hex("frame").alias("frame"))


@query
def gps_v2_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir, 34).withColumn("recv_tod", F.col("seq") * 331 % 86400 / 1.0)
    return writer.framed(b, "gps2").select("seq", F.hex("frame").alias("frame"))


@query
def era_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir, 34).withColumn("recv_tod", F.col("seq") * 331 % 86400 / 1.0)
    return writer.framed(b, "era", midnight=1_704_067_200).select("seq", F.hex("frame").alias("frame"))


@query
def synthetic_mode_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    rows = e.select(F.lit("events").alias("source"), F.col("event_id").alias("seq"), F.col("user_id").cast("int").alias("track_number"), (F.col("event_id") * 0.25).alias("tod"))
    return transcode.synthetic_codes(rows).select("seq", "modea")


@query
def transcode_cat10_cat48(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode.decode(transcode.cat10_to_cat48(S.blocks(spark, sf_dir, 10)))
    return out.select("seq", "cat", "sac", "sic", "rho", "theta", "modec", "track_number", "tod")


def reply_records(spark: SparkSession, sf_dir: str, table: S.Table = S.table) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    tail = F.concat(S.b(n % 7 * 400 + F.floor(n / 50) % 5 * 60 + n % 2, 2), S.b(F.floor(n % 1000 / 4) * 6, 2), S.b(F.when(n % 2 == 0, 0x0B00).otherwise(0x0D00), 2), S.b(F.when(n % 13 == 0, 0).otherwise(8), 2))
    return e.select(F.concat(F.lit("lap"), F.floor(n / 1000).cast("string")).alias("source"), n.alias("seq"), F.concat(F.lit(bytearray(64)), tail).alias("payload"))


@query
def reply_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.true_replies(replies.project(reply_records(spark, sf_dir)))
    return rounded(out.select("seq", "dist", "azimuth", "mode"), "dist", "azimuth")


@query
def reply_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.plot_sizes(replies.cluster(replies.project(reply_records(spark, sf_dir))))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    none: Column = F.lit(None)
    p = S.plots(spark, sf_dir).filter(F.col("cat").isin(1, 48, 34))
    return p.withColumns({
        "type": F.lit(1), "type_name": codes.type_name(F.col("cat"), F.lit(1)), "flag_fixed": F.lit(False), "x": none.cast("double"), "y": none.cast("double"), "modea_v": F.col("seq") % 3 == 0, "modea_g": F.col("seq") % 5 == 0,
        "modea_l": F.lit(False), "modec": (F.col("seq") % 400 * 100).cast("int"), "modec_v": F.lit(False), "modec_g": F.col("seq") % 7 == 0, "modes": none.cast("string"), "aid": none.cast("string"),
        "responses": (F.col("seq") % 12).cast("int"), "tod_trunc": none.cast("double"),
    })


@query
def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.format_lines(lines(spark, sf_dir)).select("seq", "line")


def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each event's block, in the event's own category, with the reception time and marks of its plot."""
    marks = S.plots(spark, sf_dir).select("seq", "cat", "tod_stamp", (F.col("seq") % 50 == 0).alias("_test"), (F.col("seq") % 11 == 0).alias("modec_v"), (F.col("seq") % 7 == 0).alias("modec_g"))
    records = None
    for cat in S.CATS.values():
        some = S.blocks(spark, sf_dir, cat).join(marks.filter(F.col("cat") == cat).drop("cat"), "seq")
        records = some if records is None else records.unionByName(some)
    told = decode.decode(records.withColumnsRenamed({"modec_v": "_v", "modec_g": "_g"}))
    return told.withColumns({"flag_test": F.col("_test"), "modec_v": F.col("_v"), "modec_g": F.col("_g")})


@query
def format_lines_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_lines over decoded records of all categories in events, all printed fields with values."""
    return output.format_lines(decoded_lines(spark, sf_dir)).select("seq", "rec_index", "line")


@query
def category_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's block in one of eight categories, decoded and printed in that category's form."""
    n, parts = F.col("seq"), None
    for k, cat in enumerate((1, 2, 10, 19, 20, 21, 34, 48)):
        some = S.blocks(spark, sf_dir, cat).filter(F.floor(n / 7) % 8 == k)
        parts = some if parts is None else parts.unionByName(some)
    told = decode.decode(parts.withColumn("tod_stamp", (n * 331 + n % 50) % S.DAY128 / 128.0))
    return output.category_lines(told).select("seq", "rec_index", "line")


@query
def availability_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = stats.delay_windows(delays(spark, sf_dir), period=86400)
    rows = stats.availability(rounded(windows, "max", "min", "media", "stdev", digits=3), "north")
    return output.availability_sql(rows).select("sac_sic_cat", "timestamp", "sql")


@query
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir, 34).select("seq", B.hex_dump(F.col("payload"), F.col("seq"), F.lit("a")).alias("dump"))


@query
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.plots(spark, sf_dir).groupBy(output.lap(F.col("us") / 1_000_000).alias("lap_start")).agg(F.count("*").alias("n"))
    return p.select("lap_start", "n", output.file_name(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, lap_start)"), "north").alias("name"))


@query
def availability_statements_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = stats.delay_windows(delays(spark, sf_dir), period=86400)
    rows = stats.availability(rounded(windows, "max", "min", "media", "stdev", digits=3), "north")
    return output.availability_sql(rows, insert_date=True).select("sac_sic_cat", "timestamp", "sql")


@query
def ras_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each advisory, of whole seconds; registers and polar coordinates left out."""
    plots = decode.decode(S.blocks(spark, sf_dir, 48)).withColumn("tod", F.floor("tod").cast("double"))
    found = acas.resolution_advisories(plots).drop("bds", "rho", "theta", "modec", "modec_v", "modec_g", "modea_g", "modea_l", "mssc", "arc", "aic", "b1a", *(f"bds30_ara4{k}" for k in range(2, 7)))
    return output.advisory_sql(found, 1_704_067_200).select("seq", "rec_index", "sql")


@query
def decode_recorded_without_cat21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are decoded without category 21 unless asked for."""
    both = S.blocks(spark, sf_dir, 21).unionByName(S.blocks(spark, sf_dir, 34))
    return decode.decode(both, cat21=False).select("seq", "cat", "sac", "sic")


@query
def read_reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply records written by lap; of each file, the first 170 as read."""
    folder = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    writer.write_recording(reply_records(spark, sf_dir).withColumn("source", F.concat("source", F.lit(".bin"))), folder, named=True)
    back = recording.read_replies(spark, folder, limit=170)
    return back.select(F.regexp_extract("source", "lap([0-9]+)[.]bin$", 1).cast("int").alias("lap"), "seq", F.hex(F.substring("payload", 65, 8)).alias("tail"))


@query
def gps_clock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a serial clock for each event, each fifth of another kind."""
    told = S.plots(spark, sf_dir).select("seq", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000)").alias("at"))
    lines = told.select("seq", F.concat(F.when(F.col("seq") % 5 == 0, "XGV").otherwise("XGU"), F.date_format("at", "yyMMddHHmmss"), F.lit(",A")).alias("line"))
    return lines.select("seq", F.date_format(recording.gps_clock(), "yyyy-MM-dd HH:mm:ss").alias("clock"))


@query
def volume_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram's statistics over the largest table: quantities as delays, by line status."""
    rows = S.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") / 8.0 - 3.0).alias("delay"))
    return stats.delay_statistics(rows, ("l_returnflag", "l_linestatus"))


def recorded(spark: SparkSession, sf_dir: str, cat: int, format: str, late: Column) -> str:
    """Blocks of a category written as recordings of 5000 blocks; their folder."""
    n = F.col("seq")
    stamp = (n * 331 + late) % S.DAY128 / 128.0
    blocks = S.blocks(spark, sf_dir, cat).withColumns({"source": F.format_string("part-%08d.rec", F.floor(n / 5000)), "recv_tod": F.floor(stamp) if format in ("gps2", "era") else stamp, "src_ip": F.lit("10.0.0.7")})
    folder = f"{shared_folder(spark)}/recording-{uuid.uuid4().hex}"
    writer.write_recording(blocks, folder, format, midnight=1_704_067_200, named=True)
    return folder


def reading(format: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = recording.read_recording(spark, recorded(spark, sf_dir, 34, format, F.lit(5)), format)
        return back.select(F.regexp_extract("source", "([0-9]+)[.]rec$", 1).cast("int").alias("part"), "seq", "cat", "sac", "sic", "recv_tod", "src_ip", F.hex("payload").alias("payload"))

    run.__name__ = f"read_{format}"
    return run


for _format in ("ast", "gps1", "gps2", "era", "hensoldt"):
    query(reading(_format))


@query
def read_light_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of recorded blocks of two categories, from files cut into ranges of 16 KiB, which no block leaves."""
    folder = recorded(spark, sf_dir, 48, "gps1", F.lit(5))
    found = recording.read_recording(spark, folder, "gps1", categories=(48, 34), light=True, range_bytes=1 << 14)
    return found.select(F.regexp_extract("source", "([0-9]+)[.]rec$", 1).cast("int").alias("part"), "seq", "cat", "len", "sac", "sic", "recv_tod")


@query
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written, read, decoded and summed up."""
    folder = recorded(spark, sf_dir, 48, "gps1", F.col("seq") % 50)
    # each recording starts on the day of its first block
    number = F.regexp_extract("source", "([0-9]+)[.]rec$", 1).cast("long")
    day = F.floor((number * 5000 * 331 + number * 5000 % 50) / S.DAY128).cast("long")
    return pipelines.latency_report(spark, folder, 1_704_067_200 + day * 86400, "north")
