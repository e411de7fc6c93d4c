"""Latency statistics by sensor, category and window; counters and bandwidth.

Plots are rows with sac, sic, cat, delay and, for windows, ts (absolute seconds of reception).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, codes

# The window in seconds, and the histogram's bin and range.
PERIOD = 300
BIN, LOW, BINS = 0.005, -8.0, 3200
#: The interpolated mode is reported as 0 beyond this.
MODE_RANGE = 7.994, 7.996
SENSOR = ("sac", "sic", "cat")
WINDOW = (*SENSOR, "window_start")
#: Steps and windows kept of each consolidation of the archive: fixed values.
ARCHIVE = ((1, 600), (6, 700), (24, 775), (288, 797))


def with_window(plots: DataFrame, period: int = PERIOD) -> DataFrame:
    """Adds window_start: the multiple of the period that ts, in seconds, lies in."""
    return plots.withColumn("window_start", clock.floor_to(F.floor("ts").cast("long"), period))


def bin_of(delay: Column) -> Column:
    """Number of the 5 ms bin of a delay."""
    return F.floor((delay - LOW) * 10000 / 50).cast("int")


def edge_of(bin: Column) -> Column:
    return bin * BIN + LOW


def histogram(plots: DataFrame, keys: tuple[str, ...] = SENSOR) -> DataFrame:
    """(keys, bin, n, and what the other statistics sum up) of delays below the cap; no row for an empty bin."""
    d = F.col("delay")
    return (
        plots.filter(F.abs(d) < -LOW)
        .groupBy(*keys, bin_of(d).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.sum(d * d).alias("squares"), F.max(d).alias("highest"), F.min(d).alias("lowest"))
    )


def delay_statistics(plots: DataFrame, keys: tuple[str, ...] = WINDOW, compat: bool = False) -> DataFrame:
    """(keys, cuenta, max, min, media, stdev, mode, p99) of delays.

    Rows are summed to bins before they meet their group, so a busy sensor costs a row a bin. stdev is
    that of the population. p99: lower edge of the first bin at which 99 in 100 delays are counted.
    mode: the fullest bin (of equal ones, the first), set in from its lower edge by its neighbours.
    compat: p99 is 0 where the first bin has it, and must exceed the 99 for categories other than 1.
    """
    return statistics_of(histogram(plots, keys), keys, compat)


def statistics_of(bins: DataFrame, keys: tuple[str, ...] = WINDOW, compat: bool = False) -> DataFrame:
    """delay_statistics() from histograms."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    so_far, all_ = by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    near = lambda step: F.coalesce(F.when((F.lead("bin", step) if step > 0 else F.lag("bin", -step)).over(by_bin) == F.col("bin") + step, (F.lead("n", step) if step > 0 else F.lag("n", -step)).over(by_bin)), F.lit(0))
    bins = bins.withColumns({"_seen": F.sum("n").over(so_far), "_all": F.sum("n").over(all_), "_under": near(-1), "_over": near(1), "_first": F.min("bin").over(all_)})
    enough = F.col("_seen") >= F.col("_all") * F.lit(0.99)
    if compat:
        enough = F.when(F.col("cat") == 1, enough).otherwise(F.col("_seen") > F.col("_all") * F.lit(0.99))
    n = F.sum("n")
    mean = F.sum("total") / n
    top = F.max_by(F.struct("bin", "n", "_under", "_over"), F.struct("n", -F.col("bin")))
    out = bins.groupBy(*keys).agg(
        n.alias("cuenta"), F.max("highest").alias("max"), F.min("lowest").alias("min"), mean.alias("media"),
        F.sqrt(F.greatest(F.sum("squares") / n - mean * mean, F.lit(0.0))).alias("stdev"),
        F.min(F.when(enough, F.col("bin"))).alias("_p99"), F.min("_first").alias("_first"), top.alias("_top"),
    )
    t = F.col("_top")
    left, right = t.n - t._under, t.n - t._over
    mode = edge_of(t.bin) + F.coalesce(left / F.nullif(left + right, F.lit(0)), F.lit(0.0)) * BIN
    mode = F.when(mode.between(-MODE_RANGE[0], MODE_RANGE[1]), mode).otherwise(0.0)
    p99 = edge_of(F.col("_p99"))
    if compat:
        p99 = F.when(F.col("_p99") == F.col("_first"), 0.0).otherwise(F.coalesce(p99, F.lit(0.0)))
    return out.select(*keys, "cuenta", "max", "min", "media", "stdev", mode.alias("mode"), p99.alias("p99"))


def delay_windows(plots: DataFrame, region: str | None = None, include_last: bool = True, period: int = PERIOD, compat: bool = False, received: DataFrame | None = None) -> DataFrame:
    """delay_statistics() by sensor, category and window. Without include_last, only windows that end by the last reception.

    received: rows with ts that tell the last reception, where they cost less than plots.
    """
    told = with_window(plots, period)
    if not include_last:
        last = (plots if received is None else received).agg(F.max("ts").alias("_last"))
        told = told.crossJoin(F.broadcast(last)).filter(F.col("window_start") + period <= F.col("_last")).drop("_last")  # of one row
    out = delay_statistics(told, compat=compat)
    return out if region is None else out.withColumn("region", F.lit(region))


def availability(windows: DataFrame, region: str = "") -> DataFrame:
    """Windows as rows of the availability table."""
    return windows.select(
        codes.sensor_key(F.col("sac"), F.col("sic"), F.col("cat")).alias("sac_sic_cat"), F.lit(region).alias("region"), F.col("window_start").alias("timestamp"), "cuenta", "max", "min", "media", "stdev", "p99"
    )


def rollup(windows: DataFrame, steps: int, keys: tuple[str, ...] = SENSOR, period: int = PERIOD, values: tuple[str, ...] = ("media",), least: float = 0.5) -> DataFrame:
    """Consolidations of `steps` windows: average, largest and smallest of each value, unknown where under half of the windows are there."""
    slot = clock.floor_to(F.col("window_start"), steps * period).alias("slot_start")
    out = windows.groupBy(*keys, slot).agg(F.count("*").alias("n_windows"), *(f(v).alias(f"{name}_{v}") for v in values for name, f in (("avg", F.avg), ("max", F.max), ("min", F.min))))
    known = F.col("n_windows") >= steps * least
    return out.withColumns({f"{name}_{v}": F.when(known, F.col(f"{name}_{v}")) for v in values for name in ("avg", "max", "min")})


def archive(windows: DataFrame, keys: tuple[str, ...] = SENSOR, period: int = PERIOD) -> DataFrame:
    """All consolidations with `steps`, each reaching back from the last window only so many slots as the archive keeps."""
    last = windows.agg(F.max("window_start").alias("_last"))
    parts = []
    for steps, kept in ARCHIVE:
        out = rollup(windows, steps, keys, period).crossJoin(F.broadcast(last))  # of one row
        parts.append(out.filter(F.col("slot_start") > F.col("_last") - steps * period * kept).drop("_last").withColumn("steps", F.lit(steps)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def flow_bandwidth(packets: DataFrame, period: int = 60, flow: str = "flow", size: str = "n_bytes") -> DataFrame:
    """(window_start, flow, packets, bytes, bytes_per_s), and for each window a row of the total, whose flow is null."""
    told = with_window(packets, period)
    out = told.groupBy("window_start", flow).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"))
    # the total adds up the flows' rows, not the packets again
    total = out.groupBy("window_start").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    both = out.unionByName(total.withColumn(flow, F.lit(None).cast(out.schema[flow].dataType)))
    return both.withColumn("bytes_per_s", F.col("bytes") / F.lit(float(period)))


def counters(admitted: Column, known: Column, kept: Column, first: Column, size: Column) -> list[Column]:
    """Aggregates of packets: received, processed, ignored, filtered, unique and duped ones, bytes read and written; each packet counts once in the first that holds."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    a, k, f, u = ok(admitted), ok(known), ok(kept), ok(first)
    written = F.coalesce(F.sum(F.when(a & k & f & u, size)), F.lit(0))
    return [
        F.count("*").alias("received"), F.count_if(a & k).alias("processed"), F.count_if(~a | ~k).alias("ignored"), F.count_if(a & k & ~f).alias("filtered"),
        F.count_if(a & k & f & u).alias("unique"), F.count_if(a & k & f & ~u).alias("duped"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_read"), written.alias("bytes_written"),
    ]


def pipeline_counters(packets: DataFrame, admitted: Column, known: Column, kept: Column, first: Column, size: Column) -> DataFrame:
    """One row of counters()."""
    return packets.agg(*counters(admitted, known, kept, first, size))
