"""Structured Streaming twins: latency windows, duplicate suppression and truncated times on live rows.

Rows carry event_time, a TIMESTAMP of reception.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import codes
from ..operators import stats
from ..operators.replies import LEAST_REPLIES, Open, join_open
from ..operators.timing import completed
from ..sources.hadoop import Store

#: Longer than the largest delay that counts.
LATE = "10 seconds"


def delay_windows(plots: DataFrame, late: str = LATE, period: int = stats.PERIOD) -> DataFrame:
    """Histograms of delays by sensor, category and window, as windows close; finish() makes them statistics.

    Works on a stream and on a table alike. A window is out when the watermark has passed its end, so
    the last, unfinished one is not reported.
    """
    d = F.col("delay")
    told = plots.withWatermark("event_time", late).filter(F.abs(d) < -stats.LOW)
    keys = (F.window("event_time", f"{period} seconds").alias("w"), *stats.SENSOR, stats.bin_of(d).alias("bin"))
    out = told.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.sum(d * d).alias("squares"), F.max(d).alias("highest"), F.min(d).alias("lowest"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), *stats.SENSOR, "bin", "n", "total", "squares", "highest", "lowest")


def simple_windows(plots: DataFrame, late: str = LATE, period: int = stats.PERIOD) -> DataFrame:
    """(window_start, sac, sic, cat, cuenta, max, min, media, stdev) as windows close: what needs no histogram."""
    d = F.col("delay")
    told = plots.withWatermark("event_time", late).filter(F.abs(d) < -stats.LOW)
    out = told.groupBy(F.window("event_time", f"{period} seconds").alias("w"), *stats.SENSOR).agg(
        F.count("*").alias("cuenta"), F.max(d).alias("max"), F.min(d).alias("min"), F.avg(d).alias("media"), F.stddev_pop(d).alias("stdev")
    )
    return out.select(F.unix_timestamp("w.start").alias("window_start"), *stats.SENSOR, "cuenta", "max", "min", "media", "stdev")


def finish(bins: DataFrame) -> DataFrame:
    """Statistics of closed windows' bins, a batch at a time: for foreachBatch, or the table that a stream has written."""
    return stats.statistics_of(bins, stats.WINDOW)


def drop_duplicates(blocks: DataFrame, horizon_ms: int = 4000, late: str = LATE) -> DataFrame:
    """The first of identical blocks, as they come; the horizon counts from the first and isn't prolonged."""
    told = blocks.withColumn("_key", codes.block_key(F.col("payload"))).withWatermark("event_time", late)
    names = blocks.columns

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_time", kind="stable")
        kept, times = [], rows["event_time"].astype("datetime64[us]").astype("int64") / 1000.0
        for i, t in enumerate(times):
            if last is None or t - last > horizon_ms:
                last = t
                kept.append(i)
        state.update((float(last),))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(int(max(last + horizon_ms + 1, mark + 1)))
        yield rows.iloc[kept][names]

    return told.groupBy("_key").applyInPandasWithState(keep, blocks.schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def drop_duplicates_roughly(blocks: DataFrame, horizon: str = "4 seconds") -> DataFrame:
    """As drop_duplicates() with Spark's own operator, on whose horizon the watermark decides."""
    told = blocks.withColumn("_key", codes.block_key(F.col("payload"))).withWatermark("event_time", horizon)
    return told.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def full_times(plots: DataFrame, wide: bool = False) -> DataFrame:
    """Adds tod_full, as the batch operator of this name; rows of a sensor come in order of seq within a batch.

    A sensor's state is two numbers: its last full time and the last truncated one.
    """
    from pyspark.sql import types as T

    def solve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, p = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        out: list[float | None] = []
        for cat, tod, short in zip(rows["cat"], rows["tod"], rows["tod_trunc"]):
            full = None if pd.isna(tod) else float(tod)
            if cat in (2, 19) and full is not None:
                high, p = divmod(round(full * 128), 65536)
            elif cat == 1 and not pd.isna(short):
                full = None
                if high >= 0:
                    full, p = completed(high, p, round(short * 128), wide)
            out.append(full)
        if high >= 0:
            state.update((int(high), int(p)))
        yield rows.assign(tod_full=pd.array(out, "Float64"))

    shape = T.StructType([*plots.schema, T.StructField("tod_full", T.DoubleType())])
    return plots.groupBy("sac", "sic").applyInPandasWithState(solve, shape, "high long, p long", "append", GroupStateTimeout.NoTimeout)


#: A closed cluster of replies.
PLOT = "source string, cluster long, first_seq long, n_followers long"


def plots(replies: DataFrame, idle: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Rows of PLOT for clusters of five replies or more, as they close: the streaming twin of replies.cluster() and plot_sizes().

    Replies of a source (source, seq, azimuth, dist, is_true, event_time) come in order of seq, batch by batch. A row without azimuth ends its
    source: all its clusters close. So they do when nothing has come for `idle` of event time. Open
    clusters are a list in the state, which azimuth keeps short. Needs the RocksDB state store.
    """
    pause = int(replies.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {idle})").first()[0])
    told = replies.select("source", "seq", "azimuth", "dist", "is_true", "event_time").withWatermark("event_time", late)
    return told.groupBy("source").transformWithStateInPandas(_Plots(pause), PLOT, "append", "eventTime")


class _Plots(StatefulProcessor):
    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "number long, azimuth double, dist double, first long, n long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        open_ = [Open(*row) for row in self.open.get()] if self.open.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        rows = sorted((row for f in frames for row in zip(*(f[c].tolist() for c in ("seq", "azimuth", "dist", "is_true", "event_time")))), key=lambda r: r[0])
        gone: list[Open] = []
        for seq, azimuth, dist, is_true, _ in rows:
            if azimuth is None or azimuth != azimuth:
                gone += open_
                open_ = []
                continue
            open_, closed, own = join_open(open_, azimuth, dist, bool(is_true), seq, n)
            gone += closed
            n += own is not None and own.n == 1
        self.count.update((n,))
        self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_:
            self.open.put([(c.number, c.azimuth, c.dist, c.first, c.n) for c in open_])
            last = int(max(r[4] for r in rows).timestamp() * 1000) + self.pause
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, gone)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [Open(*row) for row in self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield self._rows(key, gone)

    def _rows(self, key: tuple, gone: list[Open]) -> pd.DataFrame:
        large = [c for c in gone if c.n - 1 >= LEAST_REPLIES]
        return pd.DataFrame({"source": pd.Series([key[0]] * len(large), dtype=object), "cluster": pd.Series([c.number for c in large], dtype="int64"), "first_seq": pd.Series([c.first for c in large], dtype="int64"), "n_followers": pd.Series([c.n - 1 for c in large], dtype="int64")})

    def close(self) -> None:
        pass


class Counters(StreamingQueryListener):
    """Sums of the counters that streams observe under a name, while they run; nothing is read twice.

    `spark.streams.addListener(counters)`, and `stats.counters(...)` as `rows.observe(counters.name, *those)`.
    A batch that is run again after a failure is counted when it has succeeded, once.
    """

    def __init__(self, name: str = "pipeline"):
        self.name, self.sums, self._seen, self._ended = name, {}, set(), {}
        self._lock = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        with self._lock:
            if row is not None and (progress.id, progress.batchId) not in self._seen:
                self._seen.add((progress.id, progress.batchId))
                for k, v in row.asDict().items():
                    self.sums[k] = self.sums.get(k, 0) + v

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended[event.runId] = True
            self._lock.notify_all()

    def wait(self, run_id, seconds: float = 60.0) -> dict[str, int]:
        """The sums, when all that a run has told has come."""
        with self._lock:
            if not self._lock.wait_for(lambda: any(str(r) == str(run_id) for r in self._ended), seconds):
                raise TimeoutError(f"no end of {run_id} told in {seconds} s")
            return dict(self.sums)


#: A sensor's histogram as it is told.
BINS = "sac int, sic int, cat int, told_ms long, bin int, n long, total double, squares double, highest double, lowest double"


def histograms(plots: DataFrame, period: int = stats.PERIOD) -> DataFrame:
    """Rows of BINS by sensor, every `period` seconds of the clock on the wall, as a console of live statistics shows them: finish() them by (sensor, told_ms).

    plots: sac, sic, cat, delay and end. A sensor's period begins with its first plot. A row whose `end` is true tells its
    sensor's bins at once, as the end of a stream does. The state is a map of at most 3200 bins a sensor. Needs the RocksDB state store.
    """
    told = plots.select(*stats.SENSOR, "delay", F.coalesce("end", F.lit(False)).alias("end")).withColumn("bin", stats.bin_of(F.col("delay")))
    told = told.filter((F.abs("delay") < -stats.LOW) | F.col("end"))
    return told.groupBy(*stats.SENSOR).transformWithStateInPandas(_Histogram(period), BINS, "append", "processingTime")


class _Histogram(StatefulProcessor):
    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "bin int", "n long, total double, squares double, highest double, lowest double")

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        end = False
        for f in frames:
            end |= bool(f["end"].any())
            d = f[~f["end"]]
            sums = d.assign(squares=d["delay"] ** 2).groupby("bin").agg(n=("delay", "size"), total=("delay", "sum"), squares=("squares", "sum"), highest=("delay", "max"), lowest=("delay", "min"))
            for bin_, n, total, squares, highest, lowest in sums.itertuples():
                k = (int(bin_),)
                old = self.bins.getValue(k) if self.bins.containsKey(k) else (0, 0.0, 0.0, highest, lowest)
                self.bins.updateValue(k, (old[0] + int(n), old[1] + float(total), old[2] + float(squares), max(old[3], float(highest)), min(old[4], float(lowest))))
        timers = list(self.handle.listTimers())
        if end:
            for t in timers:
                self.handle.deleteTimer(t)
            yield self._told(key, timerValues.getCurrentProcessingTimeInMs())
        elif not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.period * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, expiredTimerInfo.getExpiryTimeInMs())

    def _told(self, key: tuple, at: int) -> pd.DataFrame:
        rows = [(*(int(k) for k in key), int(at), int(b[0]), *v) for b, v in self.bins.iterator()]
        self.bins.clear()
        names = [c.split()[0] for c in BINS.split(", ")]
        kinds = {"int": "int32", "long": "int64", "double": "float64"}
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kinds[k]) for i, (c, k) in enumerate(zip(names, (x.split()[1] for x in BINS.split(", "))))})

    def close(self) -> None:
        pass


class LateRows:
    """Latency windows of a stream that lose no late row: those behind the watermark go to a table of their own, and correct their windows.

    Below folder: `bins/batch=<n>`, sums of the rows in time, `late/batch=<n>`, the late rows, and `marks/<n>`, the watermark behind
    batch n, which is written last. A batch that is run again writes the same.
    """

    def __init__(self, spark: SparkSession, folder: str, late_seconds: float = 10.0, period: int = stats.PERIOD):
        self.spark, self.store, self.late, self.period = spark, Store(spark, folder), late_seconds, period

    def mark(self, batch: int | None = None) -> float | None:
        """The watermark behind a batch, or behind the last, in seconds; None if there has been none."""
        done = [int(n) for n in self.store.names("marks") if n.isdigit() and (batch is None or int(n) <= batch)]
        return float(self.store.read(f"marks/{max(done):012d}")) if done else None

    def take(self, plots: DataFrame, batch: int) -> None:
        """For foreachBatch: plots with sac, sic, cat, ts and delay."""
        before = self.mark(batch - 1)
        told = stats.with_window(plots, self.period)
        late = F.lit(False) if before is None else F.col("ts") < before
        folder = self.store.folder
        stats.histogram(told.filter(~late), stats.WINDOW).write.mode("overwrite").parquet(f"{folder}/bins/batch={batch}")
        told.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        newest = plots.agg(F.max("ts")).first()[0]
        mark = max(x for x in (before, None if newest is None else newest - self.late, float("-inf")) if x is not None)
        self.store.write_once(f"marks/{batch:012d}", repr(mark))

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.folder}/{name}")

    def windows(self, corrected: bool = True) -> DataFrame:
        """Statistics of the windows that the watermark has passed, with n_late, the late rows that they have got; or without those, as they were first told."""
        bins = self.rows("bins").drop("batch").withColumn("n_late", F.lit(0).cast("long"))
        if corrected:
            late = stats.histogram(self.rows("late"), stats.WINDOW)
            bins = bins.unionByName(late.withColumn("n_late", F.col("n")))
        mark = self.mark()
        bins = bins.filter(F.col("window_start") + self.period <= (float("-inf") if mark is None else mark))
        counts = bins.groupBy(*stats.WINDOW).agg(F.sum("n_late").alias("n_late"))
        sums = bins.groupBy(*stats.WINDOW, "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))
        return stats.statistics_of(sums).join(counts, list(stats.WINDOW))
