"""The round-robin archive of latency windows, kept up to date by increments.

What is stored are partial sums of each consolidation's slots. New windows are added to the slots they lie in; each
consolidation's buckets are a ring over time, so an increment reads and rewrites the buckets of its own
time and of nothing older, and slots that the ring has come round to are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..operators import stats
from .stored import StoredTable

RING = 16  # buckets of each consolidation
FIELDS = "steps int, sac int, sic int, cat int, slot_start long, n_windows long, total double, highest double, lowest double"


class Archive:
    """Consolidations of `media`, as stats.archive() makes them of all windows at once."""

    def __init__(self, spark: SparkSession, folder: str, period: int = stats.PERIOD):
        self.period = period
        schema = T.StructType([T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}[k]) for n, k in (f.split() for f in FIELDS.split(", "))])
        # a bucket spans so much that all that is kept lies in a ring less one bucket
        part = None
        for i, (steps, kept) in enumerate(stats.ARCHIVE):
            span = -(-kept // (RING - 2)) * steps * period
            here = i * RING + F.pmod(F.floor(F.col("slot_start") / span), F.lit(RING))
            part = F.when(F.col("steps") == steps, here) if part is None else part.when(F.col("steps") == steps, here)
        self.table = StoredTable(spark, folder, schema, ("steps", *stats.SENSOR, "slot_start"), RING * len(stats.ARCHIVE), part)

    def add(self, windows: DataFrame, batch: int) -> bool:
        """Take windows that have not been added before; False if the batch has been taken. Windows older than the archive reaches go."""
        if self.table.taken(batch):
            return False
        slots = F.array(*(F.struct(F.lit(steps).alias("steps"), clock.floor_to(F.col("window_start"), steps * self.period).alias("slot_start")) for steps, _ in stats.ARCHIVE))
        each = windows.select(*stats.SENSOR, "media", "window_start", F.explode(slots).alias("_slot")).groupBy("_slot.steps", *stats.SENSOR, "_slot.slot_start")
        sums = F.count("*").alias("n_windows"), F.sum("media").alias("total"), F.max("media").alias("highest"), F.min("media").alias("lowest")
        new = each.agg(*sums, F.max("window_start").alias("_newest")).persist()  # looked at for its last window and its buckets, then added
        try:
            newest = new.agg(F.max("_newest")).first()[0]
            return self.table.deliver(new.drop("_newest"), self._summed(newest), batch)
        finally:
            new.unpersist()

    def _summed(self, newest: int | None):
        """Old and new sums together, without slots that the archive no longer reaches."""

        def summed(old: DataFrame, new: DataFrame) -> DataFrame:
            out = old.unionByName(new).groupBy("steps", *stats.SENSOR, "slot_start")
            out = out.agg(F.sum("n_windows").alias("n_windows"), F.sum("total").alias("total"), F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))
            return out if newest is None else out.filter(self._kept(F.lit(newest)))

        return summed

    def _kept(self, last):
        """Slots that the archive reaches back to from its last window."""
        kept = None
        for steps, n in stats.ARCHIVE:
            here = F.col("slot_start") > last - steps * self.period * n
            kept = F.when(F.col("steps") == steps, here) if kept is None else kept.when(F.col("steps") == steps, here)
        return kept

    def read(self, least: float = 0.5) -> DataFrame:
        """(steps, sac, sic, cat, slot_start, n_windows, avg_media, max_media, min_media); unknown where under half of a slot's windows are there."""
        rows = self.table.read()
        last = rows.filter("steps = 1").agg(F.max("slot_start").alias("_last"))  # slots of one step are windows
        known = F.col("n_windows") >= F.col("steps") * least
        out = rows.crossJoin(F.broadcast(last)).filter(self._kept(F.col("_last")))  # of one row
        values = {"avg_media": F.col("total") / F.col("n_windows"), "max_media": F.col("highest"), "min_media": F.col("lowest")}
        return out.select("steps", *stats.SENSOR, "slot_start", "n_windows", *(F.when(known, v).alias(k) for k, v in values.items()))
