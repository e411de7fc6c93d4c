"""Raw transponder replies: 72-byte records, projected and grouped to plots."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits as B
from .slots import SLOT, beside, slot_of

#: Bytes of a record, units of distance and azimuth, and how near replies of a plot are.
RECORD = 72
NM_PER_COUNT = 50.0 / 1000.0 * 299.792458 / 1852.0 / 2.0
NEAR_AZIMUTH, NEAR_DISTANCE = 0.6, 0.04
MODE_C, MODE_A = 0x0D00, 0x0B00
LEAST_REPLIES = 4


def project(records: DataFrame) -> DataFrame:
    """Adds dist (NM), azimuth (degrees), flag_pos, flag_ant, mode ('A', 'C' or null) and is_true to rows whose payload is a record."""
    p = F.col("payload")
    pos, ant = B.unsigned(p, 69, 2), B.unsigned(p, 71, 2)
    kind = pos.bitwiseAND(F.lit(0x0F00))
    return records.withColumns({
        "dist": B.unsigned(p, 65, 2) * F.lit(NM_PER_COUNT),
        "azimuth": B.unsigned(p, 67, 2).bitwiseAND(F.lit(0x1FFF)) * 360.0 / 16384.0,
        "flag_pos": pos.cast("int"), "flag_ant": ant.cast("int"),
        "mode": F.when(kind == MODE_C, "C").when(kind == MODE_A, "A"),
        "is_true": B.bit(ant, 0x0008),
    })


@dataclass
class Open:
    """An open cluster: its number, its last reply, its first one's place, and its replies."""

    number: int
    azimuth: float
    dist: float
    first: int
    n: int = 1


def join_open(open_: list[Open], azimuth: float, dist: float, is_true: bool, place: int, number: int) -> tuple[list[Open], list[Open], Open | None]:
    """(still open, closed, the reply's cluster) when a reply comes; a new cluster gets the number."""
    kept = [c for c in open_ if abs(c.azimuth - azimuth) <= 2 * NEAR_AZIMUTH]
    closed = [c for c in open_ if c not in kept] if len(kept) < len(open_) else []
    if not is_true:
        return kept, closed, None
    for c in kept:
        if abs(c.azimuth - azimuth) < NEAR_AZIMUTH and abs(c.dist - dist) < NEAR_DISTANCE:
            c.azimuth, c.dist, c.n = azimuth, dist, c.n + 1
            return kept, closed, c
    own = Open(number, azimuth, dist, place)
    return [*kept, own], closed, own


def cluster(replies: DataFrame, source: str = "source", order: str = "seq", limit: int | None = None, slot: int = SLOT) -> DataFrame:
    """(source, order, cluster) of the true replies of each source, in which order, a number, tells which came first.

    A reply joins the first open cluster whose last reply is near in azimuth and distance, else it opens
    one. A cluster closes when the current azimuth, of any reply, is twice that far from its last reply.
    A leap of azimuth by four times that closes all, so sources are cut there, at the antenna's turn at the latest, and each
    sweep is folded by itself; leaps are found by slots of order. limit: so many replies of each source only.
    """
    kept = replies if limit is None else replies.filter(F.col(order) < limit)
    told = kept.filter(F.col("dist").isNotNull() & F.col("azimuth").isNotNull()).select(source, order, "azimuth", "dist", "is_true").withColumn("_slot", slot_of(order, slot))
    inside = Window.partitionBy(source, "_slot").orderBy(order)
    ends = told.groupBy(source, "_slot").agg(F.max_by("azimuth", order).alias("_end"))
    over = Window.partitionBy(source).orderBy("_slot")
    told = beside(told, ends.select(source, "_slot", F.lag("_end").over(over).alias("_before")), (source, "_slot"))
    last = F.coalesce(F.lag("azimuth").over(inside), F.col("_before"))
    told = told.withColumn("_leap", F.coalesce(F.abs(F.col("azimuth") - last) > 4 * NEAR_AZIMUTH + 1e-6, F.lit(False)))
    leaps = told.groupBy(source, "_slot").agg(F.count_if("_leap").alias("_n"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    told = beside(told, leaps.select(source, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), (source, "_slot"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("_sweep", F.col("_base") + F.count_if("_leap").over(upto))

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        open_: list[Open] = []
        place, numbers, n = [], [], 0
        for i, row in enumerate(zip(*(rows[c].to_pylist() for c in ("azimuth", "dist", "is_true")))):
            open_, _, own = join_open(open_, *row, i, n)
            if own is not None:
                n += own.n == 1
                place.append(i)
                numbers.append(own.number)
        out = rows.select([source, order, "_sweep"]).take(pa.array(place, pa.int64()))
        return out.append_column("_number", pa.array(numbers, pa.int64()))

    kinds = {f.name: f for f in told.schema}
    sweeps = told.groupBy(source, "_sweep").applyInArrow(fold, T.StructType([kinds[source], kinds[order], kinds["_sweep"], T.StructField("_number", T.LongType())]))
    counts = sweeps.groupBy(source, "_sweep").agg((F.max("_number") + 1).alias("_n"))
    behind = Window.partitionBy(source).orderBy("_sweep").rowsBetween(Window.unboundedPreceding, -1)
    numbered = beside(sweeps, counts.select(source, "_sweep", F.coalesce(F.sum("_n").over(behind), F.lit(0)).alias("_base")), (source, "_sweep"))
    return numbered.select(source, order, (F.col("_base") + F.col("_number")).alias("cluster"))


def plot_sizes(clusters: DataFrame, source: str = "source") -> DataFrame:
    """Clusters of five replies or more with their followers: replies but the first."""
    return clusters.groupBy(source, "cluster").agg((F.count("*") - 1).alias("n_followers")).filter(F.col("n_followers") >= LEAST_REPLIES)
