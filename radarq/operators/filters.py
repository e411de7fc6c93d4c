"""Filters by category, sensor, time of day, position, delay and ground state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import clock
from ..functions.layouts import LAYOUTS
from .decode import records

#: Categories whose statistics are kept for good: fixed values.
PERSISTED = (1, 48, 10, 19, 20)
#: Own-status values of aircraft on the ground.
GROUND = (1, 3)
OWN_STATUS = LAYOUTS[48].number("230")


def category(rows: DataFrame, keep: int | None = None, drop: int | None = None) -> DataFrame:
    """Rows of one category, or of all others; rows without a category are in neither."""
    if keep is not None:
        rows = rows.filter(F.col("cat") == keep)
    return rows if drop is None else rows.filter(F.col("cat") != drop)


def category_signed(rows: DataFrame, c: int) -> DataFrame:
    """From 0 on: that category; below: all but -c."""
    return category(rows, keep=c) if c >= 0 else category(rows, drop=-c)


def _is(sac: int, sic: int) -> Column:
    return F.coalesce((F.col("sac") == sac) & (F.col("sic") == sic), F.lit(False))


def sensor(rows: DataFrame, sac: int, sic: int, drop: bool = False) -> DataFrame:
    """Rows of a sensor, or all others; rows that name no sensor are others."""
    return rows.filter(~_is(sac, sic) if drop else _is(sac, sic))


def sensor_signed(rows: DataFrame, *pairs: tuple[int, int]) -> DataFrame:
    """Rows of one of the pairs. A pair of negative numbers excludes instead, number by number.

    Rows that name no sensor go either way.
    """
    sac, sic = F.col("sac"), F.col("sic")
    if any(n < 0 for p in pairs for n in p):
        wanted = F.lit(False)
        for a, b in pairs:
            wanted = wanted | ((sac != -a) if a < 0 else F.lit(False)) | ((sic != -b) if b < 0 else F.lit(False))
    else:
        wanted = F.lit(False)
        for a, b in pairs:
            wanted = wanted | ((sac == a) & (sic == b))
    return rows.filter(sac.isNotNull() & sic.isNotNull() & wanted)


def time_of_day(rows: DataFrame, start: str, end: str, column: str = "recv_tod", compat: bool = False, order: tuple[str, ...] = ("source", "seq")) -> DataFrame:
    """Rows received from start to end, both HH:MM and whole minutes included; an end before the start goes over midnight.

    compat: each source is read in order, up to its first row beyond the end, rows near midnight before
    the first other one don't count, the end is :59 sharp, and an end before the start gives nothing.
    """
    seconds = lambda t: int(t[:2]) * 3600 + int(t[3:5]) * 60
    a, b, t = seconds(start), seconds(end) + 60, F.col(column)
    if not compat:
        return rows.filter(t.between(a, b) & (t < b) if a < b else (t >= a) | (t < b))
    if a >= b:
        return rows.filter(F.lit(False))
    before = Window.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("_begun", F.max(t <= 86000).over(before))
    told = told.withColumn("_over", F.max(F.col("_begun") & (t >= a) & (t > b - 1)).over(before))
    return told.filter(F.col("_begun") & ~F.col("_over") & (t >= a)).drop("_begun", "_over")


def polar_band(plots: DataFrame, azimuth: tuple[float, float], distance: tuple[float, float] | None = None) -> DataFrame:
    """Plots inside an azimuth band in degrees and a distance band, bounds included."""
    kept = plots.filter(F.col("theta").between(*azimuth))
    return kept if distance is None else kept.filter(F.col("rho").between(*distance))


def without_tests(plots: DataFrame) -> DataFrame:
    return plots.filter(~F.coalesce("flag_test", F.lit(False)))


def timed(plots: DataFrame) -> DataFrame:
    return plots.filter(F.col("tod").isNotNull())


def sane_delay(plots: DataFrame, most: float = clock.MOST_DELAY) -> DataFrame:
    """Plots whose delay is below the cap, either way."""
    return plots.filter(F.abs("delay") < most)


def persisted(rows: DataFrame, categories: tuple[int, ...] = PERSISTED) -> DataFrame:
    return rows.filter(F.col("cat").isin(list(categories)))


def true_replies(replies: DataFrame) -> DataFrame:
    return replies.filter(B.bit(F.col("flag_ant"), 0x0008))


def drop_ground(blocks: DataFrame, key: tuple[str, ...] = ("source", "seq")) -> DataFrame:
    """Category 48 blocks without the records of aircraft on the ground, framed anew; blocks left empty go.

    Blocks of other categories, and bytes behind a malformed record, stay as they are.
    key: columns that name a block.
    """
    others = blocks.filter((F.col("cat") != 48) | F.col("cat").isNull())
    p = F.col("payload")
    found = records(blocks.filter(F.col("cat") == 48), (48,))
    status = B.field(B.unsigned(p, F.get("at", F.lit(OWN_STATUS)) + 1, 2), 10, 7)
    kept = found.filter(F.col("malformed") | ~F.coalesce(status.isin(*GROUND), F.lit(False)))
    end = F.when(F.col("malformed"), F.length(p)).otherwise(F.col("behind"))
    part = F.struct("rec_index", F.substring(p, F.col("first") + 1, end - F.col("first")).alias("part"))
    carried = [c for c in blocks.columns if c not in (*key, "payload")]
    rows = kept.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("_parts"), *(F.first(c).alias(c) for c in carried))
    rows = rows.withColumn("_body", F.aggregate("_parts", F.lit(b""), lambda body, x: F.concat(body, x["part"])))
    rows = rows.withColumn("payload", F.concat(B.be(F.lit(48), 1), B.be(F.length("_body") + 3, 2), F.col("_body")))
    if "len" in carried:
        rows = rows.withColumn("len", F.length("payload"))
    return others.select(*blocks.columns).unionByName(rows.select(*blocks.columns))
