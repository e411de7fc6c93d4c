"""Category 10 (surface) blocks as category 48 plots and category 34 north markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.layouts import LAYOUTS
from .decode import records
from .slots import SLOT, beside, slot_of

#: Seconds after which a track gets a new code, and the level given to all.
IDLE = 15.0
LEVEL = 10 * 4


def synthetic_codes(rows: DataFrame, track: str = "track_number", time: str = "tod", source: str = "source", order: str = "seq", idle: float = IDLE, slot: int = SLOT) -> DataFrame:
    """Adds modea: a number for each track and stay, counting up in each source as they first appear.

    A stay ends with a pause of `idle` seconds or more. Rows without a track get null. order is a number; rows are dealt by
    slots of it. A track's last time before a slot, the stays begun in a source before it and a track's
    stay as it enters come from a row for each slot (and track), so no task holds a source or a track.
    """
    told = rows.withColumn("_slot", slot_of(order, slot))
    key = (source, track, "_slot")
    inside = Window.partitionBy(*key).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(source, track).orderBy("_slot")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col(time)
    told = told.withColumns({"_nth": F.row_number().over(inside), "_last": F.lag(t).over(inside)})
    ends = told.groupBy(*key).agg(F.max_by(F.struct(t.alias("t")), order).alias("_end"))
    ends = ends.select(*key, F.lag("_end.t").over(over).alias("_before"))
    told = beside(told, ends, key)
    since = F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_last"))
    told = told.withColumn("_new", F.col(track).isNotNull() & F.coalesce(~(t < since + idle), F.lit(True)))
    begun = told.groupBy(source, "_slot").agg(F.count_if("_new").alias("_n"))
    sums = Window.partitionBy(source).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(source, "_slot", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_base"))
    numbers = Window.partitionBy(source, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = beside(told, begun, (source, "_slot")).withColumn("_code", F.when(F.col("_new"), F.col("_base") + F.count_if("_new").over(numbers)))
    # codes count up, so a track's last one is its largest
    entering = told.groupBy(*key).agg(F.max("_code").alias("_code")).select(*key, F.max("_code").over(before).alias("_enter"))
    told = beside(told, entering, key)
    stay = F.coalesce(F.max("_code").over(upto), F.col("_enter"))
    told = told.withColumn("modea", F.when(F.col(track).isNotNull(), stay))
    return told.drop("_slot", "_nth", "_last", "_before", "_new", "_base", "_code", "_enter")


def cat10_to_cat48(blocks: DataFrame, order: tuple[str, ...] = ("source", "seq")) -> DataFrame:
    """Blocks of category 48 and 34 for the first record of each category 10 block that has a place, or starts a cycle.

    blocks: source, seq, cat, payload. Target reports need polar coordinates; metres become 1/256 NM,
    azimuth and time stay, track number, speed and status come along, and tracks get a synthetic code
    and a fixed level. Other blocks and messages are left out.
    """
    layout, p = LAYOUTS[10], F.col("payload")
    at = lambda item: F.get("at", F.lit(layout.number(item)))
    take = lambda item, n, skip=0: B.unsigned(p, at(item) + 1 + skip, n)
    raw = lambda item, n: F.substring(p, at(item) + 1, F.lit(n))
    found = records(blocks.filter(F.col("cat") == 10), (10,)).filter(~F.col("malformed") & (F.col("rec_index") == 0) & at("010").isNotNull() & at("000").isNotNull())
    kind = take("000", 1).bitwiseAND(F.lit(3))
    told = found.withColumns({"track_number": take("161", 2), "tod": take("140", 3) / 128.0, "_kind": kind})
    targets = synthetic_codes(told.filter((F.col("_kind") == 1) & at("040").isNotNull() & at("140").isNotNull()), source=order[0], order=order[1])
    tracked = F.col("track_number").isNotNull()
    status = F.when(at("170").isNotNull(), raw("170", 1))
    for k in (1, 2):  # as far as its bytes go on
        status = F.when(F.length(status) == k, F.when(take("170", 1, k - 1) % 2 == 1, F.concat(status, F.substring(p, at("170") + 1 + k, F.lit(1)))).otherwise(status)).otherwise(status)
    some = lambda c: F.coalesce(c, F.lit(b""))
    second = F.when(tracked, 16).otherwise(0) + F.when(at("200").isNotNull(), 4).otherwise(0) + F.when(at("170").isNotNull(), 2).otherwise(0)
    first = F.lit(0xF0) + F.when(tracked, 12).otherwise(0) + F.when(second > 0, 1).otherwise(0)
    rho = F.floor(take("040", 2) / 1852.0 * 256.0)
    body = F.concat(
        B.be(first, 1), F.when(second > 0, B.be(second, 1)).otherwise(F.lit(b"")), raw("010", 2), raw("140", 3), B.be(F.lit(0x40), 1), B.be(rho, 2), F.substring(p, at("040") + 3, F.lit(2)),
        some(F.when(tracked, F.concat(B.be(F.col("modea"), 2), B.be(F.lit(LEVEL), 2), raw("161", 2)))), some(F.when(at("200").isNotNull(), raw("200", 4))), some(status),
    )
    north = told.filter((F.col("_kind") == 2) & at("140").isNotNull())
    marker = F.concat(B.be(F.lit(0xE0), 1), raw("010", 2), B.be(F.lit(1), 1), raw("140", 3))
    return targets.select(*order, *_block(48, body)).unionByName(north.select(*order, *_block(34, marker)))


def _block(cat: int, body: Column) -> list[Column]:
    return [F.lit(cat).alias("cat"), F.concat(B.be(F.lit(cat), 1), B.be(F.length(body) + 3, 2), body).alias("payload")]
