"""Duplicate suppression: of identical blocks within four seconds, the first stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes

#: Seconds that a block is remembered from when it was first seen: a fixed value.
HORIZON = 4.0
#: Seconds of one key's blocks that a task sorts at once.
SLOT = 256.0


def mark_duplicates(blocks: DataFrame, time: str = "ts", order: tuple[str, ...] = ("seq",), key: Column | None = None, horizon: float = HORIZON) -> DataFrame:
    """Adds is_first: false for a block seen within the horizon of the last one kept that was identical.

    Duplicates don't prolong the horizon; an age of just the horizon is a duplicate still. A gap beyond
    it parts a key's blocks into runs, found slot by slot of time with what each hands on to the next, and
    only inside of a run are they folded in order, so a key that comes for years costs no more than its
    longest run. Rows without a time or payload are all first.
    """
    t, name = F.col(time), key if key is not None else codes.block_key(F.col("payload"))
    told = blocks.withColumn("_key", name)
    usable = t.isNotNull() & F.col("_key").isNotNull()
    items = told.filter(usable).select("_key", F.floor(t / SLOT).alias("_slot"), *order, t.alias("_t"))
    w = Window.partitionBy("_key", "_slot").orderBy("_t", *order)
    begins = F.when(F.col("_t") - F.col("_before") > horizon, F.col("_t"))  # a run, inside of a slot
    items = items.withColumn("_before", F.lag("_t").over(w)).withColumn("_run", F.max(begins).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a row for each slot of a key: the run that its first block is in
    slots = items.groupBy("_key", "_slot").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.max("_run").alias("_last"))
    by_key = Window.partitionBy("_key").orderBy("_slot")
    opened = F.when(F.coalesce(F.col("_low") - F.lag("_high").over(by_key) > horizon, F.lit(True)), F.col("_low"))
    slots = slots.withColumn("_opened", opened).withColumn("_last", F.coalesce("_last", "_opened"))
    carried = F.max("_last").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("_key", "_slot", F.coalesce("_opened", carried).alias("_carried"))
    runs = items.join(slots, ["_key", "_slot"]).withColumn("_run", F.coalesce("_run", "_carried"))
    item = F.struct("_t", *order)
    folded = runs.groupBy("_key", "_run").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    items = dict(folded.dtypes)["xs"]
    kind = f"struct<last:double,kept:{items}>"

    def step(state: Column, x: Column) -> Column:
        new = state["last"].isNull() | (x["_t"] - state["last"] > horizon)
        return F.struct(F.when(new, x["_t"]).otherwise(state["last"]).alias("last"), F.when(new, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept")).cast(kind)

    init = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(items).alias("kept")).cast(kind)
    firsts = folded.select("_key", F.explode(F.aggregate("xs", init, step)["kept"]).alias("x")).select("_key", *(F.col(f"x.{c}").alias(c) for c in order), F.lit(True).alias("_first"))
    out = told.join(firsts, ["_key", *order], "left")
    return out.withColumn("is_first", ~usable | F.coalesce("_first", F.lit(False))).drop("_key", "_first")


def drop_duplicates(blocks: DataFrame, **options) -> DataFrame:
    return mark_duplicates(blocks, **options).filter("is_first").drop("is_first")
