"""Which packets a recorder takes: its table of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANY = "0.0.0.0"
#: Sources are configured by hand; a table of more rows than this is joined by shuffle.
BROADCAST_SOURCES = 100_000


def admit(packets: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("group_ip", "port"), address: str = "source_ip", id_: str = "packet_id") -> DataFrame:
    """Packets whose group and port a source has, and whose address is its own or any; `flow` is the name of the first such source.

    sources: name, keys, source_ip and position, by which the first is meant. id_ names a packet.
    Packets that no source takes go.
    """
    dim = sources.select(*keys, F.col("name").alias("flow"), F.col("source_ip").alias("_ip"), F.col("position").alias("_pos"))
    # of one group, port and address, the first source is enough; so each packet meets two at most
    dim = dim.groupBy(*keys, "_ip").agg(F.min_by("flow", "_pos").alias("flow"), F.min("_pos").alias("_pos"))
    small = F.broadcast(dim) if sources.count() <= BROADCAST_SOURCES else dim
    named = packets.join(small.withColumnRenamed("_ip", "_own"), [*(packets[k] == small[k] for k in keys), packets[address] == F.col("_own")], "left").select(packets["*"], F.col("flow").alias("_f1"), F.col("_pos").alias("_p1"))
    any_ = small.filter(F.col("_ip") == ANY).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("flow").alias("_f2"), F.col("_pos").alias("_p2"))
    both = named.join(any_, [named[k] == F.col(f"_{k}") for k in keys], "left")
    flow = F.when(F.col("_p1").isNull() | (F.col("_p2") < F.col("_p1")), F.col("_f2")).otherwise(F.col("_f1"))
    return both.select(packets.columns + [flow.alias("flow")]).filter(F.col("flow").isNotNull())


def subscriptions(sources: DataFrame, keys: tuple[str, ...] = ("group_ip", "port")) -> DataFrame:
    """Sources that open a socket of their own: those whose group and port differ from the ones before."""
    w = Window.orderBy("position")  # the table of sources is small by nature
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    return sources.withColumn("_same", same & F.lag("position").over(w).isNotNull()).filter(~F.col("_same")).drop("_same")
