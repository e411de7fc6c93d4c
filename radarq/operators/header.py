"""The light view of blocks: category, length and sensor, from the first bytes only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits as B


def presence_length(payload: Column) -> Column:
    """Presence bytes of the first record, five at most; null if the block ends before."""
    out = F.lit(None).cast("int")
    for n in range(5, 0, -1):
        out = F.when(B.unsigned(payload, 3 + n, 1) % 2 == 0, n).otherwise(out)
    return out


def with_header(blocks: DataFrame) -> DataFrame:
    """Adds cat, len (as the block says), sac and sic (of its first record, null if it names none)."""
    p = F.col("payload")
    start = presence_length(p) + 4
    named = B.has_item(p, 128)
    return blocks.withColumns({
        "cat": B.unsigned(p, 1, 1).cast("int"),
        "len": B.unsigned(p, 2, 2).cast("int"),
        "sac": F.when(named, B.unsigned(p, start, 1)).cast("int"),
        "sic": F.when(named, B.unsigned(p, start + 1, 1)).cast("int"),
    })


def split_packets(packets: DataFrame) -> DataFrame:
    """A row for each block in a packet's payload, with block_index; a last block that is cut off stays as it is.

    Packets without bytes have none. Lengths under three end a packet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, cut = [], [], []
            for i, cell in enumerate(batch["payload"]):
                raw, at, n = cell.as_py() or b"", 0, 0
                while at < len(raw):
                    size = int.from_bytes(raw[at + 1 : at + 3], "big")
                    end = at + size if size >= 3 else len(raw)
                    row.append(i)
                    index.append(n)
                    cut.append(raw[at:end])
                    at, n = end, n + 1
            kept = batch.drop_columns(["payload"]).take(pa.array(np.array(row, np.int64)))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(index, pa.int32()), pa.array(cut, pa.binary())], [*kept.schema.names, "block_index", "payload"])

    others = packets.drop("payload")
    return packets.select(*others.columns, "payload").mapInArrow(run, T.StructType([*others.schema, *T.StructType.fromDDL("block_index int, payload binary")]))


def sensor_list(blocks: DataFrame) -> DataFrame:
    """One row a block, as it comes: cat, len, sac, sic."""
    return with_header(blocks).select("cat", "len", "sac", "sic")


def sensors(blocks: DataFrame) -> DataFrame:
    """Distinct sensors and categories with their blocks and bytes."""
    return with_header(blocks).groupBy("cat", "sac", "sic").agg(F.count("*").alias("n_blocks"), F.sum(F.length("payload")).alias("n_bytes"))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Sensor names by (sac, sic); rows of unnamed sensors keep nulls. names: 65536 rows at most, as both are bytes."""
    small = names.dropDuplicates(["sac", "sic"]).select("sac", "sic", "sac_short", "sac_long", "sic_short", "sic_long")
    return rows.join(F.broadcast(small), ["sac", "sic"], "left")
