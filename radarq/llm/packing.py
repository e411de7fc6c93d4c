"""Concatenate and cut: documents' token ids end to end, cut into fixed windows.

Pass one writes each task's token ids with their offset inside the task; the tasks' totals (one
number each) give every task its base by a prefix sum. Pass two adds the base and cuts. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens

LENGTH = 4096
END = 2
SLICE = 256  # documents a record batch
BROADCAST_PARTS = 1_000_000


def tokenize(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Rows (part, local, doc_id, n, ids): ids as little-endian uint16 or uint32 with the end id, written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u4" if end >= 1 << 16 else enc.kind
        last = np.array([end], kind)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                piece = batch.slice(k, SLICE)
                ids = [x.astype(kind, copy=False) for x in enc.ids([t or "" for t in piece["text"].to_pylist()])]
                n = np.array([len(x) + 1 for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(n), pa.int32()), "local": local, "doc_id": piece["doc_id"],
                    "n": n, "wide": pa.array([kind == "<u4"] * len(n)), "ids": pa.array([x.tobytes() + last.tobytes() for x in ids], pa.binary()),
                })

    schema = "part int, local long, doc_id long, n long, wide boolean, ids binary"
    return C.write_scratch(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema), "tokens")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    Every document row is its ids and the end id; null text is empty, so it is the end id alone.
    Repeated doc_ids are packed row by row; null doc_ids stay null. No rows: no pieces. All sequences
    but the last are full.
    """
    written = tokenize(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end)
    totals = written.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    n_parts = len(written.inputFiles())
    placed = written.join(F.broadcast(bases) if n_parts <= BROADCAST_PARTS else bases, "part")
    placed = placed.select("doc_id", (F.col("base") + F.col("local")).alias("at"), "n", "wide", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                piece = batch.slice(k, SLICE)
                at, n = piece["at"].to_numpy(), piece["n"].to_numpy()
                first, last = at // length, (at + n - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                low, high = np.maximum(at[row], seq * length), np.minimum((at + n)[row], (seq + 1) * length)
                whole = [C.read(x, "<u4" if w.as_py() else "<u2").astype("<u4") for x, w in zip(piece["ids"], piece["wide"])]
                start = low - at[row]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece["doc_id"].take(pa.array(row)), "start": start, "length": high - low,
                    "ids": pa.array([whole[r][s : s + m].tobytes() for r, s, m in zip(row, start, high - low)], pa.binary()),
                    "doc_tokens": n[row], "sequence_id": seq, "offset": low - seq * length,
                })

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(C.table(spark, sf_dir, "documents")))
