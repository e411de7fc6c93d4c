"""Recordings of framed messages, read from any file system that Spark reads.

Files are cut into byte ranges, which tasks share; short ranges that follow each other make a stretch, which a task
walks range by range. A file of one stretch is framed from its header on; of longer files, an index of each
stretch's first frame is made beforehand (`ranges`), in parallel too. So one file may be as long as it likes. Where
Python can't read from the middle of a file, Spark reads it whole, which works up to 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.header import with_header
from . import ranges
from .ranges import Chain, File

#: Filler of the first kind of recording, its header and the trailers behind blocks.
FILLER, HEADER_1, TRAILER_1, TRAILER_2 = 0xCD, 2200, 10, 4
BLOCK = "source string, seq long, payload binary, trailer binary, recv_tod double, src_ip string"
LIGHT = "source string, seq long, cat int, len int, sac int, sic int, recv_tod double, src_ip string"
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 14


@dataclass(frozen=True)
class Framing:
    """Bytes before the first block, and before and behind each; what a trailer holds; and who says a block's length."""

    header: int = 0
    before: int = 0
    behind: int = 0
    trailer: str = ""  # "", "v1", "v2" or "era"
    length: str = "block"  # "block": its second and third byte; "hensoldt": the four bytes in front, themselves counted


FRAMINGS = {
    "ast": Framing(),
    "gps1": Framing(HEADER_1, 0, TRAILER_1, "v1"),
    "gps2": Framing(0, 0, TRAILER_2, "v2"),
    "hensoldt": Framing(before=12, length="hensoldt"),
    "era": Framing(before=8, trailer="era"),
}


def detect(head: bytes) -> Framing:
    """The first kind of timed recording shows its filler; else it is the second."""
    return FRAMINGS["gps1"] if head[20:40] == bytes([FILLER]) * 20 else FRAMINGS["gps2"]


def read_recording(
    spark: SparkSession, path: str | list[str], format: str = "auto", framing: Framing | None = None, categories: tuple[int, ...] | None = None, light: bool = False, range_bytes: int = RANGE_BYTES, index_bytes: int = ranges.INDEX_BYTES
) -> DataFrame:
    """(source, seq, payload, trailer, recv_tod, src_ip, cat, len, sac, sic) of all blocks of all files; seq counts a file's blocks.

    format: ast, gps1, gps2, hensoldt, era, or auto, which tells the two timed kinds apart. framing
    overrides it with byte counts of one's own. categories: blocks of others are left out while framing,
    before anything is copied. light: the columns of LIGHT only, and no block leaves the reader. range_bytes: what is
    read at a time; index_bytes: least length of a stretch that has its entry in the index. A block that is cut
    off, or whose length can't be, ends its file. Empty files have no blocks.
    """
    if framing is None and format != "auto" and format not in FRAMINGS:
        raise ValueError(f"unknown format {format!r}")
    kept = None if categories is None else np.isin(np.arange(256), categories)
    schema = LIGHT if light else BLOCK
    stretch = range_bytes * max(1, index_bytes // range_bytes)
    finish = (lambda df: df) if light else with_header

    def chosen(head: bytes) -> Framing:
        return framing or (detect(head) if format == "auto" else FRAMINGS[format])

    def chain(raw: bytes, base: int, length: int, f: Framing) -> Chain:
        return Chain(raw, base, length, f.before, f.behind, f.length == "hensoldt")

    if not _ranged(spark, path):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, cell in zip(batch["path"].to_pylist(), batch["content"]):
                    raw = cell.as_py()
                    f = chosen(raw[:40])
                    yield from _rows(name, 0, raw, 0, chain(raw, 0, len(raw), f).walk(f.header, len(raw))[0], f, kept, light)

        return finish(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, schema))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with File(row["path"]) as file:
                    f = chosen(file.read(0, 40))
                    reach = f.before + ranges.LONGEST + f.behind + 1
                    start, end, length = row["start"], min(row["start"] + stretch, row["length"]), row["length"]
                    raw = file.read(start, end - start + reach) if end < length else b""
                entries = np.arange(start, min(start + reach, length + 1)) if row["k"] else np.array([f.header])
                if end < length:
                    which, frames, leaves = ranges.range_map(chain(raw, start, length, f), start, end, entries)
                else:  # nothing follows
                    which, frames, leaves = (np.array([], np.int64) for _ in range(3))
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([row["path"]]), "k": pa.array([row["k"]], pa.int64()), "start": pa.array([start], pa.int64()), "header": pa.array([f.header], pa.int64()),
                    "which": [which.astype(np.int32).tobytes()], "frames": [frames.tobytes()], "leaves": [leaves.tobytes()],
                })

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with File(row["path"]) as file:
                    f = chosen(file.read(0, 40))
                    at, seq, length = row["entry"] if row["k"] else f.header, row["seq"] or 0, row["length"]
                    for lo in range(row["start"], min(row["start"] + stretch, length), range_bytes):
                        end = min(lo + range_bytes, length)
                        if at is None or at == ranges.NOWHERE or at >= end:
                            continue
                        raw = file.read(at, end - at + f.before + ranges.LONGEST + f.behind)
                        places, after = chain(raw, at, length, f).walk(at, end)
                        yield from _rows(row["path"], seq, raw, at, places, f, kept, light)
                        at, seq = after, seq + len(places)

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    count = F.greatest(F.ceil(F.col("length") / stretch), F.lit(1))
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).withColumn("start", F.col("k") * stretch)
    total = files.agg(F.sum(count).alias("n"), F.sum("length").alias("bytes"), F.max("length").alias("longest")).head()
    n_tasks = max(1, min(total["n"] or 0, max(spark.sparkContext.defaultParallelism, -(-(total["bytes"] or 0) // RANGE_BYTES))))
    parts = parts.repartition(n_tasks)
    if (total["longest"] or 0) > stretch:
        mapped = parts.filter(F.col("length") > stretch).mapInArrow(maps, ranges.MAP)
        index = mapped.repartition("path").sortWithinPartitions("path", "k").mapInArrow(ranges.chained, ranges.INDEX)
        parts = parts.join(index, ["path", "k"], "left").repartition(n_tasks)
    else:
        parts = parts.withColumns({"entry": F.lit(None).cast("long"), "seq": F.lit(None).cast("long")})
    return finish(parts.mapInArrow(blocks, schema))


def _ranged(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether all paths are in stores that Python can read from the middle."""
    found = [spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() for p in ([path] if isinstance(path, str) else path)]
    return all(s in ranges.RANGED for s in found)


def _rows(name: str, seq: int, raw: bytes, base: int, places: list[int], f: Framing, kept: np.ndarray | None, light: bool) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK, or of LIGHT, for the frames at some places of a file of which raw holds what follows base."""
    data = np.frombuffer(raw, np.uint8)
    at = np.array(places, np.int64) - base
    number = np.arange(seq, seq + len(at))
    if kept is not None:
        use = kept[data[at + f.before]]
        at, number = at[use], number[use]
    start = at + f.before
    if f.length == "hensoldt":
        size = _big(data, at, 4) - f.before
    else:
        size = _big(data, start + 1, 2)
    group = np.cumsum(size) // BATCH_BYTES
    for lo in range(0, len(at), BATCH_ROWS):
        hi = min(lo + BATCH_ROWS, len(at))
        edges = [lo, *(lo + 1 + np.flatnonzero(np.diff(group[lo:hi]))).tolist(), hi]
        for a, b in zip(edges, edges[1:]):
            s, n, p = start[a:b], size[a:b], at[a:b]
            extra = np.concatenate([data[p[:, None] + np.arange(f.before)], data[(s + n)[:, None] + np.arange(f.behind)]], 1)
            time, address = _times(extra, f.trailer)
            columns = {"source": pa.DictionaryArray.from_arrays(pa.array(np.zeros(b - a, np.int32)), pa.array([name])).cast(pa.string()), "seq": pa.array(number[a:b])}
            if light:
                columns |= _header(data, s, n)
            else:
                columns |= {"payload": _cut(data, s, n), "trailer": _cut(np.ascontiguousarray(extra).ravel(), np.arange(b - a) * extra.shape[1], np.full(b - a, extra.shape[1]))}
            yield pa.RecordBatch.from_pydict(columns | {"recv_tod": time, "src_ip": address})


def _big(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(n):
        out = out << 8 | data[at + k]
    return out


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start : start + size] of each, as a binary column."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    if len(start) and (start[1:] == start[:-1] + size[:-1]).all():
        whole = data[start[0] : start[0] + ends[-1]]
    else:
        whole = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(whole))])


def _times(extra: np.ndarray, trailer: str) -> tuple[pa.Array, pa.Array]:
    """Reception times and source addresses that bytes around blocks tell."""
    n = len(extra)
    time, address = pa.nulls(n, pa.float64()), pa.nulls(n, pa.string())
    little = lambda at: sum(extra[:, at + k].astype(np.int64) << 8 * k for k in range(4))
    if trailer == "v1":
        time = pa.array(_big(extra.ravel(), np.arange(n) * extra.shape[1] + 6, 3) / 128.0)
        known, which = np.unique(extra[:, :4], axis=0, return_inverse=True)
        names = pa.array([".".join(str(x) for x in reversed(row)) for row in known.tolist()], pa.string())
        address = names.take(pa.array(which.ravel()))
    elif trailer == "v2":
        time = pa.array(little(0) / 1000.0)
    elif trailer == "era":
        time = pa.array(little(4) % 86400 / 1.0)
    return time, address


def _header(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, pa.Array]:
    """cat, len, sac and sic of blocks, as with_header() tells them."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    presence = np.stack([padded[start + 3 + k] for k in range(5)], 1)
    closed = (presence & 1 == 0) & (np.arange(5) < (size - 3)[:, None])
    n = np.where(closed.any(1), closed.argmax(1) + 1, 0)
    named = (size > 3) & (presence[:, 0] & 128 > 0) & (n > 0)
    found = {"cat": pa.array(data[start].astype(np.int32)), "len": pa.array(_big(data, start + 1, 2).astype(np.int32))}
    for k, name in enumerate(("sac", "sic")):
        there = named & (3 + n + k < size)
        found[name] = pa.array(padded[start + np.where(there, 3 + n + k, 0)].astype(np.int32), mask=~there)
    return found


def read_replies(spark: SparkSession, path: str | list[str], limit: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source, seq, payload) of raw reply records of 72 bytes; a cut-off end is left out. limit: so many of each file."""
    from ..operators.replies import RECORD

    if not _ranged(spark, path):
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("content").alias("c"))
        count = F.floor(F.length("c") / RECORD).cast("int")
        count = count if limit is None else F.least(count, F.lit(limit))
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.cast("long").alias("seq"), F.substring("c", k * RECORD + 1, F.lit(RECORD)).alias("payload")))
        return files.filter(count > 0).select("source", F.explode(cut).alias("r")).select("source", "r.*")

    step = max(1, range_bytes // RECORD)  # records of a range

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch[c].to_pylist() for c in ("path", "first", "n"))):
                with File(path) as file:
                    for k in range(first, first + n, BATCH_ROWS):
                        m = min(BATCH_ROWS, first + n - k)
                        data = np.frombuffer(file.read(k * RECORD, m * RECORD), np.uint8)
                        yield pa.RecordBatch.from_pydict({"source": pa.array([path] * m), "seq": np.arange(k, k + m), "payload": _cut(data, np.arange(m) * RECORD, np.full(m, RECORD))})

    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / RECORD).alias("n"))
    files = (files if limit is None else files.withColumn("n", F.least("n", F.lit(limit)))).filter("n > 0")
    parts = files.select("path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("first"))
    parts = parts.select("path", "first", F.least(F.col("n") - F.col("first"), F.lit(step)).alias("n"))
    return parts.repartition(spark.sparkContext.defaultParallelism).mapInArrow(records, "source string, seq long, payload binary")


def gps_clock(line: str = "line"):
    """The time that a serial clock tells in a line XGUYYMMDDhhmmss, null for others."""
    ok = F.col(line).rlike("^XGU[0-9]{12}")
    return F.when(ok, F.try_to_timestamp(F.substring(line, 4, 12), F.lit("yyMMddHHmmss")))
