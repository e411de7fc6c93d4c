"""Recordings written in two phases to any store: files of task attempts first, then one commit.

Tasks write to a folder of their attempt below `_attempts`; attempts that fail, or that another one has
overtaken, are never named to the driver. The driver writes down what goes where (`_commits`), and
moves the files. If it is lost in between, recover() ends that commit; before it, there is nothing to end. Readers
pass over both folders.
"""

from __future__ import annotations

import bz2
import json
import os
import re
import uuid
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from .hadoop import Store
from .recording import FILLER, HEADER_1


def trailer_v1(payload: Column, tod: Column, ip: Column) -> Column:
    """Source address reversed, block length, time in 1/128 s, filler."""
    octets = [B.be(F.split_part(ip, F.lit("."), F.lit(k)).cast("int"), 1) for k in (4, 3, 2, 1)]
    return F.concat(*octets, B.be(F.length(payload), 2), B.be(F.floor(tod * 128), 3), B.be(F.lit(FILLER), 1))


def trailer_v2(tod: Column) -> Column:
    """Milliseconds since midnight."""
    return B.le(F.floor(tod * 1000), 4)


def header_era(payload: Column, epoch: Column) -> Column:
    """Marker, length with itself, seconds since 1970."""
    return F.concat(B.be(F.lit(0x38), 1), B.be(F.lit(0), 1), B.le(F.length(payload) + 4, 2), B.le(F.floor(epoch), 4))


def framed(blocks: DataFrame, format: str = "ast", midnight: int = 0) -> DataFrame:
    """(source, seq, frame): each block with what its format puts around it.

    Timed formats need recv_tod, gps1 also src_ip (0.0.0.0 if unknown); era adds midnight, in seconds since 1970.
    """
    p = F.col("payload")
    if format == "ast":
        frame = p
    elif format == "gps1":
        frame = F.concat(p, trailer_v1(p, F.col("recv_tod"), F.coalesce("src_ip", F.lit("0.0.0.0"))))
    elif format == "gps2":
        frame = F.concat(p, trailer_v2(F.col("recv_tod")))
    elif format == "hensoldt":
        frame = F.concat(B.be(F.length(p) + 12, 4), B.be(F.lit(0), 8), p)
    elif format == "era":
        frame = F.concat(header_era(p, F.floor("recv_tod") + midnight), p)
    else:
        raise ValueError(f"unknown format {format!r}")
    return blocks.select("source", "seq", frame.alias("frame"))


def _create(path: str) -> IO[bytes]:
    """A new file, with its folders, in a store that Python can write to."""
    local = re.match(r"(?:file:/*)?(/.*|[^:]*$)", path)
    if local and not re.match(r"[a-z0-9]{2,}:", path.replace("file:", "", 1)):
        name = re.sub(r"^file:/*", "/", path)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        return open(name, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def _put(staging: str, header: bytes, suffix: str, named: bool, compress: bool):
    """Writes runs of one source to files of this attempt; a row (staged, final) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        out, current = None, object()
        for batch in batches:
            source, frame = batch["source"], batch["frame"].cast(pa.large_binary())
            changed = pc.not_equal(source.slice(1).fill_null(""), source.slice(0, len(source) - 1).fill_null("")) if len(source) > 1 else pa.array([], pa.bool_())
            edges = [0, *(1 + np.flatnonzero(changed.to_numpy(zero_copy_only=False))).tolist(), len(source)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                name = source[a].as_py()
                if out is None or name != current:
                    if out is not None:
                        out.close()
                    current, made = name, uuid.uuid4().hex
                    final = name if named else f"{made}.{suffix}"
                    if final is None or final.startswith("/") or ".." in final.split("/"):
                        raise ValueError(f"not a file name below the folder: {final!r}")
                    final += ".bz2" if compress else ""
                    files.append((f"{attempt}/{made}", final))
                    out = _create(f"{staging}/{files[-1][0]}")
                    out = bz2.open(out, "wb") if compress else out
                    out.write(header)
                part = frame.slice(a, b - a)
                _, offsets, data = part.buffers()
                at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + b - a + 1]
                out.write(memoryview(data)[at[0] : at[-1]] if data is not None else b"")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"staged": pa.array([f[0] for f in files], pa.string()), "final": pa.array([f[1] for f in files], pa.string())})

    return run


def write_recording(blocks: DataFrame, folder: str, format: str = "ast", midnight: int = 0, extension: str = "ast", named: bool = False, compression: str = "none") -> None:
    """One file for each source, its blocks in order of seq.

    named: source is the file's name below the folder, with its directories; else names are made. A file of that
    name is replaced. compression: none or bzip2. A source is what one task writes, so cut recordings by
    time. No blocks: no files.
    """
    spark: SparkSession = blocks.sparkSession
    rows = framed(blocks, format, midnight).repartition("source").sortWithinPartitions("source", "seq").select("source", "frame")
    store, job = Store(spark, folder), uuid.uuid4().hex
    header = bytes([FILLER]) * HEADER_1 if format == "gps1" else b""
    put = _put(f"{store.direct()}/_attempts/{job}", header, extension, named, compression == "bzip2")
    try:
        files = rows.mapInArrow(put, "staged string, final string").collect()  # a row for each file
    except Exception:
        store.delete(f"_attempts/{job}")
        raise
    if files:
        store.write_once(f"_commits/{job}", json.dumps([[f"_attempts/{job}/{f.staged}", f.final] for f in files]))
        _finish(store, job)
    store.delete(f"_attempts/{job}")


def _finish(store: Store, job: str) -> None:
    """Carry out a commit that is written down; once more does no harm."""
    for staged, final in json.loads(store.read(f"_commits/{job}")):
        store.move(staged, final)
    store.delete(f"_attempts/{job}")
    store.delete(f"_commits/{job}")


def recover(spark: SparkSession, folder: str) -> int:
    """End the commits that a lost driver left, and drop what it had not written down; their number. Nothing else may write to the folder meanwhile."""
    store = Store(spark, folder)
    jobs = [j for j in store.names("_commits") if not j.startswith(".")]
    for job in jobs:
        _finish(store, job)
    for name in ("_attempts", "_commits"):
        store.delete(name)
    return len(jobs)
