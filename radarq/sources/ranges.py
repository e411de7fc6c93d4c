"""Byte ranges of framed files, and the chains of frames that run through them.

A frame's place is known only from the one before. So a range is walked from every byte at which a frame
could begin in it: all these walks soon fall together, and what is left is a map from each place where the
chain may enter to the one where it leaves, and how many frames lie between. Maps of a file's ranges are
chained in order, a row at a time; then every range knows its first frame and can be read by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Schemes whose files Python can read from the middle; others are read whole by Spark.
RANGED = ("file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss")
LONGEST = 65535  # bytes of a block: its length has two
REGION = 1 << 17
FEW = 4  # walks that go on one by one
NOWHERE = -1
INDEX_BYTES = 4 << 16  # a map has up to 64 KiB of entries, however short its range; so it is of so many bytes at least

INDEX = "path string, k long, entry long, seq long"
MAP = "path string, k long, start long, header long, which binary, frames binary, leaves binary"


class File:
    """One file, read by ranges."""

    def __init__(self, path: str):
        scheme = (re.match(r"([a-z0-9]+):", path) or [None, "file"])[1]
        if scheme == "file":
            self.file = open(re.sub(r"^file:/*", "/", path), "rb")
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
            self.file = system.open_input_file(inner)

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


class Chain:
    """Frames of a file of `length` bytes, of which raw holds those from base on."""

    def __init__(self, raw: bytes, base: int, length: int, before: int, behind: int, counted: bool):
        self.raw, self.base, self.length, self.before, self.behind = raw, base, length, before, behind
        self.counted = counted  # four bytes in front tell the length, themselves and all before counted

    def sizes(self, lo: int, hi: int) -> np.ndarray:
        """Of a frame at each place from lo to hi, the bytes of its block; 0 where none fits."""
        data = np.frombuffer(self.raw, np.uint8)
        at = np.arange(lo - self.base, hi - self.base)
        byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
        if self.counted:
            size = (byte(0) << 24 | byte(1) << 16 | byte(2) << 8 | byte(3)) - self.before
        else:
            size = byte(self.before + 1) << 8 | byte(self.before + 2)
        here = at + self.base
        fits = (size >= 3) & (size <= LONGEST) & (here + self.before + size + self.behind <= self.length) & (here + self.before + 3 <= self.length)
        return np.where(fits, size, 0)

    def walk(self, at: int, end: int) -> tuple[list[int], int]:
        """Places of the frames from `at` on that begin before `end`, and where the next one would; NOWHERE where the chain breaks."""
        raw, base, before, rest, last = self.raw, self.base, self.before, self.before + self.behind, self.length
        found, p = [], at - base
        end, last = end - base, last - base
        head = slice(0, 4) if self.counted else slice(before + 1, before + 3)
        a, b, less = head.start, head.stop, before if self.counted else 0
        while p < end:
            size = int.from_bytes(raw[p + a : p + b], "big") - less
            if not 3 <= size <= LONGEST or p + rest + size > last:
                return found, NOWHERE
            found.append(p + base)
            p += rest + size
        return found, p + base

    def leaving(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """For a chain at each place from lo to hi: where it leaves the region, and the frames until then; by doubling steps."""
        size = self.sizes(lo, hi)
        to = np.where(size > 0, np.arange(lo, hi) + self.before + size + self.behind, NOWHERE)
        frames = (size > 0).astype(np.int64)
        inside = np.flatnonzero((to >= lo) & (to < hi))
        while len(inside):
            step = to[inside] - lo
            frames[inside] += frames[step]
            to[inside] = to[step]
            inside = inside[(to[inside] >= lo) & (to[inside] < hi)]
        return to, frames


def range_map(chain: Chain, start: int, end: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, frames, leaves): a chain that enters at entries[i] leaves the range at leaves[which[i]] after frames[i] frames."""
    heads, which = np.unique(entries, return_inverse=True)
    frames = np.zeros(len(entries), np.int64)
    lo = start
    while True:
        alive = (heads >= 0) & (heads < end)
        if not alive.any() or alive.sum() <= FEW and lo > start:
            break
        hi = min(lo + REGION, end)
        here = alive & (heads < hi)
        if here.any():
            to, count = chain.leaving(lo, hi)
            more = np.zeros(len(heads), np.int64)
            more[here] = count[heads[here] - lo]
            heads[here] = to[heads[here] - lo]
            frames += more[which]
            heads, again = np.unique(heads, return_inverse=True)
            which = again[which]
        lo = hi
    for i in np.flatnonzero((heads >= 0) & (heads < end)):
        found, heads[i] = chain.walk(int(heads[i]), end)
        frames += np.where(which == i, len(found), 0)
    return which, frames, heads


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of INDEX from rows of MAP that are sorted by path and k: the first frame in each range and the frames before; none where the chain has ended."""
    path, at, seq = None, NOWHERE, 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["path"] != path:
                path, at, seq = row["path"], row["header"], 0
            if at == NOWHERE:
                continue
            out.append((path, row["k"], at, seq))
            if not row["frames"]:  # the file's last
                at = NOWHERE
                continue
            i = at - row["start"] if row["k"] else 0
            seq += int(np.frombuffer(row["frames"], np.int64)[i])
            at = int(np.frombuffer(row["leaves"], np.int64)[np.frombuffer(row["which"], np.int32)[i]])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "k", "entry", "seq"])
