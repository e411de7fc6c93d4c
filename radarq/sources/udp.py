"""Live feeds: packets of multicast or broadcast groups, landed in a log by tasks and read from it as a stream.

`land(spark, [("239.1.1.1", 5000)], log)` runs a receiver for each group, a task each. It appends what
comes to its group's log, in segments, before anything else knows of it; `spark.readStream.format("surveillance_udp")
.option("log", log)` reads the log, a partition for each group. Offsets are places in it, so neither a lost driver,
nor a batch that fails, nor a receiver that is started again loses or repeats a packet that was landed. While one
receiver takes over from another that still runs, both may land the same packets.

The log must be a folder that all executors mount: it is appended to.

An open segment is `<number>.open`; a closed one's name also tells how many bytes count: `<number>-<bytes>.log`.
"""

from __future__ import annotations

import os
import re
import socket
import struct
import sys
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: bytes of a socket's receive buffer.
BUFFER = 100 * 1024
MOST = 65536
HEAD = "<IId4s"  # of a packet in the log: bytes of payload, number in the segment, time, address
HEAD_SIZE = struct.calcsize(HEAD)
SEGMENT_PACKETS = 1 << 20  # a packet_id, which names a packet of its group, is its segment times this and its number there
SEGMENT_BYTES = 64 << 20
SEGMENT = re.compile(r"(\d{8})(?:\.open|-(\d+)\.log)")


def open_socket(group: str, port: int, interface: str = "0.0.0.0") -> socket.socket:
    """A bound socket that shares its port; groups from 224 to 239 are joined."""
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, BUFFER)
    if 224 <= int(group.split(".")[0]) <= 239:
        s.bind((group, port))
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, struct.pack("4s4s", socket.inet_aton(group), socket.inet_aton(interface)))
    else:
        s.setsockopt(socket.SOL_SOCKET, socket.SO_BROADCAST, 1)
        s.bind(("", port))
    s.settimeout(0.1)
    return s


def folder_of(log: str, group: str, port: int) -> str:
    return f"{re.sub(r'^file:/*', '/', log).rstrip('/')}/{group}_{port}"


def segments(folder: str) -> dict[int, tuple[str, int | None]]:
    """Segments by number: file, and bytes that count, if closed."""
    found = {}
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        if m := SEGMENT.fullmatch(name):
            found[int(m[1])] = f"{folder}/{name}", None if m[2] is None else int(m[2])
    return dict(sorted(found.items()))


def whole(path: str, at: int = 0) -> int:
    """Where the last whole packet from `at` on ends."""
    with open(path, "rb") as f:
        top = os.fstat(f.fileno()).st_size
        while at + HEAD_SIZE <= top:
            f.seek(at)
            end = at + HEAD_SIZE + struct.unpack(HEAD, f.read(HEAD_SIZE))[0]
            if end > top:
                break
            at = end
    return at


def close_segment(path: str) -> None:
    """Give an open segment its final name; packets behind those that are whole now don't count."""
    try:
        os.rename(path, f"{path.removesuffix('.open')}-{whole(path)}.log")
    except FileNotFoundError:
        pass  # whoever took over has done it


def receive(group: str, port: int, log: str, until: Callable[[], bool], interface: str = "0.0.0.0", only: str | None = None, idle: float = 10.0) -> int:
    """Land a group's packets until told to stop, or until another receiver takes over; how many.

    only: the one source whose packets count. Quiet for `idle` seconds, it joins again.
    """
    folder = folder_of(log, group, port)
    os.makedirs(folder, exist_ok=True)
    s, heard, landed = open_socket(group, port, interface), time.monotonic(), 0
    for path, size in segments(folder).values():  # joined by now, so what comes behind is ours
        if size is None:
            close_segment(path)
    number = max(segments(folder), default=-1) + 1
    path = f"{folder}/{number:08d}.open"
    out, n, size = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY | os.O_APPEND), 0, 0
    try:
        while not until():
            try:
                payload, (address, _) = s.recvfrom(MOST)
            except TimeoutError:
                if not os.path.exists(path):
                    break
                if time.monotonic() - heard > idle:
                    s.close()
                    s, heard = open_socket(group, port, interface), time.monotonic()
                continue
            heard = time.monotonic()
            if only and address != only:
                continue
            if n == SEGMENT_PACKETS or size >= SEGMENT_BYTES:
                if not os.path.exists(path):
                    break
                os.fsync(out)
                os.close(out)
                close_segment(path)
                number, n, size = number + 1, 0, 0
                path = f"{folder}/{number:08d}.open"
                out = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY | os.O_APPEND)
            record = struct.pack(HEAD, len(payload), n, time.time(), socket.inet_aton(address)) + payload
            os.write(out, record)
            n, size, landed = n + 1, size + len(record), landed + 1
    finally:
        os.fsync(out)
        os.close(out)
        s.close()
        close_segment(path)
    return landed


class Landing:
    """Receivers that run as tasks of one job."""

    def __init__(self, spark: SparkSession, groups: list[tuple[str, int]], log: str, seconds: float | None, options: dict):
        self.spark, self.log, self.tag = spark, re.sub(r"^file:/*", "/", log).rstrip("/"), f"landing-{time.time_ns()}"
        os.makedirs(self.log, exist_ok=True)
        stop, end = f"{self.log}/.stop-{self.tag}", None if seconds is None else time.time() + seconds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, port in [groups[i] for i in batch["id"].to_pylist()]:
                    n = receive(group, port, log, lambda: os.path.exists(stop) or end is not None and time.time() > end, **options)
                    yield pa.RecordBatch.from_pydict({"group": [group], "port": pa.array([port], pa.int32()), "landed": pa.array([n], pa.int64())})

        self.stop_file, self.landed = stop, {}
        frame = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, "group string, port int, landed long")  # a task each

        def work() -> None:
            spark.addTag(self.tag)
            self.landed.update({(r.group, r.port): r.landed for r in frame.collect()})

        self.thread = threading.Thread(target=work, daemon=True)
        self.thread.start()

    def wait(self, seconds: float | None = None) -> dict[tuple[str, int], int]:
        """Packets landed by group, when all receivers have ended."""
        self.thread.join(seconds)
        return self.landed

    def stop(self) -> dict[tuple[str, int], int]:
        """Have the receivers end; packets landed by group."""
        open(self.stop_file, "w").close()
        self.thread.join()
        os.remove(self.stop_file)
        return self.landed


def land(spark: SparkSession, groups: list[tuple[str, int]], log: str, seconds: float | None = None, interface: str = "0.0.0.0", only: str | None = None, idle: float = 10.0) -> Landing:
    """Receive groups (address, port) into a log: a task each, which holds a core until it is stopped or `seconds` are over."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        return Landing(spark, groups, log, seconds, {"interface": interface, "only": only, "idle": idle})
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


@dataclass
class Stretch(InputPartition):
    """What to read of one group's log: from a segment and byte to another."""

    group: str
    port: int
    folder: str
    first: tuple[int, int]
    last: tuple[int, int]


class _Reader(DataSourceStreamReader):
    """Offsets: for each group, the segment and the byte up to which its packets have been told."""

    def __init__(self, options: dict):
        self.log = re.sub(r"^file:/*", "/", options["log"]).rstrip("/")
        self.trim = options.get("trim", "true") == "true"
        self.told: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def groups(self) -> list[str]:
        return sorted(d for d in (os.listdir(self.log) if os.path.isdir(self.log) else ()) if re.fullmatch(r"[0-9.]+_\d+", d))

    def latestOffset(self) -> dict:
        for group in self.groups():
            folder = f"{self.log}/{group}"
            found = segments(folder)
            number, at = self.told.get(group, (min(found, default=0), 0))
            for k in [k for k in found if k >= number]:
                path, size = found[k]
                at = at if k == number else 0
                try:
                    number, at = k, whole(path, at) if size is None else size
                except FileNotFoundError:  # closed this moment; the next offset tells the rest
                    break
            self.told[group] = [number, at]
        return dict(self.told)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = sorted(end)
        first = {g: min(segments(f"{self.log}/{g}"), default=0) for g in names if g not in start}
        return [
            Stretch(*_named(g), f"{self.log}/{g}", tuple(start.get(g, (first.get(g, 0), 0))), tuple(end[g]))
            for g in names if list(start.get(g, ())) != list(end[g])
        ]

    def read(self, part: Stretch) -> Iterator[tuple]:
        for number in range(part.first[0], part.last[0] + 1):
            at = part.first[1] if number == part.first[0] else 0
            path, size = segments(part.folder)[number]
            try:
                f = open(path, "rb")
            except FileNotFoundError:  # closed this moment: under its new name
                path, size = segments(part.folder)[number]
                f = open(path, "rb")
            end = part.last[1] if number == part.last[0] else size
            with f:
                f.seek(at)
                while at < end:
                    n, k, ts, address = struct.unpack(HEAD, f.read(HEAD_SIZE))
                    yield number * SEGMENT_PACKETS + k, ts, ts % 86400, part.group, part.port, socket.inet_ntoa(address), f.read(n)
                    at += HEAD_SIZE + n

    def commit(self, end: dict) -> None:
        for group, (number, _) in end.items() if self.trim else ():
            for k, (path, size) in segments(f"{self.log}/{group}").items():
                if k < number and size is not None:
                    os.remove(path)


def _named(folder: str) -> tuple[str, int]:
    group, _, port = folder.rpartition("_")
    return group, int(port)


class UdpFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "surveillance_udp"

    def schema(self) -> str:
        return "packet_id long, ts double, recv_tod double, group_ip string, port int, source_ip string, payload binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the feed known; its workers need not find this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(UdpFeed)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
