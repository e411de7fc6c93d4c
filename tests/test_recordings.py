"""Recordings written and read again, in each format; live feeds."""

import os
import random
import socket
import struct
import subprocess
import sys
import tempfile
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarq.sources import ranges, recording, udp, writer

NORTH, PLOT = bytes.fromhex("02000AD014820191C8ED"), bytes.fromhex("010012FE1482202B1FFE6C082F04D812C8EB")


def blocks(spark):
    rows = [("f", 0, bytearray(NORTH), 74641.8515625, "10.181.210.17"), ("f", 1, bytearray(PLOT), 74642.0, "10.181.210.18")]
    return spark.createDataFrame(rows, "source string, seq long, payload binary, recv_tod double, src_ip string")


@pytest.mark.parametrize("format", ["ast", "gps1", "gps2", "era"])
def test_round_trip(spark, format):
    folder = tempfile.mkdtemp(prefix="spark-")
    writer.write_recording(blocks(spark), folder, format, midnight=1_704_067_200)
    back = recording.read_recording(spark, folder, format).orderBy("seq").collect()
    assert [bytes(r.payload) for r in back] == [NORTH, PLOT]
    assert [(r.cat, r.len, r.sac, r.sic) for r in back] == [(2, 10, 20, 130), (1, 18, 20, 130)]
    times = {"ast": [None, None], "gps1": [74641.8515625, 74642.0], "gps2": [74641.851, 74642.0], "era": [74641.0, 74642.0]}[format]
    assert [r.recv_tod for r in back] == times
    if format == "gps1":
        assert [r.src_ip for r in back] == ["10.181.210.17", "10.181.210.18"]


@pytest.mark.parametrize("format", ["gps1", "gps2"])
def test_detection(spark, format):
    folder = tempfile.mkdtemp(prefix="spark-")
    many = blocks(spark).union(blocks(spark).withColumn("seq", F.col("seq") + 2))
    writer.write_recording(many, folder, format)
    assert recording.read_recording(spark, folder).count() == 4


def test_trailers(spark):
    row = blocks(spark).filter("seq = 0").select(F.hex(writer.trailer_v1(F.col("payload"), F.col("recv_tod"), F.col("src_ip"))), F.hex(writer.trailer_v2(F.col("recv_tod"))), F.hex(writer.header_era(F.col("payload"), F.lit(1_704_067_200 + 74641)))).first()
    assert tuple(row) == ("11D2B50A000A91C8EDCD", "BBF17204", "38000E0011249365")


def file_of(raw: bytes) -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/one.rec", "wb") as f:
        f.write(raw)
    return folder


def test_hensoldt_and_own_framing(spark):
    framed = lambda p: (len(p) + 12).to_bytes(4, "big") + bytes(8) + p
    back = recording.read_recording(spark, file_of(framed(NORTH) + framed(PLOT)), "hensoldt").orderBy("seq").collect()
    assert [bytes(r.payload) for r in back] == [NORTH, PLOT]
    own = recording.Framing(header=5, before=2, behind=3)
    back = recording.read_recording(spark, file_of(b"HEADR" + b"ab" + NORTH + b"xyz" + b"cd" + PLOT + b"xyz"), framing=own).orderBy("seq").collect()
    assert [(bytes(r.payload), bytes(r.trailer)) for r in back] == [(NORTH, b"abxyz"), (PLOT, b"cdxyz")]


def test_empty_and_cut_files(spark):
    assert recording.read_recording(spark, file_of(b""), "ast").count() == 0
    assert recording.read_recording(spark, file_of(NORTH + PLOT[:7]), "ast").count() == 1
    assert recording.read_recording(spark, file_of(b"\x30\x00\x00" * 4), "ast").count() == 0
    with pytest.raises(ValueError):
        recording.read_recording(spark, file_of(b""), "nonsense")


def serial(raw: bytes, f: recording.Framing):
    """(place, payload) of frames, one after the other."""
    at, out = f.header, []
    while at + f.before + 3 <= len(raw):
        start = at + f.before
        size = int.from_bytes(raw[at : at + 4], "big") - f.before if f.length == "hensoldt" else int.from_bytes(raw[start + 1 : start + 3], "big")
        if not 3 <= size <= 65535 or start + size + f.behind > len(raw):
            break
        out.append((at, raw[start : start + size]))
        at = start + size + f.behind
    return out


def recorded(kind, n=400, seed=1, damage=None):
    """A recording of n blocks of mixed lengths, full of bytes that look like lengths."""
    r = random.Random(seed)
    f = recording.FRAMINGS[kind]
    raw = bytes([recording.FILLER]) * f.header
    for i in range(n):
        size = r.choice((3, 10, 18, 48, 48, 48, 300)) if i % 97 else 20_000
        payload = bytes([r.choice((1, 2, 34, 48)), size >> 8, size & 255]) + bytes(r.choice((0, 0, 0, 3, 48, 128, 255)) for _ in range(size - 3))
        front = (size + 12).to_bytes(4, "big") + bytes(8) if kind == "hensoldt" else bytes(r.randrange(256) for _ in range(f.before))
        raw += front + payload + bytes(r.randrange(256) for _ in range(f.behind))
        if i == damage:
            raw += b"\0" * 7
    return raw + b"\x30"


@pytest.mark.parametrize("kind", ["ast", "gps1", "gps2", "hensoldt", "era"])
@pytest.mark.parametrize("damage", [None, 250])
def test_ranges_frame_as_the_serial_walk(spark, kind, damage):
    raw = recorded(kind, damage=damage)
    want = serial(raw, recording.FRAMINGS[kind])
    assert len(want) == 400 if damage is None else len(want) >= 251
    for n in (8, 37):
        back = recording.read_recording(spark, file_of(raw), kind, range_bytes=-(-len(raw) // n)).select("seq", "payload").orderBy("seq").collect()
        assert [(r.seq, bytes(r.payload)) for r in back] == [(i, p) for i, (_, p) in enumerate(want)]


@pytest.mark.parametrize("kind", ["ast", "gps1", "gps2", "hensoldt", "era"])
@pytest.mark.parametrize("damage", [None, 250])
def test_stretches_of_ranges(spark, kind, damage):
    """Stretches of one, two and nine ranges, each with its entry in the index, and ranges shorter than blocks."""
    raw = recorded(kind, damage=damage)
    want = [(i, p) for i, (_, p) in enumerate(serial(raw, recording.FRAMINGS[kind]))]
    for size, index in ((9000, 1), (9000, 18_000), (1000, 9000), (len(raw) // 3, len(raw) // 3)):
        back = recording.read_recording(spark, file_of(raw), kind, range_bytes=size, index_bytes=index).select("seq", "payload").orderBy("seq").collect()
        assert [(r.seq, bytes(r.payload)) for r in back] == want


def test_short_ranges_share_tasks(spark):
    """A range of its own task costs more than it reads."""
    raw, read = recorded("gps1", 3000), lambda size: recording.read_recording(spark, folder, "gps1", light=True, range_bytes=size)
    folder = file_of(raw)
    assert len(raw) > ranges.INDEX_BYTES
    short = read(200)
    assert short.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, read(1 << 26).collect()))
    assert -(-len(raw) // 200) > 1000


def test_range_maps_of_every_entry():
    for kind in ("ast", "gps1", "hensoldt"):
        raw, f = recorded(kind, 60, seed=5), recording.FRAMINGS[kind]
        start, end = len(raw) // 3, 2 * len(raw) // 3
        chain = ranges.Chain(raw[start:], start, len(raw), f.before, f.behind, f.length == "hensoldt")
        entries = np.arange(start, len(raw))
        for region in (1 << 17, 512):
            ranges.REGION, kept = region, ranges.REGION
            try:
                which, frames, leaves = ranges.range_map(chain, start, end, entries)
            finally:
                ranges.REGION = kept
            for e, w, n in zip(entries.tolist()[::7], which.tolist()[::7], frames.tolist()[::7]):
                found, leave = ranges.Chain(raw, 0, len(raw), f.before, f.behind, f.length == "hensoldt").walk(e, end)
                assert (leaves[w], n) == (leave, len(found))


def test_categories_and_light_view(spark):
    folder = file_of(recorded("gps1", 300, seed=3))
    whole = recording.read_recording(spark, folder)
    columns = [c.split()[0] for c in recording.LIGHT.split(", ")]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()), key=lambda r: r[1])
    assert rows(recording.read_recording(spark, folder, light=True, range_bytes=9000)) == rows(whole)
    some = recording.read_recording(spark, folder, categories=(48, 2), range_bytes=9000)
    assert rows(some) == rows(whole.filter("cat IN (48, 2)"))


def test_one_file_of_more_than_two_gigabytes(spark):
    """A sparse file of blocks of the longest size behind a thousand short ones."""
    folder = tempfile.mkdtemp(prefix="spark-")
    n, small = 34_000, 1_000
    with open(f"{folder}/long.ast", "wb") as f:
        f.write(NORTH * small)
        for i in range(n):
            f.seek(len(NORTH) * small + i * 65535)
            f.write(bytes([48, 255, 255]))
        f.truncate(len(NORTH) * small + n * 65535)
        assert f.tell() > 0 and os.path.getsize(f"{folder}/long.ast") > 2 << 30
    back = recording.read_recording(spark, folder, "ast", light=True).agg(F.count("*"), F.max("seq"), F.countDistinct("seq"), F.sum("len")).first()
    assert tuple(back) == (n + small, n + small - 1, n + small, n * 65535 + small * len(NORTH))
    os.remove(f"{folder}/long.ast")


def test_replies_by_ranges(spark):
    raw = bytes(random.Random(2).randrange(256) for _ in range(72 * 500 + 11))
    back = recording.read_replies(spark, file_of(raw), range_bytes=1000).orderBy("seq").collect()
    assert [(r.seq, bytes(r.payload)) for r in back] == [(i, raw[72 * i : 72 * i + 72]) for i in range(500)]


def test_raw_replies(spark):
    back = recording.read_replies(spark, file_of(bytes(range(72)) * 3 + b"cut"), limit=2).orderBy("seq").collect()
    assert [(r.seq, bytes(r.payload)) for r in back] == [(0, bytes(range(72))), (1, bytes(range(72)))]
    assert recording.read_replies(spark, file_of(b"")).count() == 0


def test_serial_clock(spark):
    df = spark.createDataFrame([("XGU240305070809",), ("nonsense",), (None,)], "line string")
    assert [str(r[0]) for r in df.select(recording.gps_clock()).collect()] == ["2024-03-05 07:08:09", "None", "None"]


def free_port():
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    return port


def send_until(port, payloads, log, wanted):
    """Send packets until so many have landed; a packet may come before its receiver."""
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for k in range(600):
        out.sendto(payloads[k % len(payloads)], ("127.0.0.1", port))
        time.sleep(0.02)
        if landed(log, port) >= wanted:
            return
    raise TimeoutError


def landed(log, port):
    n = 0
    for path, size in udp.segments(udp.folder_of(log, "127.0.0.1", port)).values():
        with open(path, "rb") as f:
            raw = f.read(udp.whole(path) if size is None else size)
        at = 0
        while at < len(raw):
            at += udp.HEAD_SIZE + struct.unpack_from(udp.HEAD, raw, at)[0]
            n += 1
    return n


def test_live_feed_survives_what_fails_in_between(spark, monkeypatch):
    """Two groups; a batch that fails after it was read, a driver that starts anew, receivers that start anew."""
    log, state, out = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    udp.register(spark)
    ports = free_port(), free_port()
    stream = lambda: spark.readStream.format("surveillance_udp").option("log", log).load()
    fail = [True]

    def take(batch, number):
        rows = batch.collect()
        if fail[0] and rows:
            raise RuntimeError("lost between read and commit")
        if rows:
            batch.sparkSession.createDataFrame(rows, batch.schema).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    def run():
        stream().writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for k in range(2):  # receivers twice, the second behind what the first has landed
        feed = udp.land(spark, [("127.0.0.1", p) for p in ports], log, seconds=120)
        for p in ports:
            send_until(p, [NORTH, PLOT], log, 30 * (k + 1))
        counts = feed.stop()
        assert all(n >= 30 for n in counts.values()) and set(counts) == {("127.0.0.1", p) for p in ports}
        if k == 0:
            with pytest.raises(Exception, match="lost between"):
                run()
            fail[0] = False
        run()
    sent = {p: landed(log, p) for p in ports}
    rows = spark.read.parquet(f"{out}/batch-*").collect()
    assert len({(r.port, r.packet_id) for r in rows}) == len(rows) and {bytes(r.payload) for r in rows} == {NORTH, PLOT}
    assert {r.source_ip for r in rows} == {"127.0.0.1"} and all(abs(r.ts % 86400 - r.recv_tod) < 1e-6 for r in rows)
    for p in ports:  # the first receivers' segment is trimmed by now
        assert sum(r.port == p for r in rows) >= 60 and sent[p] >= 30


def test_a_killed_receiver_loses_nothing_that_landed():
    log, port = tempfile.mkdtemp(prefix="spark-"), free_port()
    script = f"import sys; sys.path.insert(0, {os.getcwd()!r}); from radarq.sources import udp; udp.receive('127.0.0.1', {port}, {log!r}, lambda: False)"
    folder = udp.folder_of(log, "127.0.0.1", port)
    first = subprocess.Popen([sys.executable, "-c", script])
    send_until(port, [NORTH], log, 40)
    first.kill()
    first.wait()
    n = landed(log, port)
    (path, size), = udp.segments(folder).values()
    assert size is None
    with open(path, "ab") as f:  # a packet cut off
        f.write(struct.pack(udp.HEAD, 100, n, 0.0, b"\0" * 4) + b"abc")
    second = subprocess.Popen([sys.executable, "-c", script])
    send_until(port, [PLOT], log, n + 40)
    second.kill()
    second.wait()
    reader = udp._Reader({"log": log})
    end = reader.latestOffset()
    rows = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert len(rows) == landed(log, port) >= n + 40 and len({r[0] for r in rows}) == len(rows)
    assert [r[-1] for r in rows] == [NORTH] * n + [PLOT] * (len(rows) - n)
    assert reader.partitions(end, reader.latestOffset()) == []
    middle = {g: [0, udp.HEAD_SIZE + len(NORTH)] for g in end}
    assert [r for p in reader.partitions(middle, end) for r in reader.read(p)] == rows[1:]
    reader.commit(end)
    assert list(udp.segments(folder)) == [1]


def test_receivers_roll_and_take_over(monkeypatch):
    monkeypatch.setattr(udp, "SEGMENT_PACKETS", 7)
    log, port, stop = tempfile.mkdtemp(prefix="spark-"), free_port(), []
    counts = []
    run = lambda: counts.append(udp.receive("127.0.0.1", port, log, lambda: bool(stop), idle=0.2))
    one = threading.Thread(target=run)
    one.start()
    send_until(port, [NORTH], log, 30)
    two = threading.Thread(target=run)
    two.start()
    one.join(20)  # the first ends when it sees that its segment is closed
    assert not one.is_alive()
    before = landed(log, port)
    send_until(port, [NORTH], log, before + 10)
    stop.append(1)
    two.join(20)
    sizes = udp.segments(udp.folder_of(log, "127.0.0.1", port))
    assert len(sizes) >= 6 and all(size is not None for _, size in sizes.values()) and landed(log, port) <= sum(counts)


def files_below(folder):
    return sorted(os.path.relpath(f"{d}/{n}", folder) for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc"))


def test_no_blocks_no_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    writer.write_recording(blocks(spark).limit(0), folder)
    assert files_below(folder) == []


def test_failed_tasks_leave_no_file(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    bad = blocks(spark).withColumn("source", F.when(F.col("seq") == 0, "aa/first.ast").otherwise("../outside.ast"))
    with pytest.raises(Exception, match="not a file name"):
        writer.write_recording(bad, folder, named=True)
    assert files_below(folder) == [] and not os.path.exists(f"{os.path.dirname(folder)}/outside.ast")


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_lost_driver_leaves_a_commit_to_end(spark, monkeypatch, moved):
    folder = tempfile.mkdtemp(prefix="spark-")
    two = blocks(spark).withColumn("source", F.concat(F.lit("d/part-"), "seq"))
    move, done = writer.Store.move, []

    def lost(self, *names):
        if len(done) == moved:
            raise KeyboardInterrupt
        done.append(names)
        move(self, *names)

    monkeypatch.setattr(writer.Store, "move", lost)
    if moved < 2:
        with pytest.raises(KeyboardInterrupt):
            writer.write_recording(two, folder, named=True)
    else:
        monkeypatch.setattr(writer.Store, "delete", lambda self, name: (_ for _ in ()).throw(KeyboardInterrupt) if name.startswith("_") else None)
        with pytest.raises(KeyboardInterrupt):
            writer.write_recording(two, folder, named=True)
    monkeypatch.undo()
    assert writer.recover(spark, folder) == 1 and writer.recover(spark, folder) == 0
    assert files_below(folder) == ["d/part-0", "d/part-1"]
    back = recording.read_recording(spark, f"{folder}/d", "ast").collect()
    assert sorted(bytes(r.payload) for r in back) == sorted([NORTH, PLOT])


def test_another_file_system(spark):
    """Through a mount table: no local path is ever named."""
    behind = tempfile.mkdtemp(prefix="spark-")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sink.link./store", f"file://{behind}")
    folder = "viewfs://sink/store/recordings"
    many = blocks(spark).union(blocks(spark).withColumn("seq", F.col("seq") + 2))
    writer.write_recording(many, folder, "gps1", compression="none")
    writer.write_recording(many, folder, "gps1")
    assert len(files_below(behind)) == 2 and all(f.startswith("recordings/") for f in files_below(behind))
    back = recording.read_recording(spark, folder, "gps1").select("payload", "recv_tod", "src_ip").collect()
    assert len(back) == 8 and {bytes(r.payload) for r in back} == {NORTH, PLOT} and {r.src_ip for r in back} == {"10.181.210.17", "10.181.210.18"}


def test_named_files_are_replaced(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for n in (2, 1):
        writer.write_recording(blocks(spark).limit(n).withColumn("source", F.lit("2024/one.ast")), folder, named=True, compression="bzip2")
    assert files_below(folder) == ["2024/one.ast.bz2"]
    import bz2

    assert len(bz2.open(f"{folder}/2024/one.ast.bz2").read()) in (len(NORTH), len(PLOT))
