"""Recordings through the whole batch pipeline, and packets through the recorder."""

import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from radarq.plans import pipelines
from radarq.plans.options import RecorderOptions
from radarq.sources import recording, writer

MIDNIGHT = 1_704_067_200
NORTH = bytes.fromhex("02000AD014820191C8ED")


def plot48(tod):
    return bytearray(b"\x30\x00\x09\xc0\x14\x82" + round(tod * 128).to_bytes(3, "big"))


def plot1(tod):
    body = bytes([0xC2, 0x14, 0x82, 0x20]) + (round(tod * 128) & 0xFFFF).to_bytes(2, "big")
    return bytearray(b"\x01\x00\x09" + body)


def test_latency_report(spark):
    rows, seq = [], 0
    for k in range(200):
        tod = 86_000.0 + k * 5  # goes over midnight
        for make, late in ((lambda t: bytearray(b"\x02\x00\x0a\xd0\x14\x82\x01" + round(t * 128).to_bytes(3, "big")), 0.125), (plot1, 0.25), (plot48, 0.5)):
            rows.append(("f", seq, make(tod % 86400), (tod + late) % 86400, "10.0.0.1"))
            seq += 1
    folder = tempfile.mkdtemp(prefix="spark-")
    writer.write_recording(spark.createDataFrame(rows, "source string, seq long, payload binary, recv_tod double, src_ip string"), folder, "gps1")
    out = pipelines.latency_report(spark, folder, MIDNIGHT, "north", include_last=True).collect()
    assert {r.sac_sic_cat for r in out} == {"020_130_001", "020_130_048"}
    for cat, late in (("020_130_001", 0.25), ("020_130_048", 0.5)):
        mine = [r for r in out if r.sac_sic_cat == cat]
        assert sum(r.cuenta for r in mine) == 200
        assert all(r.min == r.max == r.media == late and r.stdev == 0 for r in mine)
        assert min(r.timestamp for r in mine) == MIDNIGHT + 86_000 // 300 * 300 and max(r.timestamp for r in mine) > MIDNIGHT + 86400
    fewer = pipelines.latency_report(spark, folder, MIDNIGHT).collect()
    assert max(r.timestamp for r in fewer) < max(r.timestamp for r in out)


def test_advisories_report(spark):
    message = bytes.fromhex("30A00264D16AF0")
    block = b"\x30\x00\x13" + bytes([0xC1, 0x01, 0x01, 0x80]) + b"\x14\x82" + round(100 * 128).to_bytes(3, "big") + message
    rows = [("f", k, bytearray(block), 100.5, "10.0.0.1") for k in range(3)]
    folder = tempfile.mkdtemp(prefix="spark-")
    writer.write_recording(spark.createDataFrame(rows, "source string, seq long, payload binary, recv_tod double, src_ip string"), folder, "gps2")
    (row,) = pipelines.advisories_report(spark, folder, MIDNIGHT, "gps2").collect()
    assert (row.bds30_ara41, row.bds30_tid, row.seq) == (1, "345ABC", 2)


def packets(spark):
    rows = [(i, MIDNIGHT + 3600.0 + t, 3600.0 + t, "239.0.0.1", 5000, ip, bytearray(NORTH * 2)) for i, (t, ip) in enumerate([(0.0, "10.0.0.1"), (1.0, "10.0.0.2"), (700.0, "10.0.0.1"), (701.0, "10.9.9.9")])]
    return spark.createDataFrame(rows, "packet_id long, ts double, recv_tod double, group_ip string, port int, source_ip string, payload binary")


@pytest.mark.parametrize("scrm, blocks", [(False, 6), (True, 2)])
def test_recorder(spark, scrm, blocks):
    options = RecorderOptions.from_mapping({"source": "multicast", "mode_scrm": scrm, "dest_file_region": "north", "dest_file_format": "gps", "dest_file_extension": "gps", "radar_definition": ["a", "239.0.0.1", 5000, "10.0.0.1", "0.0.0.0", "b", "239.0.0.1", 5000, "10.0.0.2", "0.0.0.0"]})
    folder = tempfile.mkdtemp(prefix="spark-")
    counters = pipelines.recorder(packets(spark), options, folder).filter("flow is null").agg(F.sum("packets")).first()[0]
    assert counters == blocks
    names = sorted(f.removeprefix(folder + "/") for f in glob.glob(f"{folder}/**/*.gps", recursive=True))
    assert names == ["01/01/240101-north-010000.gps", "01/01/240101-north-011000.gps"]
    assert recording.read_recording(spark, [f"{folder}/{n}" for n in names], "gps1").count() == blocks


def test_compressed_recordings(spark):
    import bz2

    options = RecorderOptions.from_mapping({"dest_file_compress": True, "dest_file_nodirectory": True, "radar_definition": ["a", "239.0.0.1", 5000, "0.0.0.0", "0.0.0.0"]})
    folder = tempfile.mkdtemp(prefix="spark-")
    pipelines.recorder(packets(spark), options, folder)
    files = sorted(glob.glob(f"{folder}/*.ast.bz2"))
    assert [len(bz2.open(f).read()) for f in files] == [40, 40]


def test_options():
    with pytest.raises(ValueError):
        RecorderOptions.from_mapping({"nonsense": 1})
    with pytest.raises(ValueError):
        RecorderOptions.from_mapping({"timed": "soon"})
    with pytest.raises(ValueError):
        RecorderOptions.from_mapping({"radar_definition": ["a", "b"]})
    assert RecorderOptions.from_mapping({"source_file": "x.gps"}).recording_format == "auto"
    assert RecorderOptions.from_mapping({"source_file": "x.gps", "source_file_gps_version": 2}).recording_format == "gps2"
    assert RecorderOptions.from_mapping({"source_file": "x.ast"}).recording_format == "ast"


def test_live_rows_decode_as_recorded_ones(spark):
    df = spark.createDataFrame([("f", 0, bytearray(NORTH), 74641.9)], "source string, seq long, payload binary, recv_tod double")
    (row,) = pipelines.plots_of(df, MIDNIGHT).collect()
    assert row.delay == pytest.approx(74641.9 - 74641.8515625) and row.ts == MIDNIGHT + 74641.9
