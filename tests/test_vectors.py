"""Byte vectors of the public format, and round trips."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from radarq.functions import bits as B
from radarq.functions import clock, codes
from radarq.functions.layouts import LAYOUTS
from radarq.operators import acas, decode, header
from radarq.plans import synthetic as S


def blocks(spark, *texts, cat=None):
    rows = [(i, bytearray(bytes.fromhex(t.replace(" ", "")))) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, int(p[0]) if p else -1, p) for i, p in rows], "seq long, cat int, payload binary")
    return df if cat is None else df.withColumn("cat", F.lit(cat))


def plots(spark, *texts, **options):
    return [r.asDict() for r in decode.decode(blocks(spark, *texts), **options).orderBy("seq", "rec_index").collect()]


def has(row, **want):
    assert {k: row[k] for k in want} == want


# A few packets of this file are public sample data.
def test_service_messages(spark):
    north, marker, period, picture = plots(spark, "02 00 0A D0 14 82 01 91 C8 ED", "22 00 0A E0 14 82 01 91 C8 ED", "13 00 0A E0 14 82 02 91 C8 ED", "08 00 0B C1 80 14 82 FE 91 C8 ED")
    for row, name in ((north, "NORTH"), (marker, "NORTH"), (period, "PERIODIC"), (picture, "SOP")):
        has(row, sac=20, sic=130, tod=74641.8515625, type_name=name)
    assert plots(spark, "08 00 0B C1 80 14 82 FE 91 C8 ED", compat=True)[0]["type_name"] == "EOP"


def test_plots(spark):
    one, two = plots(spark, "01 00 12 FE 14 82 20 2B 1F FE 6C 08 2F 04 D8 12 C8 EB", "01 00 12 FE 14 82 20 3A 25 0F ED 0C 0E 03 E8 12 C9 0D")
    has(one, type_name="SSR", rho=86.2421875, theta=357.78076171875, modea=0o4057, modec=31000, responses=9, tod_trunc=401.8359375)
    has(two, rho=116.2890625, theta=22.3956298828125, modea=0o6016, modec=25000)
    (row,) = plots(spark, "30 00 1C FD C0 14 82 91 C8 ED A0 2B 1F FE 6C 08 2F 3F F8 34 5A BC 24 21 71 CB 3D 20")
    has(row, type_name="SSRS_ROLL", rho=43.12109375, theta=357.78076171875, modea=0o4057, modec=-200, modes="345ABC", aid="IBE1234")


def test_signed_coordinates(spark):
    block = "14 00 0D C8 14 82 02 FF FF F6 00 00 04"
    (row,) = plots(spark, block)
    has(row, x=-5.0, y=2.0)
    (row,) = plots(spark, block, compat=True)
    has(row, x=33554412.0)


def test_category_20_flags(spark):
    row, plain = plots(spark, "14 00 08 C0 14 82 41 94", "14 00 07 C0 14 82 40")
    has(row, type=32, type_name="MODE_S", flag_fixed=True, flag_ground=True, flag_sim=True, flag_test=False, report_flags=0b1001010)
    has(plain, type=32, flag_fixed=None, report_flags=None)


def test_two_records_and_a_track(spark):
    record = "FE 14 82 20 2B 1F FE 6C 08 2F 04 D8 12 C8 EB"
    track = "FE 14 82 A0 2B 1F FE 6C 08 2F 04 D8 12 C8 EB"
    assert [r["rec_index"] for r in plots(spark, f"01 00 21 {record} {record}")] == [0, 1]
    # nothing behind a track is read, as its layout differs
    assert [r["rec_index"] for r in plots(spark, f"01 00 30 {record} {track} {record}")] == [0]


@pytest.mark.parametrize("text", ["30", "30 00 03", "30 00 06 FF FF FF", "30 00 04 FD", "FF 00 05 80 01", "", "01 00 08 FE 14 82 20 2B"])
def test_broken_blocks_give_no_plots(spark, text):
    assert plots(spark, text) == []


def test_any_bytes_decode_without_failing(spark):
    r = random.Random(11)
    rows = []
    for i in range(3000):
        cat = r.choice(list(LAYOUTS))
        body = bytes(r.choice([0, 1, 0xFF, 0x80, r.randrange(256)]) for _ in range(r.randint(0, 60)))
        rows.append((i, cat, bytearray(bytes([cat]) + (len(body) + 3).to_bytes(2, "big") + body)))
    df = spark.createDataFrame(rows, "seq long, cat int, payload binary").repartition(3)
    found = decode.records(df).collect()
    assert found and all(x.malformed or x.behind <= len(x.payload) for x in found)
    assert all(p is None or x.first < p for x in found for p in x["at"])
    assert decode.decode(df).count() <= len(found)


def test_null_and_empty_tables(spark):
    null = spark.createDataFrame([(1, 48, None)], "seq long, cat int, payload binary")
    assert decode.decode(null).collect() == []
    assert decode.decode(null.limit(0)).collect() == []


def test_malformed_records_are_counted(spark):
    row = decode.record_counts(blocks(spark, "30 00 06 FF FF FF", "3E 00 05 80 01")).orderBy("cat").collect()
    assert [(r.cat, r.n_records, r.n_malformed, r.ignored) for r in row] == [(48, 1, 1, False), (62, 0, 0, True)]


def test_registers_last_wins_and_zero_ones_go(spark):
    registers = "04 01 01 01 01 01 01 01 10 00 00 00 00 00 00 00 17 02 02 02 02 02 02 02 10 03 03 03 03 03 03 03 20"
    n = 3 + 2 + 2 + 3 + 33
    (row,) = plots(spark, f"30 00 {n:02X} C1 20 14 82 91 C8 ED {registers}")
    assert {k: v.hex() for k, v in row["bds"].items()} == {"10": "02" * 7, "20": "03" * 7}


def advisory(spark, text):
    df = spark.createDataFrame([(bytearray(bytes.fromhex(text.replace(" ", ""))),)], "m binary")
    return df.select(*(v.alias(k) for k, v in acas.advisory(B.unsigned(F.col("m"), 1, 7)).items())).first().asDict()


def test_advisories(spark):
    # first byte of the fixture is the register's number, which the message holds as its own first byte
    has(advisory(spark, "30 A0 02 64 D1 6A F0"), ara41=1, ara42=0, ara43=1, rac55=1, rac56=0, rac58=1, rat=1, mte=0, tti=1, tid="345ABC", tida=None)
    has(advisory(spark, "30 80 00 08 D4 47 CB"), ara41=1, tti=2, tida=10000, tidr=31, tidb=11, tid=None)


def test_every_altitude_comes_back(spark):
    rows = spark.range(0, 1000, 2).select("id", *(v.alias(k) for k, v in acas.advisory(B.unsigned(S.advisory(F.col("id")), 1, 7)).items() if k == "tida"))
    assert all(r.tida == r.id % 1000 * 100 - 1200 for r in rows.collect())


def test_block_key(spark):
    raw = bytes.fromhex("02000AD014820191C8ED")
    df = spark.createDataFrame([(bytearray(raw),)], "p binary")
    assert df.select(codes.crc_key(F.col("p"))).first()[0] == "AAB796CD"


def test_block_key_of_any_bytes(spark):
    raws = [bytes([k % 256, k // 3 % 256]) * (k % 40) for k in range(120)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, p binary")
    got = {r.i: r.k for r in df.select("i", codes.crc_key(F.col("p")).alias("k")).collect()}
    want = {i: f"{zlib.crc32(len(r).to_bytes(4, 'little'), zlib.crc32(r) ^ 0xFFFFFFFF):08X}" for i, r in enumerate(raws)}
    assert got == want


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=40))
def test_numbers_come_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    back = df.select("v", B.unsigned(B.be(F.col("v"), 4), 1, 4).alias("be"), B.unsigned_le(B.le(F.col("v"), 4), 1, 4).alias("le")).collect()
    assert all(r.v == r.be == r.le for r in back)


def test_mode_c_turning_point(spark):
    df = spark.createDataFrame([(8191,), (8192,), (8193,), (16383,)], "v int")
    assert [r[0] for r in df.select(codes.mode_c_feet(F.col("v"))).collect()] == [204775, -204800, -204775, -25]
    assert df.select(codes.mode_c_feet(F.col("v"), compat=True)).collect()[1][0] == 204800


def test_delay_over_midnight(spark):
    df = spark.createDataFrame([(0.671875, 86399.890625), (86399.5, 0.5), (10.0, 12.0)], "tod double, stamp double")
    assert [r[0] for r in df.select(clock.delay(F.col("stamp"), F.col("tod"))).collect()] == [-0.78125, 1.0, 2.0]


def test_header(spark):
    rows = header.with_header(blocks(spark, "01 00 12 FE 14 82 20 2B 1F FE 6C 08 2F 04 D8 12 C8 EB", "30 00 05 40 01", "").drop("cat")).orderBy("seq").collect()
    assert [(r.cat, r.len, r.sac, r.sic) for r in rows] == [(1, 18, 20, 130), (48, 5, None, None), (None, None, None, None)]


def test_time_text(spark):
    df = spark.createDataFrame([(0.0,), (86399.9999,), (3661.25,)], "t double")
    assert [r[0] for r in df.select(codes.time_text(F.col("t"))).collect()] == ["00:00:00.000", "23:59:59.999", "01:01:01.250"]
