"""Message streams made from the star-schema tables, so that queries run over whole tables of any size.

Every value comes from integers of a row, so another engine can tell what a query must return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import clock

DAY128 = 86400 * 128
CATS = {"click": 1, "view": 48, "purchase": 10, "signup": 20, "error": 34}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Table = Callable[[SparkSession, str, str], DataFrame]


def plots(spark: SparkSession, sf_dir: str, table: Table = table) -> DataFrame:
    """Events as timed plots of 21 sensors: seq, us, ts, sac, sic, cat, tod_stamp, tod, and what a plot carries."""
    e = table(spark, sf_dir, "events")
    us = clock.micros_of(F.col("ts"))
    e = e.select(F.col("event_id").alias("seq"), us.alias("us"), "user_id", "event_type", "value")
    cat = F.lit(None).cast("int")
    for name, c in CATS.items():
        cat = F.when(F.col("event_type") == name, c).otherwise(cat)
    stamp = F.floor(F.pmod(F.col("us"), F.lit(86_400_000_000)) * 128 / 1_000_000).cast("long")
    late = F.pmod(F.floor(F.col("value") * 128).cast("long"), F.lit(1280)) - 128
    e = e.withColumns({"_stamp": stamp, "_late": late})
    n = F.col("seq")
    return e.select(
        "seq", "us", (F.col("us") / 1_000_000.0).alias("ts"), (F.col("user_id") % 3 + 1).cast("int").alias("sac"), (F.col("user_id") % 7 + 1).cast("int").alias("sic"), cat.alias("cat"),
        (F.col("_stamp") / 128.0).alias("tod_stamp"), (F.pmod(F.col("_stamp") - F.col("_late"), F.lit(DAY128)) / 128.0).alias("tod"),
        (n * 7919 % 65536 * 360.0 / 65536.0).alias("theta"), (n * 104729 % 65536 / 128.0).alias("rho"), (n % 4096).cast("int").alias("modea"), (n % 50 == 0).alias("flag_test"),
        (n * 17 % 900 + 40).alias("n_bytes"),
    )


def b(value: Column | int, n: int = 1) -> Column:
    return B.be(F.lit(value) if isinstance(value, int) else value, n)


def block(cat: int, *parts: Column) -> Column:
    """A whole block around parts of its records."""
    body = F.concat(*parts)
    return F.concat(b(cat), b(F.length(body) + 3, 2), body)


def six_bit_call_sign(number: Column) -> Column:
    """IB and five digits as six bytes."""
    digits = [F.floor(number / 10**k) % 10 + 48 for k in (4, 3, 2, 1, 0)]
    value = F.lit(0).cast("long")
    for code in (F.lit(9), F.lit(2), *digits, F.lit(32)):
        value = value * 64 + code
    return b(value, 6)


def gray(value: Column) -> Column:
    return value.bitwiseXOR(F.shiftright(value, 1))


def advisory(n: Column) -> Column:
    """A seven-byte advisory from a number: odd ones tell an address, even ones an altitude, range and bearing."""
    hundreds = n % 1000  # altitude in hundreds of feet, from -1200
    fives, ones = F.floor(hundreds / 5).cast("long"), hundreds % 5
    ones = F.when(fives % 2 == 1, 4 - ones).otherwise(ones)
    c = F.element_at(F.array(*map(F.lit, (1, 3, 2, 6, 4))), (ones + 1).cast("int")).cast("long")
    g = gray(fives)  # D1 D2 D4 A1 A2 A4 B1 B2 B4
    of = lambda value, k: B.field(value, k, 1)
    d1, d2, d4, a1, a2, a4, b1, b2, b4 = (of(g, k) for k in range(8, -1, -1))
    c1, c2, c4 = (of(c, k) for k in (2, 1, 0))
    head = F.lit(0).cast("long")
    for x in (c1, a1, c2, a2, c4, a4, F.lit(0), b1, d1, b2, d2, b4, d4):
        head = head * 2 + x
    threat = F.when(n % 2 == 1, (n * 7919 % 16777216) * 4).otherwise((head * 128 + n % 128) * 64 + n % 64)
    tti = F.when(n % 2 == 1, 1).otherwise(2)
    fourth = n % 16 * 16 + tti * 4 + F.shiftright(threat, 24)
    return F.concat(b(0x30), b(n % 128 * 2), b(n % 4), b(fourth), b(threat.bitwiseAND(F.lit(0xFFFFFF)), 3))


def blocks(spark: SparkSession, sf_dir: str, cat: int) -> DataFrame:
    """(source, seq, cat, payload): one block of the category for each event."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id")
    n, sac, sic = F.col("seq"), F.col("user_id") % 3 + 1, F.col("user_id") % 7 + 1
    sensor, time = F.concat(b(sac), b(sic)), b(n * 331 % DAY128, 3)
    if cat in (2, 34):
        payload = block(cat, b(0xD0 if cat == 2 else 0xE0), sensor, b(n % 2 + 1), time)
    elif cat == 8:
        payload = block(8, b(0xC1), b(0x80), sensor, b(254 + n % 2), time)
    elif cat == 19:
        payload = block(19, b(0xE0), sensor, b(n % 3 + 1), time)
    elif cat == 1:
        payload = block(1, b(0xFE), sensor, b(n % 4 * 16 + n % 2 * 2), b(n * 104729 % 65536, 2), b(n * 7919 % 65536, 2), b(n * 13 % 65536, 2), b(n * 29 % 16384, 2), b(n % 127 * 2), b(n * 331 % 65536, 2))
    elif cat == 10:
        payload = block(10, b(0xF5), b(0x30), sensor, b(1), b(n % 8 * 32 + n % 2 * 8), time, b(n * 104729 % 65536, 2), b(n * 7919 % 65536, 2), b(F.col("user_id") % 4096, 2), b(F.when(n % 5 == 0, 64).otherwise(0)))
    elif cat == 20:
        signed = lambda v: b(v.bitwiseAND(F.lit(0xFFFFFF)), 3)
        # three presence bytes: 010 020 140 042 | - | 400, whose count is followed by so many bytes
        payload = block(20, b(0xE9), b(0x01), b(0x04), sensor, b(F.element_at(F.array(*(F.lit(2 << k) for k in range(7))), (n % 7 + 1).cast("int"))), time, signed(n * 911 % 2000000 - 1000000), signed(500000 - n * 577 % 1000000), b(n % 3 + 1), F.substring(F.lit(bytearray(3)), F.lit(1), (n % 3 + 1).cast("int")))
    elif cat == 21:
        payload = block(21, b(0xE0), sensor, b(n % 2 * 0x40 + n % 3 % 2 * 0x20 + n % 5 % 2 * 0x10 + n % 7 % 2 * 0x08), b(0), time)
    elif cat == 48:
        record = lambda k: (
            b(0xFD), b(0xF1), b(0x03), b(0x80), sensor, time, b((n + k) % 8 * 32), b(n * 104729 % 65536, 2), b(n * 7919 % 65536, 2), b((n + k) * 13 % 65536, 2), b(n * 29 % 16384, 2), b((n * 2654435 + k) % 16777216, 3), six_bit_call_sign(n % 100000),
            b(1), b(n * 331 + 1, 7), b(0x10), b(n % 4096, 2), b(n % 8 * 1024 + n % 8 * 8192 + n % 2 * 512 + n % 16, 2), advisory(n + k),
        )
        payload = block(48, *record(0), *record(1))
    else:
        raise ValueError(f"no blocks of category {cat}")
    return e.select(F.lit("events").alias("source"), "seq", F.lit(cat).alias("cat"), payload.alias("payload"))
