"""Behaviour at boundaries: filters, merging, duplicates, truncated times, windows, replies."""

import random

import pytest
from pyspark.sql import functions as F

from radarq.operators import acas, admission, dedup, filters, output, replies, stats, timing, transcode


def sensors(spark):
    return spark.createDataFrame([(1, 20, 130), (2, 20, 131), (3, None, None)], "seq long, sac int, sic int")


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_sensor_filters(spark):
    rows = sensors(spark)
    assert seqs(filters.sensor(rows, 20, 130)) == [1]
    assert seqs(filters.sensor(rows, 20, 130, drop=True)) == [2, 3]
    assert seqs(filters.sensor_signed(rows, (-20, -130))) == [2]
    assert seqs(filters.sensor_signed(rows, (20, 130), (20, 131))) == [1, 2]


def test_capabilities_of_the_last_record_of_a_block(spark):
    rows = [(1, 0, "00AB01", 1), (1, 1, "00AB01", 2), (0, 1, "00AB01", 3), (1, 1, "00CD01", 4), (1, 0, "00CD01", 5), (1, 0, "01AB01", 6), (1, 1, "01AB01", None)]
    for told in (rows, rows[::-1]):
        plots = spark.createDataFrame(told, "seq long, rec_index int, modes string, com int").coalesce(1)
        assert {r.modes: r.com for r in acas.latest_capabilities(plots).collect()} == {"00AB01": 2, "00CD01": 4, "01AB01": 6}


def test_time_of_day(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([86350.0, 10.0, 600.0, 659.5, 700.0, 20.0])], "source string, seq long, recv_tod double")
    times = lambda df: sorted(r.recv_tod for r in df.collect())
    assert times(filters.time_of_day(rows, "00:00", "00:10")) == [10.0, 20.0, 600.0, 659.5]
    assert times(filters.time_of_day(rows, "00:00", "00:10", compat=True)) == [10.0, 600.0]
    assert times(filters.time_of_day(rows, "23:59", "00:00")) == [10.0, 20.0, 86350.0]
    assert times(filters.time_of_day(rows, "23:59", "00:00", compat=True)) == []


def test_ground_records_go(spark):
    record = lambda stat: bytes([0xC1, 0x01, 0x02, 20, 130, 0, 0, 1, stat << 2, 0])
    frame = lambda *s: bytearray(bytes([48, 0, 3 + 10 * len(s)]) + b"".join(record(x) for x in s))
    rows = spark.createDataFrame([("a", 1, 48, frame(0, 1, 3), "x"), ("a", 2, 48, frame(1), "y"), ("a", 3, 34, bytearray(b"\x22\0\3"), "z")], "source string, seq long, cat int, payload binary, note string")
    out = {r.seq: (bytes(r.payload), r.note) for r in filters.drop_ground(rows).collect()}
    assert out == {1: (bytes(frame(0)), "x"), 3: (b"\x22\0\3", "z")}


def test_merge(spark):
    make = lambda *t: spark.createDataFrame(list(enumerate(t)), "seq long, recv_tod double")
    out = timing.merge_recordings(make(1.0, 3.0), make(1.0, 2.0)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.source, r.recv_tod) for r in out] == [(1, 2, 1.0), (2, 1, 1.0), (3, 2, 2.0), (4, 1, 3.0)]
    over = timing.merge_recordings(make(86399.0, 1.0), make(86399.5)).orderBy("ordinal").collect()
    assert [r.abs_tod for r in over] == [86399.0, 86399.5, 86401.0]


def test_days_over_slots(spark):
    """Turns between, inside and over slots without times, against one pass in order."""
    r = random.Random(5)
    rows, t = [], 86000.0
    for i in range(300):
        t = (t + r.choice([1.0, 700.0, 9000.0])) % 86400
        rows.append(("ab"[i % 2], i, None if r.random() < 0.3 or 40 < i < 60 else t))
    df = spark.createDataFrame(rows, "source string, seq long, recv_tod double")
    want = {}
    for s in "ab":
        day, last = 0, None
        for _, i, x in (x for x in rows if x[0] == s):
            if x is not None:
                day += 0 if last is None else (last - x > 80000) - (x - last > 80000)
                last = x
            want[i] = day
    for slot in (1, 7, 1 << 16):
        assert {x.seq: x.day for x in timing.unwrap_days(df, slot=slot).collect()} == want


def test_duplicates(spark):
    rows = spark.createDataFrame([(i, t, bytearray(p)) for i, (t, p) in enumerate([(0.0, b"x"), (3.0, b"x"), (4.0, b"x"), (4.5, b"x"), (6.0, b"x"), (1.0, b"y")])], "seq long, ts double, payload binary")
    assert sorted((r.ts, bytes(r.payload)) for r in dedup.drop_duplicates(rows).collect()) == [(0.0, b"x"), (1.0, b"y"), (4.5, b"x")]
    nulls = spark.createDataFrame([(1, None, bytearray(b"x")), (2, 1.0, None), (3, 1.0, None)], "seq long, ts double, payload binary")
    assert seqs(dedup.drop_duplicates(nulls)) == [1, 2, 3]
    assert dedup.drop_duplicates(rows.limit(0)).collect() == []


def test_duplicates_equal_a_plain_loop(spark):
    r = random.Random(3)
    rows = sorted((round(r.random() * 200, 1), r.choice("abcde")) for _ in range(600))
    rows = [(i, t, bytearray(k.encode())) for i, (t, k) in enumerate(rows)]
    kept, last = [], {}
    for i, t, k in rows:
        if bytes(k) not in last or t - last[bytes(k)] > 4:
            last[bytes(k)] = t
            kept.append(i)
    assert seqs(dedup.drop_duplicates(spark.createDataFrame(rows, "seq long, ts double, payload binary"))) == kept


@pytest.mark.parametrize(
    "mark, last, plot, want",
    [(0x330007, 29, 0xFFED, 0x32FFED), (0x000005, None, 0xBFE8, 0xA8BFE8), (0x2A1C0F, None, 0xFFC3, None), (0x91C8ED, None, 0xC8EB, 0x91C8EB), (0xA8BFF0, None, 0x0005, 0x000005)],
)
def test_truncated_times(spark, mark, last, plot, want):
    rows = [(0, 20, 130, 2, mark / 128, None)] + ([(1, 20, 130, 1, None, last / 128)] if last is not None else []) + [(2, 20, 130, 1, None, plot / 128)]
    out = timing.full_times(spark.createDataFrame(rows, "seq long, sac int, sic int, cat int, tod double, tod_trunc double"))
    assert out.filter("seq = 2").first().tod_full == (None if want is None else want / 128)


def test_truncated_times_need_a_full_one(spark):
    rows = spark.createDataFrame([(0, 20, 130, 1, None, 1.0), (1, 0, 5, 2, 100.0, None), (2, 0, 5, 1, None, 100.5)], "seq long, sac int, sic int, cat int, tod double, tod_trunc double")
    out = lambda **o: {r.seq: r.tod_full for r in timing.full_times(rows, **o).collect()}
    assert out() == {0: None, 1: 100.0, 2: 100.5}
    assert out(compat=True) == {0: None, 1: 100.0, 2: None}


def plain_full_times(rows):
    """One sensor's rows (cat, tod, tod_trunc), in 1/128 s, one after the other."""
    high, p, out = None, None, []
    for cat, tod, q in rows:
        if cat in (2, 19) and tod is not None:
            high, p = divmod(tod, 65536)
            out.append(tod)
        elif cat == 1 and q is not None:
            full = None
            if high is not None:
                d = abs(q - p)
                if d <= 10240:
                    full, p = high * 65536 + q, q
                elif 0xB800 < d <= 0xC000 and high in (0, 0xA8):
                    full = (0xA8 - high) * 65536 + q
                elif d > 0xF800:
                    full = (high + (-1 if q > p else 1)) * 65536 + q
            out.append(full)
        else:
            out.append(tod)
    return out


@pytest.mark.parametrize("slot", [1, 3, 40, 65536])
def test_truncated_times_by_slots(spark, slot):
    r = random.Random(slot)
    rows, want, seq = [], {}, 0
    for sac in range(5):
        walk, told = r.randrange(1 << 23), []
        for _ in range(120):
            walk = (walk + r.choice((5, 300, 4000, 9000))) % (86400 * 128)
            kind = r.random()
            q = (walk + r.choice((0, 0, 0, -8000, 12_000, 40_000))) % 65536
            told.append((r.choice((2, 19)), walk, None) if kind < (0.06, 0, 0.5, 0.02, 0.01)[sac] else (1, None, q) if kind < 0.95 else (r.choice((1, 48)), None if kind < 0.97 else walk, None))
        for (cat, tod, q), full in zip(told, plain_full_times(told)):
            seq += r.randint(1, 3)
            rows.append((seq, sac if sac < 4 else None, 1, cat, None if tod is None else tod / 128, None if q is None else q / 128))
            want[seq] = None if full is None else full / 128
    df = spark.createDataFrame(rows, "seq long, sac int, sic int, cat int, tod double, tod_trunc double").repartition(3)
    out = timing.full_times(df, slot=slot)
    assert {x.seq: x.tod_full for x in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString() and "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_what_plots_do_to_a_time_that_enters():
    r = random.Random(7)
    for n in (0, 1, 2, 5, 40):
        qs = [r.randrange(65536) for _ in range(n)]
        track = timing.Track()
        for q in qs:
            track.plot(q)
        pieces = track.pieces()
        assert len(track.values) <= 7
        for p in range(0, 65536, 37):
            want = p
            for q in qs:
                want = q if abs(q - want) <= 10240 else want
            assert timing.through(p, pieces) == want


@pytest.mark.parametrize(
    "mark, plot, want",
    [(0x2A1C0F, 0xFFC3, 0x29FFC3), (0x2AFFC0, 0x1C00, 0x2B1C00), (0x2AFFC0, 0x2900, None), (0xA8BFF0, 0x1000, 0x001000), (0x001000, 0xBFE8, 0xA8BFE8), (0xA8BFD8, 0xFFEC, -20), (0x330007, 0xFFED, 0x32FFED), (0x100000, 0x5000, None)],
)
def test_wide_truncated_times(spark, mark, plot, want):
    """What is past a wrap or a day's turn may be as far from the last time as what is not."""
    rows = [(0, 20, 130, 2, mark / 128, None), (1, 20, 130, 1, None, plot / 128)]
    df = spark.createDataFrame(rows, "seq long, sac int, sic int, cat int, tod double, tod_trunc double")
    for slot in (1, 65536):
        assert timing.full_times(df, slot=slot, wide=True).filter("seq = 1").first().tod_full == (None if want is None else want / 128)


def test_wide_only_adds_times():
    r = random.Random(5)
    for _ in range(200_000):
        high, p, q = r.choice((0, 0, 1, 77, 0xA7, 0xA8, 0xA8)), r.randrange(65536), r.randrange(65536)
        known, wide = timing.completed(high, p, q), timing.completed(high, p, q, wide=True)
        assert known == wide or known[0] is None and known[1] == wide[1]


def statistics(spark, delays, cat=1, **options):
    df = spark.createDataFrame([(1, 1, cat, 0, float(d)) for d in delays], "sac int, sic int, cat int, window_start long, delay double")
    return stats.delay_statistics(df, **options).collect()


def test_percentile(spark):
    delays = [0.0] * 99 + [0.5]
    assert statistics(spark, delays)[0].p99 == 0.0
    assert statistics(spark, delays, compat=True)[0].p99 == 0.0
    assert statistics(spark, delays, cat=48, compat=True)[0].p99 == 0.5


def test_mode(spark):
    delays = [(b - 1600) * 0.005 + 0.002 for b, n in ((1599, 10), (1600, 40), (1601, 20)) for _ in range(n)]
    assert statistics(spark, delays)[0].mode == pytest.approx(0.003)
    assert statistics(spark, [-8.0, -7.999, 7.999, 8.0])[0].cuenta == 2
    assert statistics(spark, []) == []


def test_windows_that_are_over(spark):
    df = spark.createDataFrame([(1, 1, 1, float(t), 0.5) for t in (10, 400, 14580)], "sac int, sic int, cat int, ts double, delay double")
    last = lambda **o: max(r.window_start for r in stats.delay_windows(df, **o).collect())
    assert last() == 14400
    assert last(include_last=False) == 300


def test_admission(spark):
    sources = spark.createDataFrame([(1, "a", "g", 1, "10.0.0.1"), (2, "b", "g", 1, "0.0.0.0"), (3, "c", "g", 1, "10.0.0.2"), (4, "d", "h", 1, "10.0.0.9")], "position int, name string, group_ip string, port int, source_ip string")
    packets = spark.createDataFrame([(1, "g", 1, "10.0.0.1"), (2, "g", 1, "10.0.0.2"), (3, "h", 1, "10.0.0.1"), (4, None, 1, None)], "packet_id long, group_ip string, port int, source_ip string")
    out = {r.packet_id: r.flow for r in admission.admit(packets, sources).collect()}
    assert out == {1: "a", 2: "b"}  # the open source stands before the third


def brute_clusters(rows):
    open_, out = [], {}
    for seq, azimuth, dist, good in rows:
        open_ = [c for c in open_ if abs(c[-1][1] - azimuth) <= 1.2]
        if not good:
            continue
        home = next((c for c in open_ if abs(c[-1][1] - azimuth) < 0.6 and abs(c[-1][2] - dist) < 0.04), None)
        if home is None:
            home = []
            open_.append(home)
        home.append((seq, azimuth, dist))
        out[seq] = id(home), home[0][0]
    return {s: head for s, (_, head) in out.items()}


def test_reply_clusters(spark):
    r = random.Random(5)
    rows = [(i, i * 0.05 + r.random() * 0.2, r.choice([1.0, 1.03, 5.0, 9.0]), r.random() < 0.9) for i in range(300)]
    df = spark.createDataFrame([("a", *x) for x in rows], "source string, seq long, azimuth double, dist double, is_true boolean")
    got = {x.seq: x.cluster for x in replies.cluster(df, slot=37).collect()}
    heads = {}
    for seq in sorted(got):
        heads.setdefault(got[seq], seq)
    assert {s: heads[c] for s, c in got.items()} == brute_clusters(rows)


def test_upserts_keep_the_last(spark):
    rows = spark.createDataFrame([(1, "k", 5.0), (2, "k", 7.0), (1, "m", 1.0)], "seq long, key string, v double")
    assert {r.key: r.v for r in acas.latest(rows, ("key",), ("seq",)).collect()} == {"k": 7.0, "m": 1.0}


def test_synthetic_codes(spark):
    rows = spark.createDataFrame([("a", i, t, s) for i, (t, s) in enumerate([(5, 0.0), (9, 1.0), (5, 10.0), (5, 25.0), (9, 15.9), (None, 16.0)])], "source string, seq long, track_number int, tod double")
    assert {r.seq: r.modea for r in transcode.synthetic_codes(rows).collect()} == {0: 1, 1: 2, 2: 1, 3: 3, 4: 2, 5: None}


@pytest.mark.parametrize("slot", [1, 7, 65536])
def test_synthetic_codes_by_slots(spark, slot):
    r = random.Random(slot)
    rows, want = [], {}
    for source in ("a", "b", None):
        at, last, code, count = 0.0, {}, {}, 0
        for seq in range(150):
            at += r.choice((0.0, 0.5, 2.0, 14.9))
            track = r.choice((1, 2, 3, 4, r.randrange(5, 60), None))
            time = None if r.random() < 0.03 else at
            rows.append((source, seq, track, time))
            if track is None:
                want[source, seq] = None
                continue
            if track not in last or last[track] is None or time is None or time >= last[track] + 15:
                count += 1
                code[track] = count
            last[track] = time
            want[source, seq] = code[track]
    df = spark.createDataFrame(rows, "source string, seq long, track_number int, tod double").repartition(3)
    assert {(x.source, x.seq): x.modea for x in transcode.synthetic_codes(df, slot=slot).collect()} == want


def test_file_names(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-05 07:08:09' AS t")
    got = df.select(output.file_name(F.col("t"), "north"), output.file_name(F.col("t"), directories=False), output.file_name(F.col("t"), "x", "gps", timestamp=False)).first()
    assert tuple(got) == ("03/05/240305-north-070809.ast", "240305070809.ast", "x.gps")
