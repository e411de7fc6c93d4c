"""Tables kept by key: deliveries, repeats, races and losses at each step."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radarq.sources import archive, stored

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("region", T.StringType()), T.StructField("v", T.DoubleType())])


def table(spark, **how):
    return stored.StoredTable(spark, how.pop("folder", None) or tempfile.mkdtemp(prefix="spark-"), SCHEMA, ("key", "region"), **how)


def rows(spark, *given):
    return spark.createDataFrame([(k, r, float(v), n) for n, (k, r, v) in enumerate(given)], "key string, region string, v double, n int")


def now(t, version=None):
    return {(r.key, r.region): r.v for r in t.read(version).collect()}


def test_deliveries(spark):
    t = table(spark, buckets=3)
    assert now(t) == {} and t.version() == 0
    assert t.upsert(rows(spark, ("a", "x", 1), ("b", None, 2), ("a", "x", 3), (None, None, 4)), ("n",), 0)
    assert now(t) == {("a", "x"): 3.0, ("b", None): 2.0, (None, None): 4.0}
    assert t.upsert(rows(spark, ("a", "x", 0), ("c", "y", 5), (None, None, 6)), ("n",), 1)
    want = {("a", "x"): 0.0, ("b", None): 2.0, (None, None): 6.0, ("c", "y"): 5.0}
    assert now(t) == want and t.read().count() == 4
    assert not t.upsert(rows(spark, ("a", "x", 9)), ("n",), 1) and not t.upsert(rows(spark, ("a", "x", 9)), ("n",), 0)
    assert now(t) == want and now(t, 1)[("a", "x")] == 3.0
    assert t.upsert(rows(spark, ("z", "z", 1)), ("n",), 0, stream="other") and t.upsert(rows(spark), ("n",), 2)
    t.vacuum()
    assert now(t) == want | {("z", "z"): 1.0}
    again = table(spark, folder=t.store.folder, buckets=99)
    assert again.buckets == 3 and now(again) == now(t) and not again.upsert(rows(spark, ("a", "x", 9)), ("n",), 2)
    with pytest.raises(ValueError):
        stored.StoredTable(spark, t.store.folder, SCHEMA, ("key",))


def test_two_deliveries_at_once(spark, monkeypatch):
    t, other = table(spark, buckets=2), None
    t.upsert(rows(spark, ("a", "x", 1)), ("n",), 0)
    other = table(spark, folder=t.store.folder)
    write, raced = stored.Store.write_once, []

    def late(self, name, text):
        if self is t.store and not raced:
            raced.append(1)
            other.upsert(rows(spark, ("a", "x", 2), ("b", "x", 2)), ("n",), 0, stream="other")
        return write(self, name, text)

    monkeypatch.setattr(stored.Store, "write_once", late)
    assert t.upsert(rows(spark, ("b", "x", 3)), ("n",), 1)
    assert now(t) == {("a", "x"): 2.0, ("b", "x"): 3.0} and t.version() == 3
    t.vacuum()
    assert now(t) == {("a", "x"): 2.0, ("b", "x"): 3.0}


@pytest.mark.parametrize("step", ["before the manifest", "after the manifest"])
def test_a_lost_driver(spark, monkeypatch, step):
    t = table(spark, buckets=2)
    t.upsert(rows(spark, ("a", "x", 1), ("b", "x", 1)), ("n",), 0)
    write = stored.Store.write_once

    def lost(self, name, text):
        if step == "after the manifest":
            write(self, name, text)
        raise KeyboardInterrupt

    monkeypatch.setattr(stored.Store, "write_once", lost)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(rows(spark, ("a", "x", 2)), ("n",), 1)
    monkeypatch.undo()
    taken = step == "after the manifest"
    assert now(t)[("a", "x")] == (2.0 if taken else 1.0)
    t.vacuum()
    assert t.upsert(rows(spark, ("a", "x", 2)), ("n",), 1) is not taken
    assert now(t) == {("a", "x"): 2.0, ("b", "x"): 1.0}
    assert len(t.store.names("data")) == len({p.split("/")[1] for p in t.manifest()["paths"].values()}) + (not taken and 1)


def test_another_file_system(spark):
    behind = tempfile.mkdtemp(prefix="spark-")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.radar.link./tables", f"file://{behind}")
    t = table(spark, folder="viewfs://radar/tables/availability")
    t.upsert(rows(spark, ("a", "x", 1)), ("n",), 0)
    t.upsert(rows(spark, ("a", "x", 2), ("b", "y", 1)), ("n",), 1)
    assert now(t) == {("a", "x"): 2.0, ("b", "y"): 1.0}


def test_increments_make_their_windows_once(spark):
    """An increment is looked at for its last window and its buckets, and added; a batch that comes again isn't made at all."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    kept = archive.Archive(spark, tempfile.mkdtemp(prefix="spark-") + "/archive")
    rows = spark.createDataFrame([(1, 2, 48, 300 * i, i / 8) for i in range(40)], "sac int, sic int, cat int, window_start long, media double")
    assert kept.add(rows.withColumn("media", told.asNondeterministic()("media")), 0) and seen.value == 40
    assert not kept.add(rows.withColumn("media", told.asNondeterministic()("media")), 0) and seen.value == 40
    assert kept.read().count() == 40 + 7 + 2 + 1
