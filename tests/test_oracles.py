"""Every registered query of the library against its SQL over the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from radarq.plans import streams  # noqa: F401
from radarq.plans.oracles import ORACLES
from radarq.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def key(row):
    return tuple((x is None, "" if x is None else x) if x is not None else (True, 0) for x in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_lines_of_all_categories(spark, small):
    lines = [r.line for r in QUERIES["format_lines_whole"](spark, small).collect()]
    events = spark.read.parquet(f"{small}/events.parquet").groupBy("event_type").count().collect()
    n = {r.event_type: r["count"] for r in events}
    begin = lambda cat: sum(x.startswith(f"CAT{cat:02d} ") for x in lines)
    assert {c: begin(c) for c in (1, 10, 20, 34, 48)} == {1: n["click"], 10: n["purchase"], 20: n["signup"], 34: n["error"], 48: 2 * n["view"]}
    for form in (r"\[DST \d+m\]", r"\[X -?[\d.]+\]", r"\[Y -?[\d.]+\]", r"\[[0-9A-F]{6}\]", r"<IB\d{5}>", r"\[na\] \([\d.]+\)", r"\[FL-?\d+GI\]", r"TRN\]", r"\]T "):
        assert any(re.search(form, x) for x in lines), form


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", ["registers", "decode_acas_ra", "latest_capabilities_repeated", "ras_statements", "decode_cat48", "format_lines_whole", "transcode_cat10_cat48"])
def test_generated_code_compiles(spark, small, name):
    """Without the way back to interpreted rows, code that is too large fails."""
    for key, value in (("spark.sql.codegen.fallback", "false"), ("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")):
        spark.conf.set(key, value)
    try:
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    finally:
        for key in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode"):
            spark.conf.unset(key)


@pytest.mark.parametrize("start", [173_500, 298_700, 350])
@pytest.mark.parametrize("name", ["truncated_time_asof", "truncated_time_turn", "stream_full_times"])
def test_truncated_times_long_after_a_mark(spark, tmp_path, name, start):
    """Some 65 s of plots without a mark, over a wrap of the truncated time (event 173,608) and over midnights (298,897 and, of the query that starts before one, 500)."""
    kind = lambda i: "view" if i < 10 or i > 240 else "click"
    rows = [(start + i, 3 * i, kind(i)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = c.sql(ORACLES[name])
    got = sorted(tuple(x) for x in df.select(*rel.columns).collect())
    assert len(got) == 300 and got == sorted(rel.fetchall())
