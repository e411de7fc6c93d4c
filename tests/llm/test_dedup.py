"""Operators that compare bytes, lines, shingles and benchmark windows, against plain versions."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from radarq.llm import common as C
from radarq.llm import decontaminate, line_dedup, near_duplicates, suffix_dedup

from . import plain
from .conftest import odd, table

ODD_TEXTS = [None, "", "\n", "a", "\x00\x00", "é" * 60, "x" * 49, "x" * 50, "x" * 51, " \t\n  \n", "　  "]


def noise(r, n):
    return "".join(r.choice("abcdefgh \n") for _ in range(n))


def fixture(seed=1):
    """Texts that share passages of 49 to 120 bytes, repeats and odd ones."""
    r = random.Random(seed)
    shared = [noise(r, k) for k in (49, 50, 51, 80, 120)] + ["ab" * 60, "z" * 200]
    texts = [noise(r, r.randint(0, 200)) + "".join(r.choice(shared) + noise(r, r.randint(0, 30)) for _ in range(r.randint(0, 3))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + "!"] + ODD_TEXTS
    r.shuffle(texts)
    return list(enumerate(texts))


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, plain.sha(bytes(r.kept))) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = fixture(seed)
    want = suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in rows])
    assert removed(suffix_dedup.remove_repeats(odd(table(spark, rows)))) == want


def test_suffix_dedup_of_documents(docs, rows):
    assert removed(suffix_dedup.remove_repeats(docs)) == suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in rows])


def test_suffix_dedup_of_many_copies(spark):
    r = random.Random(4)
    base = noise(r, 3000)
    rows = [(i, base[: 2000 + i] + noise(r, 20)) for i in range(120)]
    assert removed(suffix_dedup.remove_repeats(table(spark, rows))) == suffix_dedup.brute_force([(d, t.encode()) for d, t in rows])


@pytest.mark.parametrize("seed", [1, 5])
def test_suffix_dedup_of_hot_hashes(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 2)
    rows = fixture(seed)
    assert removed(suffix_dedup.remove_repeats(table(spark, rows))) == suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in rows])


def test_suffix_dedup_edges(spark):
    text = "q" * 30 + "the very same passage, longer than fifty bytes, in all of them"
    out = suffix_dedup.remove_repeats(table(spark, [(None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, len(text)), (1, 0), (1, 0), (2, len(text))]
    assert suffix_dedup.remove_repeats(table(spark, [])).collect() == []


def test_backward_extension_parts_what_differs_early():
    r = np.random.default_rng(3)
    for n, letters in ((200, 2), (500, 3), (300, 20)):
        pieces = [r.integers(1, letters + 1, r.integers(1, 40)) for _ in range(n // 20)]
        symbols = np.concatenate([np.r_[p, 0] for p in pieces]).astype(np.int16)
        order = suffix_dedup.suffix_array(symbols, 9)
        cut = suffix_dedup.parted(symbols, order, 8)
        text = symbols.tolist()
        group: dict[tuple, set] = {}
        for i, number in zip(order, np.cumsum(cut)):
            if 0 not in text[i : i + 8] and i + 8 <= len(text):
                group.setdefault(tuple(text[i : i + 8]), set()).add(number)
        numbers = [n for g in group.values() for n in g]
        assert len(numbers) == len(group) == len(set(numbers))  # one interval for each window, and for no other


def test_line_dedup(spark):
    r = random.Random(2)
    lines = ["a repeated line here", "  A Repeated LINE here\t", "short", "", "exactly10!", "ünïcödé12", "another line of text"] + [noise(r, 20).replace("\n", "") for _ in range(5)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 6)))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    want = plain.dedup_lines(rows)
    got = {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in line_dedup.dedup_lines(odd(table(spark, rows))).collect()}
    assert got == want


def test_line_dedup_edges(spark):
    line = "the same long line"
    got = line_dedup.dedup_lines(table(spark, [(None, line), (3, line), (3, line), (4, f"{line}\n{line}\nmore")]).withColumn("block", F.lit("kept")), keep=("block",)).collect()
    assert sorted((r.doc_id or -1, r.text, r.n_dropped, r.block) for r in got) == [(-1, "", 1, "kept"), (3, line, 0, "kept"), (3, line, 0, "kept"), (4, "more", 2, "kept")]
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1024, 4096, 1 << 16])
def test_lines_that_a_polynomial_modulo_a_power_of_two_confuses(spark, n):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + other).encode(), np.uint8)
    h = C.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    rows = [(1, one), (2, other), (3, f"{one}\n{other}"), (4, other[: n - 1])]
    want = plain.dedup_lines(rows)
    assert {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in line_dedup.dedup_lines(table(spark, rows)).collect()} == want
    assert want[2] == (other, 1, 0)
    rows = rows[:2]
    assert removed(suffix_dedup.remove_repeats(table(spark, rows))) == suffix_dedup.brute_force([(d, t.encode()) for d, t in rows])


def test_distinct_segments_by_their_bytes(monkeypatch):
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 400).astype(np.uint8)
    start, size = np.arange(300), np.full(300, 6)
    for hashes in (C.span_hashes, lambda data, start, end: np.zeros(len(start), np.uint64)):
        monkeypatch.setattr(C, "span_hashes", hashes)
        rep, same = suffix_dedup.distinct(data, start, size)
        words = [data[a : a + 6].tobytes() for a in start]
        assert [words[k] for k in rep[same]] == words and len(rep) == len(set(words))


def test_span_hashes_of_long_spans(monkeypatch):
    r = np.random.default_rng(6)
    data = np.tile(r.integers(0, 256, 3000).astype(np.uint8), 3)
    short = C.span_hashes(data, np.array([0, 3000, 6000]), np.array([3000, 6000, 9000]))
    long = C.span_hashes(data, np.array([0]), np.array([9000]))
    monkeypatch.setattr(C, "AT_ONCE", 1000)
    assert len(set(short.tolist())) == 1 and C.span_hashes(data, np.array([0, 3000]), np.array([3000, 6000])).tolist() == short[:2].tolist()
    assert C.span_hashes(data, np.array([0]), np.array([9000])).tolist() == long.tolist()


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.unique(r.integers(0, 2**63, n, np.int64).astype(np.uint64))
        h = line_dedup.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_null_and_repeated_ids_are_spread(spark):
    """Rows without a doc_id, and those of one doc_id, go to many blocks; results don't change."""
    rows = [(None if i % 2 else 7, f"line number {i}\nthe very same long line") for i in range(400)]
    assert C.in_blocks(table(spark, rows), 64).select("block").distinct().count() > 50
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sum(r.n_dropped for r in got if r.doc_id is None) == 200 and not any(r.n_dropped for r in got if r.doc_id == 7)
    same = "the very same passage, that is longer than fifty bytes"
    out = suffix_dedup.remove_repeats(table(spark, [(d, f"{t[12:15]} {same}") for d, t in rows])).collect()
    assert all(r.n_removed >= len(same) for r in out if r.doc_id is None) and not any(r.n_removed for r in out if r.doc_id == 7)


def test_very_long_texts(spark):
    """One text of a megabyte and more beside short ones."""
    words = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, words), (2, words + "\nthe end of it"), (3, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 w110 w111 w112"), (4, "a\n" * 300_000)]
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows)).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert near(near_duplicates.near_duplicates(table(spark, rows)))[2][0] == 1
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: 0, 2: len(words), 3: len(rows[2][1]), 4: 0}
    item = spark.createDataFrame([(9, rows[2][1])], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(table(spark, rows), item).collect()} == {1: 13, 2: 13, 3: 13, 4: 0}


@pytest.mark.parametrize("name", ["op2_decontaminate", "op10_line_dedup"])
def test_against_sql(spark, small, name):
    from radarq.llm import registry

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rel = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, small)
    assert set(df.columns) == set(rel.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


def contaminated(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in df.collect()}


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_NGRAMS, 0])
def test_decontamination(spark, monkeypatch, bound):
    """With the set of n-grams broadcast, and joined by shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_NGRAMS", bound)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve", "123"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([1, 3, 12, 13, 14, 30])))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "w1 w1"), (104, "W1, w1")]
    rows = [(i, ", ".join(say(r.randint(0, 60)) + items[r.randrange(25)][1].upper().split() + say(5))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = contaminated(decontaminate.contamination(odd(table(spark, rows)), spark.createDataFrame(items, "item_id long, text string").withColumn("m", F.lit(1)).withColumn("gram", F.lit(2))))
    assert got == plain.contamination(rows, items)


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, [(1, "some words"), (1, "some words"), (None, "some words"), (2, "other words")])
    assert [r.n_hit for r in decontaminate.contamination(docs, none).collect()] == [0] * 4
    one = spark.createDataFrame([(7, "some words"), (None, "some words")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, one).collect())
    assert got == [(-1, 2, ["7"], True), (1, 2, ["7"], True), (1, 2, ["7"], True), (2, 0, [], False)]
    assert decontaminate.contamination(table(spark, []), one).collect() == []


def test_decontamination_runs_no_python(spark, small):
    plan = decontaminate.op2_decontaminate(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def near(df):
    return {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in df.collect()}


def test_near_duplicates_of_documents(docs, rows):
    assert near(near_duplicates.near_duplicates(docs)) == plain.near_duplicates(rows)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE_MEMBERS", 16)  # so that clusters take several tiles
    r = random.Random(8)
    base = [[f"v{r.randrange(500)}" for _ in range(r.randint(8, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        ws = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            ws[r.randrange(len(ws))] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(ws)))
    rows += [(200 + i, t) for i, t in enumerate([*ODD_TEXTS, "one two", "ONE, two", "one two three four five", "one two three four five six"])]
    assert near(near_duplicates.near_duplicates(odd(table(spark, rows)))) == plain.near_duplicates(rows)


def test_near_duplicates_edges(spark):
    text = "a text with more than five words in it"
    got = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in near_duplicates.near_duplicates(table(spark, [(None, text), (2, text), (2, text), (1, text)])).collect())
    assert got == [(-1, None, None), (1, 1, 0), (2, 1, 0), (2, 1, 0)]
    assert near_duplicates.near_duplicates(table(spark, [])).collect() == []


def test_long_chains_become_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in near_duplicates.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_hashes_of_spans_depend_on_bytes_only():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = C.span_hashes(data, np.array([0, 3, 6, 7]), np.array([3, 6, 7, 10]))
    assert h[0] == h[1] == h[3] != h[2]
