"""Operators over the vocabulary and order of texts: source divergence, order MinHash and collocations, against plain versions."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest

from radarq.llm import collocations, order_minhash, source_divergence

from . import plain
from .conftest import odd

ODD_TEXTS = [None, "", "\n", "a", "\x00\x00", "é" * 60, "...", " \t ", "ÀB àb", "x-y_z 12 a1b", "ΑΒΓ αβγ"]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def plain_divergence(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(plain.LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= 3}
        sources = sorted({d[1] for d in mine})
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + floor(Fraction(10**9 * (c[t] + 1), sum(c.values()) + len(kept))) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


def divergence_rows(seed, n=150):
    r = random.Random(seed)
    words = ["the", "The", "of", "É", "straße", "ab'cd", "x", "日本語", "zz"] + ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words[: r.choice((5, 40, 200))]) for _ in range(r.randint(0, 60))), r.choice(("en", "fr", None, "")), r.choice(("a", "b", "c", "ü", None))) for i in range(n)]
    return rows + [(1000 + i, t, r.choice(("en", "de")), "odd") for i, t in enumerate(ODD_TEXTS)] + [(2000, "only here", "xx", "one"), (2001, None, "yy", "p"), (2002, "q", "yy", "q")]


def divergence(df):
    return [tuple(x) for x in source_divergence.audit(df).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_source_divergence(spark, monkeypatch, seed):
    if seed == 2:  # cut runs, buckets and matrices everywhere
        for name, value in (("SLICE_BYTES", 500), ("BUCKET_TERMS", 10), ("DENSE", 20), ("RUN_ROWS", 2)):
            monkeypatch.setattr(source_divergence, name, value)
    rows = divergence_rows(seed)
    got = divergence(odd(table(spark, rows)).repartition(5))
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)


def test_source_divergence_edges(spark):
    rows = [(None, "alpha beta", "en", "a")] * 3 + [(5, "alpha", None, None), (5, "alpha", "", ""), (5, "alpha alpha", "", "z")]
    got = divergence(table(spark, rows))
    assert set(got) == plain_divergence(rows) and any(x[:2] == ("", "") for x in got)
    assert divergence(table(spark, [])) == []
    long = [(i, "word " * 200_000 + "tail", "en", s) for i, s in enumerate("aab")]
    assert set(divergence(table(spark, long))) == plain_divergence(long)


def test_shares_past_64_bits():
    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        total = r.randint(1, 8 * 10**15)
        c = r.randint(0, total - 1)
        assert int(source_divergence.share(np.array([c]), np.array([total]))[0]) == 1 + 10**9 * (c + 1) // total


def mixed(x):
    x &= 2**64 - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & (2**64 - 1)
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """One k-mer, one slot and one number at a time."""
    o = order_minhash
    text = text.ljust(o.KMER, "\0")
    found, seen = [], Counter()
    for p in range(len(text) - o.KMER + 1):
        points = [mixed(ord(c) + 1) for c in text[p : p + o.KMER]]
        while len(points) > 1:  # halves of halves
            half = pow(0xD6E8FEB86659FD93, o.KMER // len(points), 2**64)
            points = [(a * half + b) % 2**64 for a, b in zip(points[::2], points[1::2])]
        h = mixed(points[0])
        found.append((mixed(h ^ (seen[h] * int(o.ODD) % 2**64)), p, h))
        seen[h] += 1
    out = []
    for j in range(o.SLOTS):
        a = mixed(j + 1) | 1
        best = sorted((x * 2**o.POSITION_BITS * a % 2**64 | p, p, h) for x, p, h in found)[: o.TUPLE]
        name = 0
        for f, (_, _, h) in enumerate(sorted(best, key=lambda x: x[1]) + [(0, 0, i + 1) for i in range(len(best), o.TUPLE)]):
            name = mixed(name * int(o.ODD) + h)
        out.append(name >> 48)
    return b"".join(x.to_bytes(2, "little") for x in out)


def plain_order(rows):
    """doc_id to all columns of op12, for distinct doc_ids."""
    rows = sorted((d, t or "") for d, t in rows)
    texts = [t for _, t in rows]
    out = {}
    likeness = lambda a, b: sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / order_minhash.SLOTS
    for (d, t), after in zip(rows, texts[1:] + texts[:1]):
        m = len(t) // 4
        changed = t[: len(t) - m] + after[:m]
        one, two = plain_fingerprint(t), plain_fingerprint(changed)
        out[d] = len(t), plain.sha(changed), one, two, likeness(one, two), likeness(one, plain_fingerprint(after))
    return out


def order(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in order_minhash.follow(df).collect()}


def test_order_minhash(spark, monkeypatch):
    r = random.Random(8)
    noise = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    rows = [(3 * i, noise(r.randint(0, 90), r.choice(("ab", "abcdefgh ", "é日x")))) for i in range(60)] + [(400 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(500, "a" * 400), (501, "a" * 399), (502, "ab" * 200)]
    want = plain_order(rows)
    assert order(odd(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    same = {(t or "").rstrip("\0") for _, t in rows}
    assert len({x[2] for x in want.values()}) == len(same) - 1  # a run of one letter has one k-mer, however long it is
    texts = [t or "" for _, t in rows]
    whole, _ = order_minhash.fingerprints(texts)
    monkeypatch.setattr(order_minhash, "SEGMENT", 7)  # every text in several pieces
    pieces, _ = order_minhash.fingerprints(texts)
    assert (whole == pieces).all()


@pytest.mark.parametrize("low", [False, True])
def test_numbers_of_equal_kmers(monkeypatch, low):
    import numpy as np

    if low:  # no upper bits to sort by
        monkeypatch.setattr(order_minhash.C, "mix", lambda x: x.astype(np.uint64) & np.uint64(0xFFFFFF))
    r = np.random.default_rng(2)
    h, doc = r.integers(1, 9, 320).astype(np.uint64), np.repeat([0, 1], 160)
    seen, want = Counter(), []
    for d, x in zip(doc.tolist(), h):
        want.append(order_minhash.C.mix(np.array([x ^ np.uint64(seen[d, int(x)] * int(order_minhash.ODD) % 2**64)]))[0])
        seen[d, int(x)] += 1
    assert order_minhash.numbered(h, doc).tolist() == [int(x) for x in want]


def test_order_minhash_follows_edits():
    r = random.Random(9)
    text = "".join(r.choice("abcdefghij ") for _ in range(4000))
    changed = [text[: 4000 - n] + "".join(r.choice("klmnop") for _ in range(n)) for n in (0, 100, 400, 1000, 3000)]
    halves = text[2000:] + text[:2000]
    prints, _ = order_minhash.fingerprints([*changed, halves], slots=512)
    near = order_minhash.likeness(prints, prints[:1].repeat(6, 0))
    assert near[0] == 1 and all(a > b for a, b in zip(near[:4], near[1:5]))
    assert 0.3 < near[5] < 0.75  # nearly the same k-mers, half of the pairs in another order


def test_order_minhash_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert order(frame([])) == {}
    alone = order(frame([(7, None)]))
    assert alone[7][0] == 0 and alone[7][4:] == (1.0, 1.0)
    rows = [(None, "the same text"), (None, "the same text"), (1, "the same text"), (1, "another one"), (2, None)]
    got = order_minhash.follow(frame(rows)).collect()
    assert len(got) == 5 and len({bytes(x.fingerprint) for x in got}) == 3
    long = "".join(random.Random(1).choice("abc de") for _ in range(300_000))
    got = order(frame([(1, long), (2, long + "x"), (3, "short")]))
    assert got[1][5] > 0.9 and got[3][0] == 5


def plain_collocations(rows, least, top=2000):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(plain.LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(a, held.get(p[i : i + m], 0))
        found = []
        for p, a in good.items():
            if 100 * held.get(p, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


def phrases(df, **how):
    return [tuple(x) for x in collocations.collocations(df, **how).collect()]


def phrase_rows(seed, n=120):
    r = random.Random(seed)
    words = ["a", "b", "A", "é", "É", "x-y", "日本", "(q)", "ab", "ba"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        w = [r.choice(words[: r.choice((3, 10, 40))]) for _ in range(r.randint(0, 50))]
        rows.append((i, "".join(x + r.choice((" ", " ", " ", "\t", "  ", ". ", "\n", "!", " , ")) for x in w), r.choice(("en", "fr", None, "und", ""))))
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD_TEXTS)] + [(2000 + i, "one and the same phrase, over and over over over over over over", "fr") for i in range(9)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, monkeypatch, seed):
    if seed == 2:  # many blocks of each language
        monkeypatch.setattr(collocations, "BLOCK_TEXT", 100)
        monkeypatch.setattr(collocations, "HELD_TEXT", 300)
    rows = phrase_rows(seed)
    df = odd(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(3)
    for least, top in ((4, 2000), (8, 12)):
        got = phrases(df, least=least, top=top)
        want = plain_collocations(rows, least, top)
        assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_collocations_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert phrases(frame([])) == []
    assert phrases(frame([(1, None, None), (2, "", "en"), (None, "x", "en")])) == []
    rows = [(None, "to be or not to be", None)] * 31 + [(1, "to be " * 150_000 + ", " + "x" * 300_000, "long")]
    assert set(phrases(frame(rows))) == plain_collocations(rows, 30)


def test_scores_past_64_bits(spark, monkeypatch):
    big = 9 * 10**13
    found = spark.createDataFrame([("en", "p", 4 * big), ("en", "q", 3 * big), ("en", "p q", big + 1)], collocations.PHRASES)
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, least: (found, spark.createDataFrame([("en", 7 * big)], "lang string, n long")))
    assert phrases(None) == [("en", 1, "p q", big + 1, 4 * big, 3 * big, 7 * big, 2_000_000 * (big + 1) // (7 * big))]


def test_suffix_array_of_words():
    import numpy as np

    r = np.random.default_rng(4)
    for n, most in ((1, 3), (300, 4), (500, 40)):
        ids = r.integers(0, most, n).astype(np.uint32)
        order, common = collocations.suffix_array(ids)
        for m in range(1, 5):
            first, count = collocations.intervals(ids, order, common, m)
            want = Counter(w for i in range(n - m + 1) if 0 not in (w := tuple(ids[i : i + m].tolist())))
            assert {tuple(ids[i : i + m].tolist()): c for i, c in zip(first.tolist(), count.tolist())} == want and len(first) == len(want)


def test_phrases_are_spelled_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from radarq.llm import common as C

    text = " ".join(f"w{i}" for i in np.random.default_rng(5).integers(0, 20_000, 100_000).tolist())
    words, ends, ids = collocations.word_ids(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    block = collocations.Block(pa.table({"lang": ["en"], "part": [0], "words": C.packed([words]), "ends": C.packed([ends]), "ids": C.packed([ids])}), 4)
    _, _, count, first, m = block.phrases(1, 2, 3, 4)
    tracemalloc.start()
    found = block.spelled(first, m, count)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    w = text.split()
    want = Counter(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert dict(zip(found["phrase"].to_pylist(), found["f"].to_pylist())) == want and len(found) == len(want) and set(found["lang"].to_pylist()) == {"en"}
    assert peak < 50 * len(want)  # 8 bytes of a number each, and what some are spelled with


def test_no_task_ranks_a_whole_language(spark, monkeypatch):
    rows = [("en", f"{i:04d}", 4000) for i in range(600)] + [("en", f"{i:04d} {i * 7 % 600:04d}", 1000 + i % 9) for i in range(600)]
    found = spark.createDataFrame(rows, collocations.PHRASES)
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, least: (found, spark.createDataFrame([("en", 99)], "lang string, n long")))
    df = collocations.collocations(None, top=20)
    dealt = re.findall(r"Window \[.*?\], \[(.*?)\], \[", df._jdf.queryExecution().optimizedPlan().toString())
    assert len(dealt) == 2 and dealt[0].count("#") == 1 and dealt[1].count("#") == 2  # the inner one first splits the language
    want = sorted(((-a, p) for _, p, a in rows[600:]))[:20]
    assert [(x.rank, x.a, x.phrase) for x in df.orderBy("rank").collect()] == [(i + 1, -a, p) for i, (a, p) in enumerate(want)]


def test_blocks_have_no_large_cells(spark):
    texts = [" ".join(f"w{i * k % 99_991}" for i in range(90_000)) for k in (7, 11)]
    rows = spark.createDataFrame([("en", bytearray(x.encode())) for x in texts], "lang string, data binary").coalesce(1)
    found = rows.mapInArrow(collocations.blocks_of, collocations.BLOCKS).toArrow()
    assert max(len(x) for c in ("words", "ends", "ids") for x in found[c].to_pylist()) <= 64 << 10
    assert sum(found["n"].to_pylist()) == 180_000 and len(set(found["block"].to_pylist())) == 1
    block = collocations.Block(found.take(list(range(len(found)))[::-1]), 4)  # rows in any order
    spelled = [block.raw[(block.ends[i - 2] if i > 1 else 0) : block.ends[i - 1]] for i in block.ids.tolist() if i]
    assert b" ".join(spelled).decode() == " ".join(texts)
