"""Personal data, toxicity, token counts, media, packing and pages."""

import hashlib
import random
import re
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from radarq.llm import audio, html_text, packing, pii, token_rollup, tokens, toxicity
from radarq.llm import bilstm_crf as M
from radarq.llm import common as C

from . import plain, spellings
from .conftest import odd, table

ODD_TEXTS = [None, "", "\n", "a", "é́ ß ﬁ 中文 \U0001f600", "<|endoftext|>", "İstanbul ǅ", "x" * 70000]

# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base(text):
    """The contract's base spans, word for word."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in pii.CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), m.end(), 3) for m in pii.PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans(rows):
    r = random.Random(1)
    made = ["".join(r.choice("ab.@-+ 0123456789()") for _ in range(300)) for _ in range(300)]
    made += ["a@b@c.de", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1", "@a.b", "..@a.b.c-.d", "1" * 40]
    for text in made + [t or "" for _, t in rows]:
        assert pii.base_spans(text) == base(text)


def test_gradient():
    t = M.Tagger(3, hidden=3, embed=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x = np.array([[1, 5, 9, M.PADDING], [2, 2, 3, 4]])
    y = np.array([[0, 1, 2, 0], [2, 0, 1, 1]])
    _, grad = t.loss_and_gradient(x, y)
    for name, value in t.p.items():
        at = tuple(np.array(np.unravel_index(np.abs(grad[name]).argmax(), value.shape)))
        old, eps = value[at], 1e-3
        value[at] = old + eps
        up = t.loss_and_gradient(x, y)[0]
        value[at] = old - eps
        down = t.loss_and_gradient(x, y)[0]
        value[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grad[name][at], rel=0.05, abs=1e-3)


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.train(pii.contexts(docs))


def test_tagger_on_held_out_windows(tagger, docs):
    x, y = pii.labelled_windows(list(pii.contexts(docs)), n=300, seed=99)
    got = tagger.decode(x)
    real = x != M.PADDING
    spans = lambda tags: {(i, s) for i, row in enumerate(tags) for s in pii._runs(row)}
    found, gold = spans(np.where(real, got, 0)), spans(y)
    hit = len(found & gold)
    assert hit / len(found) > 0.8 and hit / len(gold) > 0.8


def missed(r, kind):
    """Personal data in a spelling that the base patterns don't take whole."""
    while True:
        found = pii._made(r, kind)
        if (0, len(found), kind) not in base(found):
            return found


def test_added_spans_in_documents(tagger, rows):
    """Spellings that the patterns miss, planted in whole documents, are found; nothing else is added."""
    r, texts, want = random.Random(99), [], []
    for _, text in rows:
        spaces = [i for i, c in enumerate(text or "") if c == " "]
        if spaces:
            at, kind = r.choice(spaces) + 1, r.randrange(4)
            found = missed(r, kind)
            texts.append(f"{text[:at]}{found} {text[at:]}")
            want.append((at, at + len(found), kind))
    got = pii.added_spans(tagger, texts, [base(t) for t in texts])
    hit = sum(w in g for w, g in zip(want, got))
    assert hit > 0.8 * len(want) and hit > 0.95 * sum(map(len, got))
    plain_texts = [t or "" for _, t in rows]
    assert sum(map(len, pii.added_spans(tagger, plain_texts, [base(t) for t in plain_texts]))) <= 0.02 * len(rows)


def planted(rows, found, r):
    """Texts of rows with each found at ten places, and where."""
    pool = [t for _, t in rows if t and " " in t]
    for kind, what in found:
        for _ in range(10):
            text = r.choice(pool)
            at = r.choice([i for i, c in enumerate(text) if c == " "]) + 1
            yield f"{text[:at]}{what}{r.choice([' ', '. ', ', '])}{text[at:]}", (at, at + len(what), kind)


def hits(tagger, rows, found):
    texts, want = zip(*planted(rows, found, random.Random(8)))
    spans = [[*b, *a] for b, a in zip(map(base, texts), pii.added_spans(tagger, texts, [base(t) for t in texts]))]
    exact = sum(w in s for w, s in zip(want, spans)) / len(want)
    return exact, sum(any(a < w[1] and b > w[0] for a, b, _ in s) for w, s in zip(want, spans)) / len(want)


def test_spellings_of_another_hand(tagger, rows):
    """Spellings that were not made by the generator are found to the character; look-alikes are left alone."""
    assert all(pii.plausible(k, s) for k, s in spellings.SPELLINGS + spellings.UNSEEN)
    seen, unseen, alike = hits(tagger, rows, spellings.SPELLINGS), hits(tagger, rows, spellings.UNSEEN), hits(tagger, rows, [(9, s) for s in spellings.LOOK_ALIKES])
    print("spellings:", seen, "unseen:", unseen, "look-alikes:", alike)
    assert seen[0] >= 0.7 and unseen[0] >= 0.6 and alike[1] <= 0.1


def test_places_lose_no_span(tagger, rows):
    """What may be added lies in a place as a whole; windows that reach into none change no tag in one."""
    texts = [t for t, _ in planted(rows, spellings.SPELLINGS, random.Random(5))][::7]
    where = [pii.places(t, base(t)) for t in texts]
    tags, sure, begin = pii.tagged(tagger, texts)
    there = np.zeros(len(tags), bool)
    for b, found in zip(begin, where):
        for s, e in found:
            there[b + s : b + e] = True
    got = pii.tagged(tagger, texts, where)
    assert np.array_equal(got[0], np.where(there, tags, 0)) and np.allclose(got[1][there], sure[there], atol=1e-5)
    for kind, what in spellings.SPELLINGS + spellings.UNSEEN:
        text = f"so it is {what} as told"
        assert any(s <= 9 and e >= 9 + len(what) for s, e in pii.places(text, []))
    r = random.Random(4)
    alphabet = "0123456789" * 3 + " .-()+/_,ab@\n"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(40)) if r.random() < 0.7 else f"{pii._made(r, r.randrange(4))} {pii._made(r, r.randrange(4))}"
        a, b = sorted(r.sample(range(len(text) + 1), 2))
        if any(pii.plausible(k, text[a:b]) for k in range(4)):
            assert any(s <= a and e >= b for s, e in pii.places(text, []))


def test_spans_do_not_depend_on_the_windows(tagger):
    """A long span is found wherever it lies in the windows."""
    mail = "anna.last7[at]example[dot]net"
    filler = "some plain words that say nothing at all and go on for a while, " * 12
    texts = [f"{filler[:n]} {mail} {filler}" for n in range(100, 100 + pii.STRIDE)]
    found = pii.added_spans(tagger, texts, [[] for _ in texts])
    assert sum((n + 1, n + 1 + len(mail), 0) in f for n, f in zip(range(100, 100 + pii.STRIDE), found)) >= 0.95 * len(texts)


def test_screened_tags_equal_viterbi(tagger, rows):
    text = " ".join(t or "" for _, t in rows)[:60_000] + " mail a.b (at) cd (dot) org or +1 (555) 010-9999 "
    codes = M.encode(text)
    x = np.full((-(-len(codes) // pii.WINDOW), pii.WINDOW), M.PADDING)
    x.ravel()[: len(codes)] = codes
    want = np.where(x != M.PADDING, tagger.decode(x), 0)
    which, best = tagger.tags(x)
    assert which.tolist() == np.flatnonzero(want.any(1)).tolist()
    assert np.array_equal(np.where(x[which] != M.PADDING, best, 0), want[which])


def test_pii_query_keeps_base_spans(spark, docs, rows):
    out = {r.doc_id: r for r in pii.find_pii(odd(docs)).collect()}
    for d, text in rows:
        want = base(text or "")
        assert [(s.start, s.end, pii.KINDS.index(s.kind)) for s in out[d].base] == want
        assert set(map(tuple, out[d].base)) <= set(map(tuple, out[d].spans))


def test_pii_edges(spark):
    texts = [*ODD_TEXTS[:-1], "mail me@home.org " * 3, "z" * 5000 + " 10.0.0.1"]
    got = pii.find_pii(table(spark, [*enumerate(texts), (None, "a@b.cd"), (0, "a@b.cd")]), steps=2).collect()
    assert len(got) == len(texts) + 2
    assert pii.find_pii(table(spark, []), steps=2).collect() == []


# ---- toxicity


def test_neighbours_equal_brute_force_over_all_terms(spark, docs, small, rows):
    """Every neighbour and cosine of every document, against all examples, term by term."""
    import math
    from collections import Counter

    labels = spark.read.parquet(f"{small}/labels.parquet")
    held, calibration = toxicity.fit(docs, labels)
    index = held.value.index
    text_of = dict(rows)
    bags = []
    for _, text in rows:
        ws = [w.encode() for w in plain.words(text)]
        bags.append(Counter([(0, w) for w in ws] + [(1, w[: toxicity.PREFIX]) for w in ws if len(w) > toxicity.PREFIX]))
    bag_of = {d: b for (d, _), b in zip(rows, bags)}
    df, share = Counter(t for b in bags for t in b), index.toxic.mean()
    examples = sorted(index.ids.tolist())
    toxic_of = dict(zip(index.ids.tolist(), index.toxic.tolist()))
    assert set(examples) == {r.doc_id for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in text_of}
    n, n_toxic = Counter(t for d in examples for t in bag_of[d]), Counter(t for d in examples if toxic_of[d] for t in bag_of[d])

    def weight(t):
        if t not in n:
            return toxicity.LEAST_WEIGHT * (math.log((len(rows) + 1) / 2) + 1)
        off = max(abs(n_toxic[t] - n[t] * share) - 0.5, 0)
        chi = off * off / (n[t] * share * (1 - share))
        return (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * max(math.sqrt(chi / (chi + toxicity.HALF_SURPRISE)), toxicity.LEAST_WEIGHT)

    def unit(d):
        v = {t: (1 + math.log(f)) * weight(t) for t, f in bag_of[d].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    unit_of = {d: unit(d) for d in text_of}
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for d in text_of:
        cos = {e: sum(x * unit_of[e].get(t, 0.0) for t, x in unit_of[d].items()) for e in examples}
        want = sorted((e for e in examples if cos[e] > 0), key=lambda e: (-round(cos[e], 9), e))[: toxicity.NEIGHBOURS]
        got = out[d].evidence
        assert [x.doc_id for x in got] == want
        assert np.allclose([x.cosine for x in got], [cos[e] for e in want], atol=1e-7)
        assert [x.toxic for x in got] == [toxic_of[x.doc_id] for x in got]
        assert out[d].score == pytest.approx(calibration(toxicity.votes(np.array([x.cosine for x in got]), np.array([x.toxic for x in got])), bool(bag_of[d])))
    assert sum(not x.evidence for x in out.values()) == sum(not b for b in bags)  # no text with words goes without neighbours


@pytest.mark.parametrize("n, frequent", [(400, 16), (400, 1), (30, 200), (3, 5)])
def test_index_is_exact(monkeypatch, n, frequent):
    """Blocks that are opened or not, ties, left-out examples and unknown terms, against dense products."""
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    r = np.random.default_rng(n)
    v = 150
    some = [np.sort(r.choice(v, r.integers(1, 30), replace=False, p=1 / np.arange(1, v + 1) / (1 / np.arange(1, v + 1)).sum())) for _ in range(n)]
    some[1] = some[0]
    row, term = np.repeat(np.arange(n), [len(x) for x in some]), np.concatenate(some)
    tf = r.integers(1, 5, len(term))
    tf[row == 1] = tf[row == 0]
    index = toxicity.BlockMaxIndex(np.arange(v, dtype=np.uint64), np.linspace(0.5, 4, v), 1.0, np.arange(n) * 3, r.integers(0, 2, n), term, row, tf)
    w = index.weights(term, row, tf, n)
    dense = np.zeros((n, v))
    dense[row, term] = w
    for but in (None, np.arange(n) * 3):
        found = index.search(np.r_[term, -1], np.r_[row, n - 1], np.r_[w, 0.5], n, 16, but)
        for i, (rows, cos) in enumerate(found):
            want = dense @ dense[i]
            if but is not None:
                want[i] = 0
            order = [x for x in np.lexsort((np.arange(n), -np.round(want, 9)))[:16] if want[x] > 0]
            assert (index.ids[rows] // 3).tolist() == order
            assert np.allclose(cos, want[order])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic is not null").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95
    assert np.mean([r.predicted == 1 for r in out if r.toxic]) > 0.9 and np.mean([r.predicted == 0 for r in out if not r.toxic]) > 0.98


def test_scores_never_see_held_out_labels(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect())
    assert scores(labels) == scores(turned)


def test_toxicity_edges(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    more = docs.select("doc_id", "text").union(table(spark, [(900 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "words"), (900, "words")]))
    strange = labels.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (900, None)], "doc_id long, toxic int")).withColumn("pos", F.lit(1))
    out = toxicity.toxicity(odd(more), strange).collect()
    assert len(out) == more.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 for r in toxicity.toxicity(more, labels.limit(0)).collect())
    assert toxicity.toxicity(table(spark, []), labels).collect() == []


def test_toxicity_of_long_texts_and_ties(spark):
    texts = [(i, ("bad " if i % 2 else "fine ") + f"w{i // 2}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    more = [(100, "bad word " * 300_000), (101, None), (102, "other"), (103, "other")]
    out = {r.doc_id: r for r in toxicity.toxicity(table(spark, texts + more), labels).collect()}
    assert len(out) == 44 and out[102].score == out[103].score and out[100].score > out[0].score
    assert [x.doc_id for x in out[100].evidence] == sorted(x.doc_id for x in out[100].evidence) and all(x.toxic for x in out[100].evidence)


# ---- token counts


@pytest.fixture()
def rollup(spark):
    return token_rollup.TokenRollup(spark, f"{C.scratch_dir(spark)}/test-{uuid.uuid4().hex}")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def counts(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def test_rollup(spark, rollup):
    assert totals(rollup) == {}
    one, two = counts(spark, (1, "a", "en", "t", 10), (2, "a", "en", "t", 5), (3, None, None, "t", 2)), counts(spark, (2, "b", "en", "t", 7))
    assert rollup.commit("b1", token_rollup.inserts(one)) and not rollup.commit("b1", token_rollup.inserts(one))
    assert totals(rollup) == {("a", "en", "t"): (2, 15), (None, None, "t"): (1, 2)}
    rollup.commit("b2", token_rollup.revisions(one.filter("doc_id = 2"), two))
    want = {("a", "en", "t"): (1, 10), ("b", "en", "t"): (1, 7), (None, None, "t"): (1, 2)}
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit("b2", token_rollup.inserts(two))
    rollup.commit("b3", token_rollup.deletes(one.filter("doc_id = 1")))
    rollup.compact()
    rollup.compact()
    del want[("a", "en", "t")]
    assert totals(rollup) == want
    assert rollup.commit("empty", token_rollup.inserts(one.limit(0))) and totals(rollup) == want
    with pytest.raises(ValueError):
        rollup.commit("a/b", token_rollup.inserts(one))


class Failing:
    """A file system that fails at its n-th rename or delete."""

    def __init__(self, fs, n):
        self.fs, self.left = fs, n

    def __getattr__(self, name):
        if name in ("rename", "delete"):
            self.left -= 1
            if self.left < 0:
                raise OSError("crash")
        return getattr(self.fs, name)


@pytest.mark.parametrize("n", range(5))
def test_crash_in_compaction(spark, rollup, n):
    for k in range(3):
        rollup.commit(f"b{k}", token_rollup.inserts(counts(spark, (k, "a", "en", "t", 10**k))))
        if k == 0:
            rollup.compact()
    want, fs = {("a", "en", "t"): (3, 111)}, rollup._fs
    rollup._fs = Failing(fs, n)
    if n < 4:  # a rename, an old fold and two batches
        with pytest.raises(OSError):
            rollup.compact()
    else:
        rollup.compact()
    rollup._fs = fs
    assert totals(rollup) == want and {r.batch for r in rollup.batches().collect()} == {"b0", "b1", "b2"}
    rollup.compact()
    assert totals(rollup) == want and {r.batch for r in rollup.batches().collect()} == {"b0", "b1", "b2"}
    assert len(fs.listStatus(rollup._path(f"{rollup.path}/deltas"))) == 1


def test_two_attempts_of_a_batch(spark, rollup, monkeypatch):
    """Both find the batch missing; the one that renames first counts, the other one's files are gone."""
    monkeypatch.setattr(rollup, "_committed", lambda batch: False)
    changes = token_rollup.inserts(counts(spark, (1, "a", "en", "t", 10)))
    assert [rollup.commit("b", changes) for _ in range(3)] == [True, False, False]
    assert totals(rollup) == {("a", "en", "t"): (1, 10)}
    assert [s.getPath().getName() for s in rollup._fs.listStatus(rollup._path(rollup.path))] == ["deltas"]
    assert all(s.isFile() for s in rollup._fs.listStatus(rollup._path(f"{rollup.path}/deltas/batch=b")))


def test_a_batch_committed_during_compaction(spark, rollup, monkeypatch):
    rollup.commit("b0", token_rollup.inserts(counts(spark, (1, "a", "en", "t", 1))))
    fold = rollup._fold
    monkeypatch.setattr(rollup, "_fold", lambda *a: (rollup.commit("b1", token_rollup.inserts(counts(spark, (2, "a", "en", "t", 10)))), fold(*a)))
    rollup.compact()
    assert totals(rollup) == {("a", "en", "t"): (2, 11)} and {r.batch for r in rollup.batches().collect()} == {"b0", "b1"}


def test_count_tokens_edges(spark):
    rows = [(1, None, "en", None), (1, None, "en", None), (None, "a", None, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = token_rollup.count_tokens(odd(docs), token_rollup.VERSIONS[:1]).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 100_000]
    assert token_rollup.count_tokens(docs.limit(0), token_rollup.VERSIONS).collect() == []


def test_counts_by_all_changes(spark, small, monkeypatch):
    done, commit, compact = [], token_rollup.TokenRollup.commit, token_rollup.TokenRollup.compact

    def told(self, batch, changes):
        d = changes.agg(F.sum(F.abs("d_docs")), F.sum("d_docs")).first()
        done.append((batch.split("-")[0], d[0], d[1]))
        return commit(self, batch, changes)

    monkeypatch.setattr(token_rollup.TokenRollup, "commit", told)
    monkeypatch.setattr(token_rollup.TokenRollup, "compact", lambda self: done.append(("compact", 0, 0)) or compact(self))
    n = 2 * spark.read.parquet(f"{small}/documents.parquet").count()
    token_rollup.op4_token_counts(spark, small).collect()
    changed = {kind: (a, b) for kind, a, b in done}
    assert [x[0] for x in done].count("compact") == 1
    assert changed["revisions"][1] == 0 and changed["deletes"][0] == -changed["deletes"][1]
    assert changed["revisions"][0] / 2 + changed["deletes"][0] == n


def test_counts_of_documents(spark, docs, small):
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.op4_token_counts(spark, small).collect()}
    want: dict = {}
    for v in token_rollup.VERSIONS:
        count = token_rollup.counter(v)
        for r in docs.collect():
            n, t = want.get((r.source, r.lang, v), (0, 0))
            want[(r.source, r.lang, v)] = n + 1, t + count([r.text or ""])[0]
    assert got == want


# ---- tokens and packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_give_the_ids_of_whole_texts(rows):
    r = random.Random(1)
    letters = "abcXYZ  \n\t'.,!?-0123456789éÉßÿ×÷ªº²½µ<|>sdtrvlm\x0b\x1c\x85\xa0"
    texts = ["".join(r.choice(letters) for _ in range(80)) for _ in range(400)] + [t or "" for t in ODD_TEXTS] + [t or "" for _, t in rows]
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in enc.ids(texts)] == whole_ids(texts)
    assert [x.tolist() for x in enc.ids(texts)] == whole_ids(texts)  # from what it knows by now


def test_packing(spark, rows):
    given = rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    want = {d: np.array([*ids, 2], "<u4") for (d, _), ids in zip(given, whole_ids([t for _, t in given]))}
    out = packing.pack(odd(table(spark, given)).repartition(5)).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for spans, size in [(by_doc[d], len(w)) for d, w in want.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert size is None or at == size
    full = {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    assert all(full[k] == packing.LENGTH for k in range(max(full)))
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(table(spark, given))).collect() if r.doc_tokens == r.length}
    assert all(v == zlib.crc32(want[d].tobytes()) for (d, _), v in digest.items())


def test_packing_edges(spark):
    out = packing.pack(table(spark, [(None, None), (1, "a b"), (1, "a b")])).orderBy("offset").collect()
    assert sorted(r.length for r in out) == [1, 3, 3]
    assert packing.pack(table(spark, [])).collect() == []
    assert {r.length for r in packing.pack(table(spark, [(1, "a " * 20)]), length=7).collect()} == {7}


# ---- media


def test_audio_round_trip(spark):
    texts = [*ODD_TEXTS, "x" * 576, "x" * 577, "x" * 1152]
    out = audio.store_features(audio.store_audio(odd(table(spark, list(enumerate(texts)) + [(None, "same"), (99, "same")])))).collect()
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(audio.encode_wav(payload)).hexdigest()
        frames = audio.read_tensors(bytes(r.log_mel))
        assert frames["log_mel"].type.shape == list(audio.SHAPE)
        mel = np.concatenate([x.to_numpy(zero_copy_only=False).reshape(-1, *audio.SHAPE) for x in [c.storage.flatten() for c in frames["log_mel"].chunks]])
        assert f"crc={zlib.crc32(mel.astype(np.float16).tobytes()):08x}" in r.feature  # what was stored is what was computed
        assert np.all(np.diff(frames["start_s"]) > 0) and np.all(np.array(frames["end_s"]) > np.array(frames["start_s"]))
        assert all(0 <= s.start_s < s.end_s for s in r.segments)
    assert by[None].feature == by[99].feature and by[1].feature == by[0].feature
    assert audio.describe_audio(audio.store_audio(table(spark, []))).collect() == []


def test_resampling_equals_a_plain_filter():
    x = np.random.default_rng(1).integers(-128, 128, 500)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        phases = audio.polyphase(up, down)
        taps = phases.shape[1]
        padded = np.r_[np.zeros(taps // 2, np.int64), x, np.zeros(taps, np.int64)]
        want = []
        for i in range(len(x) * up // down):
            first, phase = divmod(i * down, up)
            want.append(sum(int(padded[first + j]) * int(phases[phase, taps - 1 - j]) for j in range(taps)))
        assert audio.resample(x.astype(np.int32), up, down).tolist() == want


def test_a_tone_is_a_segment_in_its_band():
    t = np.arange(audio.RATE * 2)
    tone = np.where((t > 8000) & (t < 24000), np.sin(2 * np.pi * 1000 * t / audio.RATE), 0)
    payload = (128 + 100 * tone).astype(np.uint8).tobytes()
    (mel,), (segments,) = audio.features([payload])
    assert len(segments) == 1 and segments[0][0] == pytest.approx(0.5, abs=0.05) and segments[0][1] == pytest.approx(1.5, abs=0.05)
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), audio.MELS + 2)[1:-1] / 2595) - 1)
    assert abs(centre[int(mel[100].argmax())] - 1000) < 100


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p {}</style></head><body>
<nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav><header class="site-header"><h1>Site</h1></header>
<div id=content><article><h2>Title &amp; more</h2><p>First   paragraph with <b>bold</b> text and a <a href=z>link</a>, long enough to count as text.
<p>Second one: caf&eacute; &#8211; still text, and it goes on for a while so that it is dense.<script>var x = "<p>no</p>";</script></article>
<div class="comments"><p>A reader says something long that must not be part of the article text at all.</p></div></div>
<aside><p>Advert</p></aside><footer><p>Copyright</p></footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph with bold text and a link, long enough to count as text.\n\nSecond one: café – still text, and it goes on for a while so that it is dense."


WRAPPED = [
    ("<form id=aspnetForm>", "</form>"), ("<div class='layout with-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div id='search-page'>", "</div>"), ("<div role=form>", "</div>"),
    ("<header>", "</header>"), ("<div aria-hidden=true>", "</div>"), ("<form class=search><div id=content-ad-free>", "</div></form>"),
]
def test_log_mel_is_not_rounded():
    """As stored: float16 of a plain computation, frame by frame."""
    r = np.random.default_rng(4)
    payload = bytes(r.integers(0, 256, audio.UNIT * 9).astype(np.uint8))
    (mel,), _ = audio.features([payload])
    gap = 2 * audio.TAPS * audio.DOWN
    sound = audio.resample(np.r_[np.frombuffer(payload, np.uint8).astype(np.int32) - 128, np.zeros(gap, np.int32)])
    n = 1 + max(0, len(payload) * audio.UP // audio.DOWN - audio.FRAME) // audio.HOP
    for i in range(n):
        frame = sound[i * audio.HOP : i * audio.HOP + audio.FRAME].astype(np.float64) * audio.HANN / (1 << 21)
        power = np.abs(np.fft.rfft(frame, audio.FFT)) ** 2
        want = 10 * np.log10(np.maximum(power @ audio.BANK.astype(np.float64), 1e-8))
        assert np.abs(mel[i].astype(np.float64) - want).max() <= 0.04  # half a unit in the last place of float16, and float32 sums
    assert len(np.unique(mel[:n].astype(np.float64) % 0.25)) > 4


PARTS = [" ".join(f"{w} {k} of the article, long enough to count as text." for k in range(4)) for w in ("Sentence", "Line", "Clause", "Phrase")]
PARAGRAPHS = ["".join(f"<p>{x}</p>" for x in PARTS[k : k + 2]) for k in (0, 2)]
AROUND = ("<nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>", "<div class=comments><p>A reader says something.</p></div><div class=sidebar><a href=z>More</a></div><footer><p>Copyright</p></footer>")


@pytest.mark.parametrize("start, end", WRAPPED)
@pytest.mark.parametrize("tag", ["article", "main", "div", ""])
def test_wrapper_names(start, end, tag):
    inner = "".join(PARAGRAPHS)
    inner = f"<{tag}>{inner}</{tag}>" if tag else inner
    for page in (f"{AROUND[0]}{start}{inner}{end}{AROUND[1]}", f"{start}{AROUND[0]}{inner}{AROUND[1]}{end}"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(PARTS)


@pytest.mark.parametrize("start, end", [("", ""), ("<main>", "</main>"), ("<div class=with-sidebar>", "</div>"), ("<div><div>", "</div></div>")])
@pytest.mark.parametrize("tag", ["article", "section", "div"])
def test_sibling_parts(start, end, tag):
    inner = "".join(f"<{tag}>{x}</{tag}>" for x in PARAGRAPHS)
    assert html_text.main_text(f"<html><body>{AROUND[0]}{start}{inner}{end}{AROUND[1]}</body></html>") == "\n\n".join(PARTS)


def test_unlike_sibling_articles():
    inner = f"<article>{PARAGRAPHS[0]}</article><article><p>A part with <a href=x>one link</a> in it, and shorter.</p><p>It ends.</p></article>"
    for page in (inner, f"<main>{inner}</main>", f"<div class=layout-with-sidebar>{inner}</div>"):
        assert html_text.main_text(f"<body>{AROUND[0]}{page}{AROUND[1]}</body>") == "\n\n".join([*PARTS[:2], "A part with one link in it, and shorter.", "It ends."])


def test_named_parts_stay_out():
    short = "<article><p>Brief.</p></article>"
    far = "<footer><p>A footer that is longer than the article.</p></footer><aside><p>An aside that is longer, too.</p></aside>"
    assert html_text.main_text(f"<body>{short}{far}</body>") == "Brief."
    reply = "<section id=comments><article class=comment><p>A reader says something long that isn't the article's.</p></article></section>"
    assert html_text.main_text(f"<body><article>{PARAGRAPHS[0]}</article>{reply}</body>") == "\n\n".join(PARTS[:2])


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>", "</p></div>", "<p>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000, "a<b", "&#xFFFFFFF;", "<p title='>'>x</p>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


@pytest.mark.parametrize(
    "start, end, out",
    [
        ('<div class="social-studies">', "</div>", False), ('<div class="ad-hoc-method">', "</div>", False), ('<section id="cookie-recipes">', "</section>", False), ('<div class="header-story">', "</div>", False),
        ('<div class="post-header">', "</div>", False), ('<div class="site-footer">', "</div>", True), ('<div class="ad">', "</div>", True), ('<div class="related-posts">', "</div>", True), ('<div class="x comment-list">', "</div>", True), ('<div class="page-header">', "</div>", True),
    ],
)
def test_names_of_parts(start, end, out):
    """A class says what a part is only if all of its words do."""
    page = f"<body><article>{PARAGRAPHS[0]}{start}<p>A part of its own, with some words.</p>{end}{PARAGRAPHS[1]}</article></body>"
    assert ("A part of its own" in html_text.main_text(page)) is not out


def test_title_in_a_header_of_the_post():
    page = f'<body><div class="menu"><a href="/">Home</a></div><div class="post"><div class="post-header"><h1>The title</h1></div>{PARAGRAPHS[0]}{PARAGRAPHS[1]}</div></body>'
    assert html_text.main_text(page).startswith("The title\n\n")


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = html_text.extract(odd(pages)).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) for r in out)
    assert sum(r.n_chars > 0 for r in out) > 0.9 * len(out)
    assert not any(re.search(r"</?(p|div|a|script|nav|article)\b", r.text) for r in out)
    odd_rows = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>text</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(odd_rows).collect()) == ["", "", "text"]
    assert html_text.extract(odd_rows.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    ["<font>" * 20000 + "x" + "</b>" * 20000, "<b><div>" + "<font>" * 20000 + "</b>" * 20000, "<header>" * 20000 + "x", "<a " * 40000, "<div>" * 5000 + "<article><p>text</p></article>" * 10000, "<table><tr>" + "<td><div>" * 20000],
)
def test_pages_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5
