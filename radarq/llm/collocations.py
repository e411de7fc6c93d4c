"""Phrase collocations from word-id suffix arrays.

Tasks cut their documents into pieces and words and write *blocks*: the words of some megabytes of one
language as ids, pieces parted by 0, with the block's vocabulary. Each block sorts its suffixes by four
words (prefix doubling: one, two, four); runs of the suffix array with a common prefix of m words are the
block's phrases of m words, and their lengths the counts. Counts are merged by key in shards, in two turns:

1. words and pairs; blocks get back which of theirs are frequent in all blocks of the language;
2. phrases of three and four words of which all pairs are frequent (no other can be).

Frequent keys get their words back from the first block that sent them, and what is left is small: a row
for each frequent phrase. Cuts, scores, longer candidates and ranks are joins and windows over these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LONGEST = 4
LEAST = 30
TOP = 2000
UNIT = 2_000_000
BLOCK_TEXT = 4 << 20  # bytes of text in a block
HELD_TEXT = 32 << 20  # of all languages together, before a task writes its largest
SHARD_TEXT = 16 << 20  # a shard stands for
SPELLED = 1 << 17  # phrases spelled out at once
PART = 64 << 10  # bytes of a block's columns in a row: large cells fill the heap of an executor
GROUP = {"parquet.block.size": 8 << 20}  # readers hold the rows of a row group at once

BLOCKS = "block long, lang string, n long, part int, words binary, ends binary, ids binary"
SENT = "shard int, block long, keys binary, counts binary"
FREQUENT = "block long, shard int, frequent binary, sums binary, own binary"
PHRASES = "lang string, phrase string, f long"

IS_STOP, IS_BLANK = np.zeros(256, bool), np.zeros(256, bool)
IS_STOP[list(b".,;:!?\n\v\f\r")] = True
IS_BLANK[list(b" \t")] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of distinct words, their ends, ids): words as 1, 2, ... in the order of the texts, 0 between pieces."""
    low = C.LOWER[data]
    stop = IS_STOP[low]
    is_word = ~(stop | IS_BLANK[low])
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = is_word[edge]
    end[edge - 1] = is_word[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    ends = np.r_[0, np.cumsum(e - s)].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[is_word]))]).dictionary_encode()
    words, word_ends = C.binary_column(found.dictionary)
    piece = np.cumsum(stop)[s] + np.searchsorted(offsets, s, "right") if len(s) else s  # rises with every stop and every text
    new = np.flatnonzero(np.r_[False, piece[1:] != piece[:-1]]) if len(s) else s
    ids = np.insert(found.indices.to_numpy().astype(np.uint32) + np.uint32(1), new, 0)
    return words, word_ends[1:], ids


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS: a block holds one language, whole texts, and is numbered by its task; its rows are parts of its columns, n is in the first."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def block(lang: str) -> pa.RecordBatch:
        nonlocal number
        texts = pa.array(held.pop(lang), pa.large_binary())
        size.pop(lang)
        words, ends, ids = word_ids(*C.binary_column(texts))
        columns = {"words": words, "ends": ends.view(np.uint8), "ids": ids.view(np.uint8)}
        cuts = range(0, max(1, *map(len, columns.values())), PART)
        number += 1
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number - 1] * len(cuts), pa.int64()), "lang": [lang] * len(cuts),
            "n": pa.array([np.count_nonzero(ids)] + [0] * (len(cuts) - 1), pa.int64()), "part": pa.array(range(len(cuts)), pa.int32()),
            **{name: C.packed([x[i : i + PART] for i in cuts]) for name, x in columns.items()},
        })

    for batch in C.slices(batches, "data", 1 << 12):
        for lang, data in zip(batch["lang"].to_pylist(), batch["data"].to_pylist()):
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= BLOCK_TEXT:
                yield block(lang)
            elif sum(size.values()) >= HELD_TEXT:
                yield block(max(size, key=size.get))
    for lang in list(held):
        yield block(lang)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first four words by prefix doubling, and for each the words that it shares with the one before; a piece's end counts as parting."""
    n = len(ids)
    rank, reach = np.r_[ids.astype(np.int64), np.zeros(LONGEST, np.int64)], 1
    order = np.arange(n)
    while reach < LONGEST:
        key = rank[:n] * (rank.max(initial=0) + 1) + rank[reach : reach + n]
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if n else 0
        reach *= 2
    padded = np.r_[ids, np.zeros(LONGEST, ids.dtype)]
    common = np.zeros(n, np.int8)
    going = np.ones(max(n - 1, 0), bool)
    for m in range(LONGEST):
        column = padded[order + m]
        going &= (column[1:] == column[:-1]) & (column[1:] != 0)
        common[1:] += going
    return order, common


def intervals(ids: np.ndarray, order: np.ndarray, common: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the phrases of m words stand first in the suffix array's runs, and how often each occurs."""
    at = np.flatnonzero(common < m)
    count = np.diff(np.r_[at, len(order)])
    first = order[at]
    padded = np.r_[ids, np.zeros(LONGEST, ids.dtype)]
    whole = np.logical_and.reduce([padded[first + j] != 0 for j in range(m)]) if len(first) else np.zeros(0, bool)
    return first[whole], count[whole]


class Block:
    """A block's suffix array, and its phrases by shard in an order that each turn finds again."""

    def __init__(self, rows: pa.Table, n_shards: int):
        self.lang, self.n_shards = rows["lang"][0].as_py(), n_shards
        parts = np.argsort(rows["part"].to_numpy()).tolist()
        whole = lambda name: np.concatenate([C.read(rows[name][i], np.uint8) for i in parts])
        self.raw, self.ends, self.ids = whole("words").tobytes(), whole("ends").view(np.int64), whole("ids").view(np.uint32)
        self.order, self.common = suffix_array(self.ids)
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        hashes = [xxhash.xxh3_64_intdigest(self.raw[a:b], seed) for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist())]
        self.hashes = np.r_[np.uint64(0), np.array(hashes, np.uint64)]

    def phrases(self, *lengths: int, pairs: np.ndarray | None = None):
        """(shard, key, count, first position, words) of all phrases of some lengths by shard and key; pairs: where a frequent pair begins."""
        parts = []
        for m in lengths:
            first, count = intervals(self.ids, self.order, self.common, m)
            if pairs is not None:
                may = np.logical_and.reduce([pairs[first + j] for j in range(m - 1)]) if len(first) else np.zeros(0, bool)
                first, count = first[may], count[may]
            key = np.full(len(first), m, np.uint64)
            for j in range(m):
                key = C.mix(key * ODD + self.hashes[self.ids[first + j]])
            parts.append((key, count.astype(np.uint32), first.astype(np.int32), np.full(len(first), m, np.int8)))
        key, count, first, m = (np.concatenate(x) for x in zip(*parts))
        shard = (C.mix(key ^ ODD) % np.uint64(self.n_shards)).astype(np.int64)
        by = np.lexsort((key, shard))
        return shard[by], key[by], count[by], first[by], m[by]

    def message(self, block: int, shard: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.Table:
        used, at = np.unique(shard, return_index=True)
        cut = [slice(i, j) for i, j in zip(at, np.r_[at[1:], len(shard)])]
        return pa.table({
            "shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
            "keys": C.packed([key[c] for c in cut]), "counts": C.packed([count[c] for c in cut]),
        })

    def answers(self, replies: pa.Table, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all phrases sent: whether frequent, whether to be spelled out here, and the sum over all blocks for those."""
        frequent, own, sums = np.zeros(len(shard), bool), np.zeros(len(shard), bool), np.zeros(len(shard), np.int64)
        for s, f, o, v in zip(*(replies[c] for c in ("shard", "frequent", "own", "sums"))):
            a, b = np.searchsorted(shard, s.as_py(), "left"), np.searchsorted(shard, s.as_py(), "right")
            frequent[a:b] = np.unpackbits(C.read(f, np.uint8), count=b - a)
            own[a:b] = np.unpackbits(C.read(o, np.uint8), count=b - a)
            sums[a:b][own[a:b]] = C.read(v, np.int64)
        return frequent, own, sums

    def spelled(self, first: np.ndarray, m: np.ndarray, sums: np.ndarray) -> pa.Table:
        words = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(np.r_[0, self.ends]), pa.py_buffer(self.raw)])
        texts, f = [], []
        for k in range(1, LONGEST + 1):
            at = np.flatnonzero(m == k)
            for i in range(0, len(at), SPELLED):
                some = at[i : i + SPELLED]
                parts = [words.take(pa.array(self.ids[first[some] + j] - np.uint32(1))) for j in range(k)]
                texts.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.string()))
                f.append(pa.array(sums[some], pa.int64()))
        n = sum(map(len, f))
        return pa.table({"lang": pa.array([self.lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), "phrase": pa.chunked_array(texts, pa.string()), "f": pa.chunked_array(f, pa.int64())})


def merge(least: int):
    """Sums of the keys that blocks sent to one shard; each block hears which of its own reach the least count, and the first that sent such a key its sum."""

    def run(key: C.Key, sent: pa.Table) -> pa.Table:
        rows = np.argsort(sent["block"].to_numpy())
        column = lambda name, kind: [C.read(sent[name][i], kind) for i in rows.tolist()]
        keys = column("keys", np.uint64)
        size = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")  # blocks ascend within a key
        every = every[by]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        del every
        at = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(column("counts", np.uint32))[by].astype(np.int64), at)
        good = total >= least
        frequent, own = np.zeros(len(by), bool), np.zeros(len(by), bool)
        frequent[by] = np.repeat(good, np.diff(np.r_[at, len(by)]))
        first, total = by[at[good]], total[good]
        own[first] = True
        total = total[np.argsort(first)]
        end = np.cumsum(size)
        held = np.r_[0, np.cumsum(own)][end]  # sums before a block's end
        cut = [slice(b - n, b) for b, n in zip(end.tolist(), size.tolist())]
        return pa.table({
            "block": sent["block"].take(pa.array(rows)), "shard": sent["shard"], "frequent": C.packed([np.packbits(frequent[c]) for c in cut]),
            "sums": C.packed(np.split(total, held[:-1])), "own": C.packed([np.packbits(own[c]) for c in cut]),
        })

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to four words that occur often enough, and (lang, n) of all words."""
    n_shards = max(16, -(-C.text_bytes(docs) // SHARD_TEXT))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    blocks = C.write_scratch(rows.mapInArrow(blocks_of, BLOCKS), "blocks", **GROUP)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    by_block = blocks.drop("n").groupBy("block")

    def pairs_of(found: Block, replies: pa.Table):
        shard, key, count, first, m = found.phrases(1, 2)
        frequent, own, sums = found.answers(replies, shard)
        pairs = np.zeros(len(found.ids) + LONGEST, bool)
        two = np.zeros(len(found.ids), bool)
        two[first[frequent & (m == 2)]] = True
        # the first of a run of equal pairs stands for all of them
        at = np.flatnonzero(found.common < 2)
        pairs[found.order] = np.repeat(two[found.order[at]], np.diff(np.r_[at, len(found.order)]))
        return pairs, first[own], m[own], sums[own]

    def one(key: C.Key, rows: pa.Table) -> pa.Table:
        found = Block(rows, n_shards)
        return found.message(key[0].as_py(), *found.phrases(1, 2)[:3])

    def two(key: C.Key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        found = Block(rows, n_shards)
        return found.message(key[0].as_py(), *found.phrases(3, 4, pairs=pairs_of(found, replies)[0])[:3])

    def three(key: C.Key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        found = Block(rows, n_shards)
        pairs, first, m, sums = pairs_of(found, replies.filter(pc.equal(replies["turn"], 1)))
        shard, _, _, start, size = found.phrases(3, 4, pairs=pairs)
        _, own, more = found.answers(replies.filter(pc.equal(replies["turn"], 2)), shard)
        return found.spelled(np.r_[first, start[own]], np.r_[m, size[own]], np.r_[sums, more[own]])

    known = by_block.applyInArrow(one, SENT).groupBy("shard").applyInArrow(merge(least), FREQUENT)
    known = C.write_scratch(known, "pairs").withColumn("turn", F.lit(1))
    longer = by_block.cogroup(known.groupBy("block")).applyInArrow(two, SENT).groupBy("shard").applyInArrow(merge(least), FREQUENT)
    both = known.unionByName(longer.withColumn("turn", F.lit(2)))
    return C.write_scratch(by_block.cogroup(both.groupBy("block")).applyInArrow(three, PHRASES), "phrases"), totals


def best(kept: DataFrame, top: int, n_parts: int) -> DataFrame:
    """Each language's first top rows by rank; of its parts by phrase first, so that no task holds all rows of a language."""
    order = F.desc("cut.score"), F.desc("a"), "phrase"
    of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(n_parts))).withColumn("rank", of("lang", "part")).filter(F.col("rank") <= top)
    return parts.withColumn("rank", of("lang")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    Null lang is `und`, null text empty. Every row of docs counts, also where doc_ids repeat or are null. A word
    is any run between blanks, so a text without blanks is one long word. Ties rank by a, then by the bytes of
    the phrase. A language without a frequent phrase has no rows; no rows: no rows.
    """
    found, totals = frequent_phrases(docs, least)
    words = F.split("phrase", " ", -1)
    part = lambda i, k: F.array_join(F.slice("w", i, k), " ")
    rows = found.withColumn("w", words).withColumn("m", F.size("w")).filter("m > 1")
    cuts = rows.select("lang", "phrase", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    of = lambda name, value: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {UNIT}) div (CAST(l AS DECIMAL(19, 0)) + r)")
    scored = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what a longer candidate holds nearly always is part of it
    inner = rows.filter("m > 2").select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = inner.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("i"))
    inner = inner.select("lang", "f", part(F.col("i"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR CAST(longer AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * 80")
    # as many parts as leave about as many rows in a part as the parts hand on
    ranked = best(kept, top, 1 + isqrt(found.count() // max(1, top))).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, list_slice(w, i, i + m - 1) AS ws FROM s, range(1, 5) r(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, any_value(len(ws)) AS m, count(*) AS f FROM g GROUP BY lang, array_to_string(ws, ' ')),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, ws, m, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
z AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * k.a::HUGEINT) // (x.f + y.f)::HUGEINT AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.ws, 1, k.k), ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.ws, k.k + 1, k.m), ' ')),
best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT lang, a AS longer, array_to_string(list_slice(ws, i, i + q - 1), ' ') AS phrase
  FROM c, range(1, 4) o(i), range(2, 4) t(q) WHERE q < m AND i + q - 1 <= m),
held AS (SELECT lang, phrase, max(longer) AS longer FROM subs GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
