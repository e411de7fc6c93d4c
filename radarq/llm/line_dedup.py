"""Line dedup through a sharded minimal perfect hash.

Blocks of documents send each shard their distinct line hashes (with the smallest and largest doc_id
that holds each). A shard lays a minimal perfect hash over all its distinct hashes, with a compact
fingerprint and a count array (1, or 2 for "two documents or more") and the first document; those
rows are the index. The blocks' packed probes then meet the index shard by shard, and the blocks get
back, packed, the first document of each repeated line. No line is ever joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SHARD_BYTES = 16 << 20  # of text a shard stands for
MIN_CHARS = 10
LINES_AT_ONCE = 1 << 13
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

Key = C.Key
REQUEST = "shard int, block int, n int, keys binary, first binary, last binary"
INDEX = "shard int, levels binary, bits binary, prints binary, counts binary, first binary"
REPLY = "block int, keys binary, first binary"


class PerfectHash:
    """Levels of bit arrays: a key lives on the first level where no other key hits its bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        ones = np.zeros(len(bits) // 8 + 1, np.int64)
        if len(bits):
            np.cumsum(np.bitwise_count(bits.view(np.uint64)).astype(np.int64), out=ones[1:])
        self.ones = ones

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct uint64 keys."""
        sizes, flags, level = [], [], 0
        while len(keys):
            size = -(-len(keys) * 3 // 2 // 64) * 64
            spot = cls._spot(keys, level, size)
            alone = np.bincount(spot, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            keys, level = keys[~alone[spot]], level + 1
        bits = np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1 for the keys it was built over; -1 or any slot for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        words = self.bits.view(np.uint64) if len(self.bits) else np.zeros(0, np.uint64)
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            at = start + self._spot(keys[left], level, int(size))
            word, shift = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ones[at >> 6] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line (an empty text has one), and lines before each document."""
    nl = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, nl, "right") - 1
    n_docs = len(offsets) - 1
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=n_docs) + 1)].astype(np.int64)
    start, end = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    inner = np.arange(len(nl)) + owner  # the line that each newline ends
    end[inner], start[inner + 1] = nl, nl + 1
    start[bounds[:-1]], end[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    return start, end, bounds


def line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit hash of each line's key as two columns, name and fingerprint; and whether the key is long enough."""
    solid = np.flatnonzero(~IS_SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    s, e = start.copy(), start.copy()
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    chars = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    low = C.LOWER[data]
    raw, keys = memoryview(low), np.empty((len(s), 2), np.uint64)
    for k in range(0, len(s), LINES_AT_ONCE):  # few Python objects at a time
        cut = slice(k, k + LINES_AT_ONCE)
        digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(s[cut].tolist(), e[cut].tolist()))
        keys[cut] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return keys, chars[e] - chars[s] >= MIN_CHARS


def _distinct(docs: pa.Table):
    data, offsets = C.binary_column(docs["data"])
    ids = C.ids_of(docs["doc_id"])
    start, end, bounds = line_spans(data, offsets)
    keys, long_enough = line_keys(data, start, end)
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    return data, offsets, ids, start, end, bounds, keys, long_enough, owner


def _fold(keys: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Distinct keys with their smallest first and largest last."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, first, last = keys[order], first[order], last[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
    if not len(new):
        return keys, first, last
    return keys[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, text, n_lines, n_dropped after dropping repeated lines, and columns in keep.

    A key (line stripped of ASCII white space, A-Z lower-cased) of ten code points or more that two
    documents hold stays only in the smallest doc_id holding it. Null or empty text: one empty line,
    kept as empty text. A repeated doc_id is one document here: its lines count once, and none of its
    rows loses a line to another. A null doc_id counts as larger than all others. No rows: no rows.
    """
    n_bytes = C.text_bytes(docs)
    n_shards = max(16, -(-n_bytes // SHARD_BYTES))
    dealt = C.in_blocks(docs, C.count_of_blocks(n_bytes), keep)
    carried = dealt.schema[3:]
    blocks = dealt.groupBy("block")

    def ask(key: Key, docs: pa.Table) -> pa.Table:
        *_, ids, start, end, bounds, keys, ok, owner = _distinct(docs)
        held = ids[owner[ok]]
        keys, first, last = _fold(keys[ok], held, held)
        shard = ((keys[:, 0] >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, first, last, shard = keys[order], first[order], last[order], shard[order]
        used, at = np.unique(shard, return_index=True)
        cut = [slice(i, j) for i, j in zip(at, np.r_[at[1:], len(shard)])]
        return pa.table({
            "shard": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "n": pa.array([c.stop - c.start for c in cut], pa.int32()), "keys": C.packed([keys[c] for c in cut]),
            "first": C.packed([first[c] for c in cut]), "last": C.packed([last[c] for c in cut]),
        })

    def index(key: Key, asked: pa.Table) -> pa.Table:
        keys = np.concatenate([C.read(x, np.uint64).reshape(-1, 2) for x in asked["keys"]])
        first = np.concatenate([C.read(x, np.int64) for x in asked["first"]])
        last = np.concatenate([C.read(x, np.int64) for x in asked["last"]])
        keys, first, last = _fold(keys, first, last)
        hasher = PerfectHash.build(_named(keys))
        slot = hasher.slots(_named(keys))
        prints, counts, holder = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint8), np.empty(len(keys), np.int64)
        prints[slot], counts[slot], holder[slot] = keys[:, 1].astype(np.uint32), 1 + (first != last), first
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "levels": C.packed([hasher.sizes]), "bits": C.packed([hasher.bits]),
            "prints": C.packed([prints]), "counts": C.packed([counts]), "first": C.packed([holder]),
        })

    def probe(key: Key, asked: pa.Table, built: pa.Table) -> pa.Table:
        blocks, keys_out, first_out = [], [], []
        if asked.num_rows and built.num_rows:
            hasher = PerfectHash(C.read(built["levels"][0], np.int64), C.read(built["bits"][0], np.uint8))
            prints, counts, holder = (C.read(built[k][0], t) for k, t in (("prints", np.uint32), ("counts", np.uint8), ("first", np.int64)))
            for block, cell in zip(asked["block"], asked["keys"]):
                keys = C.read(cell, np.uint64).reshape(-1, 2)
                slot = hasher.slots(_named(keys))
                hit = (slot >= 0) & (prints[slot] == keys[:, 1].astype(np.uint32)) & (counts[slot] > 1)
                if hit.any():
                    blocks.append(block.as_py())
                    keys_out.append(keys[hit])
                    first_out.append(holder[slot[hit]])
        return pa.table({"block": pa.array(blocks, pa.int32()), "keys": C.packed(keys_out), "first": C.packed(first_out)})

    def drop(key: Key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets, ids, start, end, bounds, keys, ok, owner = _distinct(docs)
        gone = np.zeros(len(start), bool)
        if replies.num_rows and len(start):
            known = np.concatenate([C.read(x, np.uint64).reshape(-1, 2) for x in replies["keys"]])
            holder = np.concatenate([C.read(x, np.int64) for x in replies["first"]])
            known, holder, _ = _fold(known, holder, holder)
            at = np.minimum(np.searchsorted(known[:, 0], keys[:, 0]), len(known) - 1)
            gone = ok & (known[at] == keys).all(1) & (holder[at] != ids[owner])
        raw, texts = data.tobytes(), []
        dropped = np.add.reduceat(gone, bounds[:-1]) if len(ids) else np.zeros(0, np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if dropped[i]:
                texts.append(b"\n".join(raw[start[k] : end[k]] for k in range(a, b) if not gone[k]))
            else:
                texts.append(raw[offsets[i] : offsets[i + 1]])
        return pa.table({
            "doc_id": docs["doc_id"], "text": pa.array(texts, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(np.diff(bounds), pa.int64()), "n_dropped": pa.array(dropped.astype(np.int64), pa.int64()),
            **{f.name: docs[f.name] for f in carried},
        })

    requests = blocks.applyInArrow(ask, REQUEST).groupBy("shard")
    probes = requests.cogroup(requests.applyInArrow(index, INDEX).groupBy("shard"))
    replies = probes.applyInArrow(probe, REPLY)
    shape = T.StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long")
    out = blocks.cogroup(replies.groupBy("block")).applyInArrow(drop, T.StructType([*shape, *carried]))
    return out.withColumnsRenamed({f"keep_{i}": k for i, k in enumerate(keep)})


def _named(keys: np.ndarray) -> np.ndarray:
    return keys[:, 0] ^ C.mix(keys[:, 1])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.i, r.key IS NOT NULL AND k.doc_id <> r.first_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
