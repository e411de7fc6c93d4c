"""Order MinHash: fingerprints that follow the edit distance, not only the set of k-mers.

Each k-mer is numbered among its equals in the text, so repeats count. For each of the fingerprint's
slots another hash orders these pairs; the smallest few are put back in the order of the text, and a
hash of that tuple of k-mers fills the slot. Two texts agree in a slot if they agree in the smallest
k-mers and in their order. The share of slots that agree is the likeness of two fingerprints.

Texts that are compared with the next document are dealt by ranges of doc_id and sorted; a task sees
each text and the next one once, and the first and last rows of ranges are matched afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

KMER = 8  # code points
SLOTS = 64  # a multiple of two
TUPLE = 2  # k-mers a slot
POSITION_BITS = 31
SEGMENT = 1 << 16  # k-mers hashed at once
BATCH_CHARS = 1 << 18
RANGE_BYTES = 32 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
MOST = np.uint64(2**64 - 1)
BELOW = np.uint64(2**POSITION_BITS - 1)

PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
FOUND = f"part int, edge string, text string, {PAIR}"


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each position on, by doubling; as many as start in points and end in it."""
    done, x, out, at = 1, C.mix(points.astype(np.uint64) + np.uint64(1)), None, 0
    base = 0xD6E8FEB86659FD93
    while True:
        if k & done:
            m = len(points) - k + 1
            part = x[at : at + m]
            out = part if out is None else out * np.uint64(pow(base, done, 1 << 64)) + part
            at += done
        if done * 2 > k:
            return C.mix(out)
        x = x[:-done] * np.uint64(pow(base, done, 1 << 64)) + x[done:]
        done *= 2


def numbered(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with how many equal ones stand before them in their document."""
    n = len(h)
    name = C.mix(h + doc.astype(np.uint64) * ODD)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((name >> bits << bits) | np.arange(n, dtype=np.uint64))
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    group = name[at]
    if ((group[1:] != group[:-1]) & (key[1:] >> bits == key[:-1] >> bits)).any():  # the bits sorted by don't part all
        at = np.argsort(name, kind="stable")
        group = name[at]
    new = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    order = np.arange(n)
    count = np.empty(n, np.int64)
    count[at] = order - np.maximum.accumulate(np.where(new, order, 0))
    return C.mix(h ^ (count.astype(np.uint64) * ODD))


def smallest(x: np.ndarray, position: np.ndarray, starts: np.ndarray, multipliers: np.ndarray, few: int) -> np.ndarray:
    """(slots, segments, few): the smallest hashes of each segment of x with their positions in the low bits; MOST where there are less."""
    out = np.full((len(multipliers), len(starts), few), MOST)
    base, low = x << np.uint64(POSITION_BITS), position.astype(np.uint64)
    shift = starts - position[starts]
    h = np.empty(len(x), np.uint64)
    for j, a in enumerate(multipliers):
        np.multiply(base, a, out=h)
        np.bitwise_or(h, low, out=h)
        for f in range(few):
            least = np.minimum.reduceat(h, starts)
            out[j, :, f] = least
            if f + 1 < few:
                some = least != MOST
                h[(shift + (least & BELOW).astype(np.int64))[some]] = MOST
    return out


def best_of(found: np.ndarray, starts: np.ndarray, few: int) -> np.ndarray:
    """(slots, texts, few) of (slots, candidates), where the candidates of each text begin at starts."""
    found = found.copy()
    out = np.full((len(found), len(starts), few), MOST)
    sizes = np.diff(np.r_[starts, found.shape[1]])
    for f in range(few):
        least = np.minimum.reduceat(found, starts, axis=1)
        out[:, :, f] = least
        found[(found == np.repeat(least, sizes, axis=1))] = MOST
    return out


def tuples(best: np.ndarray, hashes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """(texts, slots) 16-bit hashes of the chosen k-mers in the order of the text; hashes gives theirs by (text, position)."""
    none = best == MOST
    position = np.sort(np.where(none, BELOW, best & BELOW), axis=2)
    out = np.zeros(best.shape[:2], np.uint64)
    for f in range(best.shape[2]):
        p = position[:, :, f]
        there = p != BELOW
        out = C.mix(out * ODD + np.where(there, hashes(np.where(there, p, np.uint64(0)).astype(np.int64)), np.uint64(f + 1)))
    return (out >> np.uint64(48)).astype("<u2").T


def multipliers(slots: int) -> np.ndarray:
    return C.mix(np.arange(1, slots + 1, dtype=np.uint64)) | np.uint64(1)


def fingerprints(texts: list[str], stems: list[int] | None = None, tails: list[str] | None = None, k: int = KMER, slots: int = SLOTS, few: int = TUPLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts, slots) fingerprints of texts, and of texts whose code points from stems[i] on are replaced by tails[i].

    K-mers inside the stem are hashed once for both. Texts shorter than k are padded with U+0000 to one
    k-mer; an empty text is all padding. Without stems both are the same.
    """
    n = len(texts)
    if not n:
        return (np.zeros((0, slots), "<u2"),) * 2
    both = stems is not None
    variants = [texts, [t[:s] + x for t, s, x in zip(texts, stems, tails)]] if both else [texts]
    hashed, at, length = [], [], []
    for v in variants:
        padded = [t.ljust(k, "\0") for t in v]
        size = np.array([len(t) for t in padded], np.int64)
        points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        first = np.cumsum(size) - size
        count = size - k + 1
        doc = np.repeat(np.arange(n), count)
        begin = np.cumsum(count) - count
        position = np.arange(len(doc)) - begin[doc]
        h = kmers(points, k)[first[doc] + position]
        hashed.append((h, numbered(h, doc), doc, position))
        at.append(begin)
        length.append(count)
    # k-mers that lie in the stem are common to both variants; the rest is hashed for each
    stem = np.minimum(np.maximum(np.array(stems, np.int64) - k + 1, 0), np.minimum(*length)) if both else np.zeros(n, np.int64)
    parts = [(0, np.zeros(n, np.int64), stem)] if both else []
    parts += [(v, stem, length[v]) for v in range(len(variants))]
    xs, positions, cuts, owners, kinds, size = [], [], [], [], [], 0
    a = multipliers(slots)
    found: list[np.ndarray] = []

    def flush() -> None:
        nonlocal size
        if size:
            found.append(smallest(np.concatenate(xs), np.concatenate(positions), np.array(cuts), a, few))
        xs.clear(), positions.clear(), cuts.clear()
        size = 0

    for kind, (v, low, high) in enumerate(parts):
        _, x, doc, position = hashed[v]
        for d in np.flatnonzero(high > low).tolist():
            for p in range(int(low[d]), int(high[d]), SEGMENT):
                q = min(int(high[d]), p + SEGMENT)
                i, j = int(at[v][d]) + p, int(at[v][d]) + q
                cuts.append(size)
                xs.append(x[i:j])
                positions.append(position[i:j])
                owners.append(d)
                kinds.append(kind)
                size += q - p
                if size >= SEGMENT:
                    flush()
    flush()
    found_all = np.concatenate(found, axis=1)
    owners_, kinds_ = np.array(owners), np.array(kinds)
    out = []
    for v in range(len(variants)):
        use = np.flatnonzero((kinds_ == 0) | (kinds_ == v + 1)) if both else np.arange(len(owners_))
        use = use[np.argsort(owners_[use], kind="stable")]
        starts = np.searchsorted(np.repeat(owners_[use], few), np.arange(n))
        best = best_of(found_all[:, use].reshape(slots, -1), starts, few)
        h, begin = hashed[v][0], at[v]
        out.append(tuples(best, lambda p, h=h, begin=begin: h[np.minimum(begin[None, :] + p, len(h) - 1)]))
    return out[0], out[-1]


def edited(text: str, after: str) -> tuple[int, str]:
    """Code points of text that stay, and the ones of the next text that replace its last quarter."""
    m = len(text) // 4
    return len(text) - m, after[:m]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _rows(rows: list[tuple[int | None, str]], texts_after: list[str]) -> dict[str, pa.Array]:
    """The columns of PAIR for rows and the text after each."""
    texts = [t for _, t in rows]
    kept = [edited(t, x) for t, x in zip(texts, texts_after)]
    one, two = fingerprints(texts, [s for s, _ in kept], [x for _, x in kept])
    where = {id(t): i for i, t in enumerate(texts)}
    others = [t for t in {id(t): t for t in texts_after if id(t) not in where}.values()]
    extra, _ = fingerprints(others)
    where |= {id(t): len(texts) + i for i, t in enumerate(others)}
    after = np.concatenate([one, extra])[[where[id(t)] for t in texts_after]]
    return {
        "doc_id": pa.array([d for d, _ in rows], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256((t[:s] + x).encode()).hexdigest() for t, (s, x) in zip(texts, kept)]),
        "fingerprint": pa.array([x.tobytes() for x in one], pa.binary()), "edited_fingerprint": pa.array([x.tobytes() for x in two], pa.binary()),
        "near_edited": likeness(one, two), "near_next": likeness(one, after),
    }


def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for one sorted range: its first text as edge `head`, its last as `tail`, all others with what follows them."""
    held: list[tuple[int | None, str]] = []
    size, opened, part = 0, False, TaskContext.get().partitionId()

    def finish(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        n = len(rows) - 1
        made = _rows(rows[:-1], [t for _, t in rows[1:]])
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "edge": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string())} | made)

    def edge(kind: str, row: tuple[int | None, str]) -> pa.RecordBatch:
        made = _rows([row], [row[1]])  # for its types; only doc_id stands
        blank = {name: pa.nulls(1, pa.array(x).type) for name, x in made.items()}
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "edge": [kind], "text": [row[1]]} | blank | {"doc_id": made["doc_id"]})

    for batch in C.slices(batches, "text", 1 << 12, 1 << 20):
        for row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            if not opened:
                opened = True
                yield edge("head", row)
            held.append(row)
            size += len(row[1])
            if size >= BATCH_CHARS and len(held) > 1:
                yield finish(held)
                held = held[-1:]
                size = len(held[0][1])
    if len(held) > 1:
        yield finish(held)
    if held:
        yield edge("tail", held[-1])


def follow(docs: DataFrame) -> DataFrame:
    """One row per row of docs, as PAIR says: its fingerprint, that of its edited text, and how like it is to this and to the next document.

    The next document is the one that follows by (doc_id, hash of text), after the last the first; null
    doc_ids come first. A single document follows itself. Null text is empty. Equal texts have equal
    fingerprints, as have all texts that differ in trailing U+0000 up to k. No rows: no rows.
    """
    n = max(16, -(-C.text_bytes(docs) // RANGE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranges = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    found = C.write_scratch(ranges.mapInArrow(along, FOUND), "along")
    heads = found.filter("edge = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    tails = found.filter("edge = 'tail'").select("part", "doc_id", "text")
    # a row for each range that has texts: few enough for one task
    after = found.filter("edge = 'head'").select("part", F.lead("part").over(Window.orderBy("part")).alias("p"))
    first = after.agg(F.min("part").alias("first"))
    after = after.crossJoin(F.broadcast(first)).select("part", F.coalesce("p", "first").alias("next_part"))
    ends = tails.join(after, "part").join(heads, "next_part").select("doc_id", "text", "after")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "text", 1 << 12, 1 << 20):
            made = _rows(list(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())), batch["after"].to_pylist())
            yield pa.RecordBatch.from_pydict(made)

    whole = found.filter("edge IS NULL").drop("part", "edge", "text")
    return whole.unionByName(ends.mapInArrow(last, PAIR))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = follow(C.table(spark, sf_dir, "documents"))
    text = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return out.withColumns(text)
