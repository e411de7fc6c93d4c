"""Removal of byte strings that an earlier document holds, by threshold-bounded interval expansion.

Where two texts share a 50-byte window, they share its smallest 16-gram hash too. So a document falls
into *segments*, runs of windows with the same smallest hash, and equal windows always lie in segments
of the same hash. The work goes in three rounds between blocks of documents and shards of hashes:

1. Blocks send each shard their distinct smallest hashes; shards answer which of them two documents hold,
   and which are so common that their segments, all of different context, would swell one shard: those
   segments go on cut into single windows, dealt by the hash of the window, so that only equal ones meet.
2. Blocks send the distinct segments of those hashes, with their smallest and largest doc_id. A shard
   merges equal segments and indexes those of hashes with several different ones: suffix array and
   Burrows-Wheeler transform of the concatenation, then breadth-first backward extension, which finds
   the common prefixes in the order of their length and stops at 50. Suffixes not yet parted then are
   an interval of equal windows, and its smallest doc_id goes back, as runs, to the blocks.
3. Blocks mark the bytes under windows that a smaller doc_id holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW = 50
GRAM = 16
SHARD_BYTES = 8 << 20  # of text a shard stands for
INDEX_BYTES = 1 << 19  # of segments indexed at once
HOT_SEGMENTS = 1 << 20  # a hash of more segments, about, is split by whole windows
END = 0  # symbol after each segment; bytes are 1 to 256

Key = C.Key
HASHES = "shard int, block int, prints binary, marks binary"
REPEATED = "block int, shard int, prints binary, hot binary"
SEGMENTS = "shard int, block int, n int, bytes binary"
RUNS = "block int, number binary, start binary, length binary, holder binary"


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, document) of every maximal run of windows with one smallest hash."""
    n, span = len(data), WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.view(np.uint64), none, none, none
    parts = []
    piece = 1 << 15
    for base in range(0, n - WINDOW + 1, piece):
        top = min(n, base + piece + WINDOW - 1)
        m = top - base - GRAM + 1
        eight = np.empty((top - base + 15) // 8 * 8, np.uint64)  # the eight bytes from each position on
        padded = np.zeros(len(eight) + 8, np.uint8)
        padded[: top - base] = data[base:top]
        for off in range(8):
            eight[off::8] = padded[off : off + len(eight)].view("<u8")
        x = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
        y = eight[8 : 8 + m] * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        y ^= y >> np.uint64(29)
        x += y
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        reach = 1
        while reach < span:  # smallest of the next `span` hashes, by doubling
            step = min(reach, span - reach)
            x = np.minimum(x[: len(x) - step], x[step:])
            reach += step
        parts.append(x)
    least = np.concatenate(parts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - WINDOW + 1, 0))
    first = np.cumsum(np.maximum(size - WINDOW + 1, 0)) - np.maximum(size - WINDOW + 1, 0)
    at = np.arange(len(doc)) + (offsets[:-1] - first)[doc]
    least = least[at]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else none
    return least[new], at[new], np.diff(np.r_[new, len(doc)]), doc[new]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols (0 to 256) in the order of their first `depth` symbols at least, by prefix doubling from seven on.

    That much order is enough for prefixes below `depth`: rows that tie then move only among
    themselves under the LF-mapping, never across a boundary of a shorter common prefix.
    """
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(8, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.zeros(n + depth, np.int64)  # 0: behind the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    reach = 7
    while reach < depth and not new.all():
        # only suffixes that still tie are sorted anew, inside their ties
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        who = order[tied]
        key = rank[who] * (n + 1) + rank[who + reach]
        again = np.argsort(key)
        order[tied], key = who[again], key[again]
        new[tied] = np.r_[True, key[1:] != key[:-1]]
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
        reach *= 2
    return order


def parted(symbols: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Where neighbours in suffix order share fewer than threshold symbols (up to an END).

    Backward extension goes level by level. On level l a boundary with a common prefix of l symbols
    has just been set; every pair of successive rows with the same preceding symbol whose rows
    straddle such a boundary maps, one symbol further left, to neighbours with l + 1 in common.
    Boundaries unset after level threshold - 1 share at least threshold symbols.
    """
    n = len(order)
    preceding = symbols[order - 1]  # of the first suffix: the last symbol, an END
    rows = np.argsort(preceding, kind="stable").astype(np.int32)  # by LF-mapped position
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    starts = symbols[order]
    fresh = np.flatnonzero(starts[1:] != starts[:-1]) + 1  # level 0: different first symbols
    known[fresh] = True
    before = preceding[rows]
    # LF-mapped rows whose upper neighbour begins with the same symbol
    goal = (np.flatnonzero((before[1:] == before[:-1]) & (before[1:] != END)) + 1).astype(np.int32)
    upper, lower = rows[goal - 1], rows[goal]
    near = lower - upper == 1  # a boundary between the two is the row itself: no search
    mapped = np.zeros(n + 1, np.int32)
    mapped[lower[near]] = goal[near]
    goal, upper, lower = goal[~near], upper[~near], lower[~near]
    flags, seen = np.zeros(n + 1, np.int8), np.empty(n + 1, np.int32)
    for _ in range(threshold - 1):
        flags[fresh] = 1
        np.cumsum(flags, dtype=np.int32, out=seen)
        flags[fresh] = 0
        hit = seen[lower] != seen[upper]
        next_to = mapped[fresh]
        fresh = np.r_[goal[hit], next_to[(next_to > 0) & ~known[next_to]]]
        if not len(fresh):
            break
        known[fresh] = True
        rest = ~hit
        goal, upper, lower = goal[rest], upper[rest], lower[rest]
    return known[:n]


def earliest(data: np.ndarray, start: np.ndarray, size: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, begin, windows, least) of successive windows of each segment that have one smallest holder among all segments with that window."""
    symbols = np.zeros(int(size.sum()) + len(size), np.int16)
    head = np.cumsum(size + 1) - (size + 1)
    inside = np.ones(len(symbols), bool)
    inside[head + size] = False
    symbols[inside] = _gather(data, start, size)
    symbols[inside] += 1
    order = suffix_array(symbols, WINDOW + 1)
    cut = parted(symbols, order, WINDOW)
    segment = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    whole = np.arange(len(symbols)) <= (head + size - WINDOW)[segment]
    held = np.where(whole, holder[segment], C.NO_ID)[order]
    first = np.flatnonzero(cut)
    least = np.empty(len(symbols), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(held, first), np.diff(np.r_[first, len(order)]))
    at = np.flatnonzero(whole)
    least, segment = least[at], segment[at]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (segment[1:] != segment[:-1])])
    return segment[new], at[new] - head[segment[new]], np.diff(np.r_[new, len(at)]), least[new]


def _groups(values: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Distinct values of a sorted array, and where each lies."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[at], [slice(a, b) for a, b in zip(at, np.r_[at[1:], len(values)])]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return data[at]


def codes(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in the upper, 32-bit fingerprint in the lower half: equal fingerprints only make a group larger."""
    mixed = C.mix(keys)
    return ((mixed % np.uint64(n_shards)) << np.uint64(32)) | (mixed >> np.uint64(32))


def _repeated_segments(docs: pa.Table, replies: pa.Table, n_shards: int):
    """Segments of this block whose fingerprint two documents hold, and the distinct ones among them."""
    data, offsets = C.binary_column(docs["data"])
    ids = C.ids_of(docs["doc_id"])
    key, start, windows, doc = segments(data, offsets)
    code = codes(key, n_shards)
    use, hot = np.zeros(len(code), bool), np.zeros(len(code), bool)
    if replies.num_rows and len(code):
        prints = [C.read(x, np.uint32) for x in replies["prints"]]
        known = np.concatenate([np.uint64(s.as_py() << 32) | p.astype(np.uint64) for s, p in zip(replies["shard"], prints)])
        common = np.concatenate([np.unpackbits(C.read(x, np.uint8), count=len(p)) for x, p in zip(replies["hot"], prints)]).astype(bool)
        order = np.argsort(known)
        known, common = known[order], common[order]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        use = known[at] == code
        hot = use & common[at]
    code, start, windows, doc, hot = code[use], start[use], windows[use], doc[use], hot[use]
    if hot.any():
        count = np.where(hot, windows, 1)
        of = np.repeat(np.arange(len(code)), count)
        start = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        code, windows, doc, hot = code[of], np.where(hot, 1, windows)[of], doc[of], hot[of]
        code[hot] = codes(C.span_hashes(data, start[hot], start[hot] + WINDOW), n_shards)
    size = windows + WINDOW - 1
    first_at, number = distinct(data, start, size)
    return data, offsets, ids, code, start, size, doc, first_at, number


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first segment of each content, and the number of each segment's content; equal hashes are held against the bytes."""
    name = C.span_hashes(data, start, start + size)
    _, rep, same = np.unique(name, return_index=True, return_inverse=True)
    other = rep[same]
    equal = size == size[other]
    check = np.flatnonzero(equal & (other != np.arange(len(size))))
    ends = np.cumsum(size[check])
    for c in _groups(ends // (1 << 20))[1] if len(check) else ():
        p = check[c]
        differs = _gather(data, start[p], size[p]) != _gather(data, start[other[p]], size[p])
        equal[p] = np.add.reduceat(differs, np.cumsum(size[p]) - size[p]) == 0
    if not equal.all():
        numbers: dict[bytes, int] = {}
        same = np.array([numbers.setdefault(data[a : a + n].tobytes(), len(numbers)) for a, n in zip(start.tolist(), size.tolist())])
        _, rep = np.unique(same, return_index=True)
    return rep, same


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes).

    Texts are UTF-8 bytes, null as empty; matches never cross documents and are judged on the input.
    A repeated doc_id is one document, so its rows don't remove each other's bytes. A null doc_id
    counts as larger than all others. Texts under 50 bytes stay whole. No rows: no rows.
    """
    n_bytes = C.text_bytes(docs)
    n_shards = max(16, -(-n_bytes // SHARD_BYTES))
    blocks = C.in_blocks(docs, C.count_of_blocks(n_bytes)).groupBy("block")

    def hashes(key: Key, docs: pa.Table) -> pa.Table:
        data, offsets = C.binary_column(docs["data"])
        ids = C.ids_of(docs["doc_id"])
        keys, _, _, doc = segments(data, offsets)
        code = codes(keys, n_shards)
        order = np.argsort(code)
        code, held = code[order], ids[doc[order]]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(held, at) != np.maximum.reduceat(held, at) if len(at) else np.zeros(0, bool)
        # a byte: whether several documents hold it, and the logarithm of how many segments do
        marks = np.log2(np.diff(np.r_[at, len(code)])).astype(np.uint8) | (several.astype(np.uint8) << 7)
        code = code[at]
        used, cut = _groups(code >> np.uint64(32))
        return pa.table({
            "shard": pa.array(used.astype(np.int32)), "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "prints": C.packed([code[c].astype(np.uint32) for c in cut]), "marks": C.packed([marks[c] for c in cut]),
        })

    def repeated(key: Key, asked: pa.Table) -> pa.Table:
        sent = [C.read(x, np.uint32) for x in asked["prints"]]
        marks = np.concatenate([C.read(x, np.uint8) for x in asked["marks"]])
        prints, number, blocks_with = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        twice = blocks_with > 1  # sent by two blocks, or once with its mark
        twice[number[marks >= 128]] = True
        swollen = np.bincount(number, np.exp2(marks & 127), len(prints)) > HOT_SEGMENTS
        blocks, out, hot = [], [], []
        for block, mine in zip(asked["block"].to_pylist(), sent):
            at = np.searchsorted(prints, mine)
            at = at[twice[at]]
            if len(at):
                blocks.append(block)
                out.append(prints[at])
                hot.append(np.packbits(swollen[at]))
        return pa.table({"block": pa.array(blocks, pa.int32()), "shard": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "prints": C.packed(out), "hot": C.packed(hot)})

    def send(key: Key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """Distinct segments as columns of numbers (number, fingerprint, size, smallest and largest doc_id), then their bytes."""
        import zstandard

        data, _, ids, code, start, size, doc, first_at, number = _repeated_segments(docs, replies, n_shards)
        n = len(first_at)
        low, high = np.full(n, C.NO_ID), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, number, ids[doc])
        np.maximum.at(high, number, ids[doc])
        code, start, size = code[first_at], start[first_at], size[first_at]
        order = np.argsort(code, kind="stable")
        used, cut = _groups(code[order] >> np.uint64(32))
        squeeze, rows = zstandard.ZstdCompressor(level=3).compress, []
        for c in cut:
            p = order[c]
            parts = p.astype(np.int32), code[p].astype(np.uint32), size[p].astype(np.int32), low[p], high[p], _gather(data, start[p], size[p])
            rows.append(squeeze(b"".join(x.tobytes() for x in parts)))
        return pa.table({
            "shard": pa.array(used.astype(np.int32)), "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "n": pa.array([c.stop - c.start for c in cut], pa.int32()), "bytes": pa.array(rows, pa.binary()),
        })

    def match(key: Key, sent: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        parts: list[list[np.ndarray]] = []
        count = sent["n"].to_numpy()
        for n, x in zip(count.tolist(), sent["bytes"]):
            raw, at, row = expand(x.as_buffer()), 0, []
            for kind in (np.int32, np.uint32, np.int32, np.int64, np.int64):
                row.append(np.frombuffer(raw, kind, n, at))
                at += row[-1].nbytes
            parts.append([*row, np.frombuffer(raw, np.uint8, offset=at)])
        number, keys, size, first, last, data = (np.concatenate(x) for x in zip(*parts))
        size = size.astype(np.int64)
        block = np.repeat(sent["block"].to_numpy(), count)
        start = np.cumsum(size) - size
        # equal segments become one, with the smallest doc_id of all blocks
        rep, same = distinct(data, start, size)
        low = np.full(len(rep), C.NO_ID)
        np.minimum.at(low, same, first)
        order = np.argsort(keys[rep], kind="stable")
        _, cut = _groups(keys[rep][order])
        group = np.array([c.start for c in cut] + [len(order)])
        alone = np.diff(group) == 1  # one segment is one interval at every window
        one = order[group[:-1][alone]]
        parts_of = [(one, np.zeros(len(one), np.int64), size[rep[one]] - WINDOW + 1, low[one])]
        # groups of several go into the index together, so many bytes at a time
        several = np.repeat(~alone, np.diff(group))
        members, weight = order[several], size[rep[order]]
        number_of = np.repeat(np.arange(len(cut)), np.diff(group))[several]
        before = np.r_[0, np.cumsum(weight[several])][np.searchsorted(number_of, number_of)] // INDEX_BYTES if len(members) else members
        for c in _groups(before)[1]:
            who = members[c]
            segment, offs, length, holder = earliest(data, start[rep[who]], size[rep[who]], low[who])
            parts_of.append((who[segment], offs, length, holder))
        segment, offs, length, holder = (np.concatenate(x) for x in zip(*parts_of))
        by_segment = np.argsort(segment, kind="stable")
        offs, length, holder = offs[by_segment], length[by_segment], holder[by_segment]
        count = np.bincount(segment, minlength=len(rep))
        begin = np.cumsum(count) - count
        take = np.repeat(begin[same] - (np.cumsum(count[same]) - count[same]), count[same]) + np.arange(count[same].sum())
        row = np.repeat(np.arange(len(same)), count[same])
        useful = holder[take] < last[row]  # else no document of that block loses the run
        take, row = take[useful], row[useful]
        used, parts = _groups(block[row])
        return pa.table({
            "block": pa.array(used, pa.int32()), "number": C.packed([number[row[p]] for p in parts]), "start": C.packed([offs[take[p]].astype(np.int32) for p in parts]),
            "length": C.packed([length[take[p]].astype(np.int32) for p in parts]), "holder": C.packed([holder[take[p]] for p in parts]),
        })

    def remove(key: Key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """replies: rows of both rounds, told apart by what is null."""
        import pyarrow.compute as pc

        first = replies.filter(pc.is_valid(replies["prints"]))
        second = replies.filter(pc.is_valid(replies["number"]))
        data, offsets, ids, _, start, size, doc, _, number = _repeated_segments(docs, first, n_shards)
        depth = np.zeros(len(data) + 1, np.int32)
        if second.num_rows:
            which, begin, length, holder = (np.concatenate([C.read(x, t) for x in second[k]]) for k, t in (("number", np.int32), ("start", np.int32), ("length", np.int32), ("holder", np.int64)))
            order = np.argsort(which, kind="stable")
            which, begin, length, holder = which[order], begin[order], length[order], holder[order]
            lo, hi = np.searchsorted(which, number, "left"), np.searchsorted(which, number, "right")
            count = hi - lo
            run = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            seg = np.repeat(np.arange(len(number)), count)
            gone = holder[run] < ids[doc[seg]]
            a = start[seg[gone]] + begin[run[gone]]
            depth += np.bincount(a, minlength=len(depth)).astype(np.int32)
            depth -= np.bincount(a + length[run[gone]] - 1 + WINDOW, minlength=len(depth)).astype(np.int32)
        covered = np.cumsum(depth[:-1]) > 0
        before = np.r_[False, covered[:-1]]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before[edge] = False
        total, heads = np.r_[0, np.cumsum(covered)], np.r_[0, np.cumsum(covered & ~before)]
        raw, kept = data.tobytes(), []
        for a, b in zip(offsets, offsets[1:]):
            gone = total[b] - total[a]
            kept.append(raw[a:b] if not gone else b"" if gone == b - a else data[a:b][~covered[a:b]].tobytes())
        return pa.table({
            "doc_id": docs["doc_id"], "n_bytes": np.diff(offsets), "n_removed": (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64),
            "n_spans": (heads[offsets[1:]] - heads[offsets[:-1]]).astype(np.int64), "kept": pa.array(kept, pa.binary()),
        })

    known = blocks.applyInArrow(hashes, HASHES).groupBy("shard").applyInArrow(repeated, REPEATED)
    sent = blocks.cogroup(known.groupBy("block")).applyInArrow(send, SEGMENTS)
    runs = sent.groupBy("shard").applyInArrow(match, RUNS)
    both = known.unionByName(runs, allowMissingColumns=True)
    return blocks.cogroup(both.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """The contract, word for word; for small fixtures."""
    first: dict[bytes, int] = {}
    for doc, raw in texts:
        for i in range(len(raw) - WINDOW + 1):
            w = raw[i : i + WINDOW]
            first[w] = min(first.get(w, doc), doc)
    out = {}
    for doc, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - WINDOW + 1):
            if first[raw[i : i + WINDOW]] < doc:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
    return out
