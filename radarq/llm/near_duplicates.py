"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Documents are sets of five-word shingles. A forest of TREES tries over signature prefixes, each
sorted, gives candidates: a match is shortened from DEPTH hashes down to the longest prefix at which
the forest finds a pair at the threshold with the target probability. Matches tie documents into
coarse clusters; each cluster, cut into tiles of bounded size, is verified exactly, so every link
inside it counts, whichever match found it. What goes between tasks is signatures, ids and, for
documents in clusters, shingle hashes; pairs are counted in place and never emitted, only a spanning
set of links is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.998
TILE_SHINGLES = 1_000_000
TILE_MEMBERS = 2048
SPREAD = 8  # parts of a cluster at least, down to SMALL_TILE members each: no task has most of it
SMALL_TILE = 256
SLICE = 512

_rng = np.random.default_rng(20240607)
TURN = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32)
FACTOR = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1)


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which TREES tries reach the recall for a pair at the threshold."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words, but not none, has one shingle."""
    word, bounds = C.word_hashes(data, offsets)
    n = len(word)
    roll = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + word[j : j + len(roll)]
    roll = C.mix(roll)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(roll[a : b - words + 1]))
        elif b > a:
            mixed = np.uint64(b - a)
            for w in word[a:b].tolist():
                mixed = np.uint64((int(mixed) * 0x9E3779B97F4A7C15 + w) & (2**64 - 1))
            out.append(C.mix(np.array([mixed])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES x DEPTH least values of 32-bit permutations of a non-empty set of hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(TURN), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(low), 256):
        x = (low[k : k + 256, None] ^ TURN) * FACTOR
        x ^= x >> np.uint32(15)
        np.minimum(best, x.min(0), out=best)
    return best


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            piece = batch.slice(k, SLICE)
            sets = shingles(*C.binary_column(piece["data"]))
            known: dict[bytes, bytes] = {}
            names, signs = [], []
            for x in sets:
                name = C.mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(x)), np.bitwise_xor.reduce(C.mix(x)) if len(x) else np.uint64(0)])).tobytes()
                if len(x) and name not in known:
                    known[name] = signature(x).tobytes()
                names.append(name if len(x) else None)
                signs.append(known.get(name) if len(x) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "name": pa.array(names, pa.binary()), "n": pa.array([len(x) for x in sets], pa.int64()), "sign": pa.array(signs, pa.binary())})


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own tries first: links among its documents, and one row for each of its prefixes."""
    depth = least_depth()
    for batch in batches:
        reps = batch["rep"].to_numpy()
        signs = np.frombuffer(b"".join(batch["sign"].to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
        for tree in range(TREES):
            yield from _link(tree, signs[:, tree], reps, depth, True)


def _link(tree: int, signs: np.ndarray, reps: np.ndarray, depth: int, leaders: bool) -> Iterator[pa.RecordBatch]:
    """Sorted trie of one tree: each document is linked to its neighbour where their prefix is long enough."""
    order = np.lexsort((reps, *signs.T[::-1]))
    signs, reps = signs[order], reps[order]
    shared = np.cumprod(signs[1:] == signs[:-1], 1).sum(1)  # common prefix with the neighbour
    match = shared >= depth
    none = np.zeros(int(match.sum()), bool)
    heads = np.flatnonzero(np.r_[True, ~match]) if len(reps) else np.zeros(0, np.int64)
    a, b = reps[1:][match], reps[:-1][match]
    yield pa.RecordBatch.from_pydict({
        "tree": pa.array(np.full(len(a) + leaders * len(heads), tree), pa.int32()), "a": np.r_[a, reps[heads]] if leaders else a, "b": pa.array(np.r_[b, reps[heads]] if leaders else b, pa.int64(), mask=np.r_[none, np.ones(len(heads), bool)] if leaders else None),
        "sign": pa.array([None] * len(a) + ([x.tobytes() for x in signs[heads]] if leaders else []), pa.binary()),
    })


def _far_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the tasks' prefixes; rows come sorted by tree and prefix."""
    depth, kept = least_depth(), None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        tree, reps = rows["tree"].to_numpy(), rows["a"].to_numpy()
        signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint32).reshape(-1, DEPTH)
        for t in np.unique(tree):
            yield from _link(int(t), signs[tree == t], reps[tree == t], depth, False)
        kept = rows.slice(rows.num_rows - 1)  # its prefix may go on in the next batch


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), by hooking to the least neighbour and jumping.

    Nothing is gathered: each round is a shuffle by node, cut off by checkpoint().
    """
    both = edges.filter("a <> b").select("a", "b").distinct()
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    while True:
        # the least root among neighbours, then the root's own root
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        hook = step.groupBy("root").agg(F.min("low").alias("best"))
        step = step.join(hook, "root").select("node", "root", F.least("low", "best").alias("next"))
        jump = step.select(F.col("node").alias("hop"), F.col("next").alias("over"))
        after = step.join(jump, step.next == jump.hop, "left").select("node", F.col("root").alias("was"), F.least("next", "over").alias("root")).checkpoint()
        changed = after.filter("root <> was").limit(1).count()
        label = after.select("node", "root")
        if not changed:
            return label


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member, and a spanning set of them, over pairs (left, right) of sets; each pair within left once if same."""
    members = np.unique(np.r_[left, right])
    where = np.full(len(sets), -1)
    where[members] = np.arange(len(members))
    size = np.array([len(sets[m]) for m in members], np.float64)
    flat = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), size.astype(np.int64))
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    use = df[column] > 1
    column, owner = column[use], owner[use]
    _, column = np.unique(column, return_inverse=True)
    l, r = where[left], where[right]
    common = np.zeros((len(l), len(r)), np.float32)
    row_l, row_r = np.full(len(members), -1), np.full(len(members), -1)
    row_l[l], row_r[r] = np.arange(len(l)), np.arange(len(r))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide = max(64, min(4096, (32 << 20) // (4 * (len(l) + len(r)))))
    top = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, top, wide):
        a, b = np.searchsorted(column, [k, k + wide])
        c, o = column[a:b] - k, owner[a:b]
        x, y = np.zeros((len(l), wide), np.float32), np.zeros((len(r), wide), np.float32)
        i, j = row_l[o] >= 0, row_r[o] >= 0
        x[row_l[o[i]], c[i]] = 1
        y[row_r[o[j]], c[j]] = 1
        some, other = x.any(1), y.any(1)
        if some.all() and other.all():
            common += x @ y.T
        elif some.any() and other.any():
            common[np.ix_(some, other)] += x[some] @ y[other].T
    # |A n B| / |A u B| >= t without rounding at the edge: thresholds as tenths of a thousand
    t = round(threshold * 10000)
    linked = 10000 * common.astype(np.float64) >= t * (size[l][:, None] + size[r][None, :] - common)
    if same:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    n = np.bincount(left[i], minlength=len(sets)) + np.bincount(right[j], minlength=len(sets))
    # spanning links, breadth first over the two sides
    links, free_l, free_r = [], np.ones(len(left), bool), np.ones(len(right), bool)
    if same:
        linked |= linked.T
    for seed in np.flatnonzero(linked.any(1)):
        queue = [seed] if free_l[seed] else []
        free_l[seed] = False
        if same:
            free_r = free_l
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & free_r)
            links += [(int(left[i]), int(right[j])) for j in new]
            free_r[new] = False
            if same:
                queue += new.tolist()
            else:
                for j in new:
                    back = np.flatnonzero(linked[:, j] & free_l)
                    links += [(int(left[k]), int(right[j])) for k in back]
                    free_l[back] = False
                    queue += back.tolist()
    return n, links


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; each tile gives its members' numbers of links, and spanning links."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        cut = _edges(rows)
        last = cut[-2] if len(cut) > 1 else 0
        for a, b in zip(cut[:-2], cut[1:-1]):
            yield _tile(rows.slice(a, b - a))
        kept = rows.slice(last)
    if kept is not None and kept.num_rows:
        cut = _edges(kept)
        for a, b in zip(cut, cut[1:]):
            yield _tile(kept.slice(a, b - a))


def _edges(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(1, np.int64)
    key = np.stack([rows[k].to_numpy() for k in ("root", "i", "j")], 1)
    return np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, rows.num_rows]


def _tile(rows: pa.Table) -> pa.RecordBatch:
    part, rep = rows["part"].to_numpy(), rows["rep"].to_numpy()
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    sets = [C.read(x, np.uint64) for x in rows["set"]]
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    if not len(left) or not len(right):
        n, links = np.zeros(len(rep), np.int64), []
    else:
        n, links = verify(sets, left, right, i == j)
    linked = np.flatnonzero(n)
    return pa.RecordBatch.from_pydict({
        "rep": pa.array(np.r_[rep[linked], rep[[a for a, _ in links]]].astype(np.int64)), "n": pa.array(np.r_[n[linked], np.zeros(len(links), np.int64)].astype(np.int64)),
        "other": pa.array(np.r_[rep[linked], rep[[b for _, b in links]]].astype(np.int64)),
    })


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_id, n_links.

    copy_id: the smallest doc_id with the same set of five-word shingles. n_links: how many other such
    sets of its cluster have a Jaccard similarity of 0.8 or more with it, counted exactly; the forest puts
    a pair at the threshold in one cluster with probability RECALL or more. class_id: the smallest doc_id
    reached over links. Texts of one to four words have one shingle; texts without words (or null) are
    alone in their class and have no links. A very long text is one set, held whole by the task that has
    it. A null doc_id gets nulls and takes no part; repeated rows are copies. No rows: no rows.
    """
    spark = docs.sparkSession
    C.scratch_dir(spark)
    data = C.data_of(docs)
    signed = C.write_scratch(data.filter(F.col("doc_id").isNotNull()).mapInArrow(_signed, "doc_id long, name binary, n long, sign binary"), "signed")
    classes = signed.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("sign").alias("sign"), F.first("n").alias("n"))
    classes = C.write_scratch(classes, "classes")

    local = C.write_scratch(classes.select("rep", "sign").mapInArrow(_local_links, "tree int, a long, b long, sign binary"), "tries")
    leaders = local.filter("b is null").select("tree", "a", "sign")
    leaders = leaders.repartition("tree", F.substring("sign", 1, 4 * least_depth())).sortWithinPartitions("tree", "sign")
    far = leaders.mapInArrow(_far_links, "tree int, a long, b long, sign binary")
    coarse = components(local.filter("b is not null").select("a", "b").union(far.select("a", "b")))

    # tiles: clusters cut into parts of bounded shingles and members, and all pairs of parts
    member = coarse.select(F.col("node").alias("rep"), "root").join(classes.select("rep", "n"), "rep")
    cuts = member.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_MEMBERS), F.least(F.lit(SPREAD), F.ceil(F.count("*") / SMALL_TILE))).cast("int").alias("cuts"))
    member = member.join(cuts, "root").select("root", "rep", "cuts", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int").alias("part"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                piece = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_pydict({**{c: piece[c] for c in ("root", "rep", "cuts", "part")}, "set": C.packed(shingles(*C.binary_column(piece["data"])))})

    texts = data.join(member, data.doc_id == member.rep).select("root", "rep", "cuts", "part", "data")
    full = texts.mapInArrow(sets, "root long, rep long, cuts int, part int, set binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    tiled = full.select("root", "rep", "part", "set", F.explode(pairs).alias("t")).select("root", "t.i", "t.j", "rep", "part", "set")
    tiled = tiled.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep")
    checked = C.write_scratch(tiled.mapInArrow(_tiles, "rep long, n long, other long"), "links")

    groups = components(checked.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = checked.groupBy("rep").agg(F.sum("n").alias("n_links"))
    found = classes.select("name", "rep").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    found = found.select("name", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "name").join(found, "name", "left")
    out = out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    missing = data.filter(F.col("doc_id").isNull()).select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("class_id", "copy_id", "n_links")))
    return out.union(missing)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
