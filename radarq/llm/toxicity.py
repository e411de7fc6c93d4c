"""Toxicity by the nearest labelled examples.

Terms are words and the first five bytes of longer words; every term of every example is indexed. A
term weighs (1 + log tf) times its idf, counted over all documents, times what the labels tell about
it: from LEAST_WEIGHT for a term that comes alike under both labels up to one. Examples lie in an
inverted index. Lists of rare terms are summed whole; those of frequent terms are cut into blocks of
64 examples with the largest weight of the term in each, and a block is opened only for queries whose
bound in it (their sums of rare terms, and the blocks' largest weights) reaches their k-th best cosine
so far. What may be among the k nearest is then summed anew, so neighbours are exact. Votes weighted
by distance are calibrated by isotonic regression on votes of examples without themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: The bound of the labelled sample: so many documents, by a hash of doc_id, and bytes of text at most,
#: none of them over EXAMPLE_BYTES / 64. Index and vocabulary are bounded by its words.
EXAMPLES = 4096
EXAMPLE_BYTES = 64 << 20
NEIGHBOURS = 16
BLOCK = 64
PREFIX = 5
THRESHOLD = 0.3
LEAST_WEIGHT = 0.2
#: Chi-square at which a term has about 0.7 of the full weight.
HALF_SURPRISE = 100.0
#: So many of the most frequent terms have their lists cut into blocks.
FREQUENT = 512
SLICE = 512
QUERIES = 64  # searched together
NEVER = np.float32(-1e9)

EVIDENCE = "array<struct<doc_id:bigint,cosine:double,toxic:int>>"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the document of each."""
    low, s, e, bounds = C.word_spans(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    long = e - s > PREFIX
    head = C.span_hashes(low, s[long], s[long] + PREFIX) ^ np.uint64(0x5555555555555555)
    return np.r_[C.span_hashes(low, s, e), head], np.r_[owner, owner[long]]


def _counts(term: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) with how often."""
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]) if len(term) else np.zeros(0, np.int64)
    return term[new], owner[new], np.diff(np.r_[new, len(term)])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then those of the next."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class BlockMaxIndex:
    """Unit vectors of examples (ids, labels), searched exactly."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, other: float, ids: np.ndarray, toxic: np.ndarray, term: np.ndarray, row: np.ndarray, tf: np.ndarray):
        """vocabulary: sorted hashes; weight: of each term; other: of terms that no example holds; postings (term number, row, tf)."""
        self.vocabulary, self.weight, self.other, self.ids, self.toxic, self.n = vocabulary, weight, other, ids, toxic, len(ids)
        w = self.weights(term, row, tf, self.n)
        self.held = np.bincount(term, minlength=len(vocabulary))
        frequent = np.sort(np.argsort(-self.held, kind="stable")[:FREQUENT])
        self.column = np.full(len(vocabulary), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        # rows of one block are alike: those with the same heaviest frequent term lie together
        dense = np.zeros((self.n, len(frequent)), np.float32)
        common = self.column[term] >= 0
        dense[row[common], self.column[term[common]]] = w[common]
        order = np.lexsort((ids, dense.argmax(1)))
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.ids, self.toxic, row = ids[order], toxic[order], place[row]
        self.blocks = max(1, -(-self.n // BLOCK))
        self.dense = np.zeros((self.blocks, BLOCK, len(frequent)), np.float32)
        self.dense.reshape(-1, len(frequent))[: self.n] = dense[order]
        self.dense = np.ascontiguousarray(self.dense.transpose(0, 2, 1))
        self.bound = np.ascontiguousarray(self.dense.max(2).T)  # (frequent terms, blocks)
        by_row = np.lexsort((term, row))
        self.row_term, self.row_w = term[by_row].astype(np.int32), w[by_row]
        self.row_start = np.searchsorted(row[by_row], np.arange(self.n + 1))
        rare = np.flatnonzero(~common)
        rare = rare[np.lexsort((row[rare], term[rare]))]
        self.list_row, self.list_w = row[rare].astype(np.int32), w[rare].astype(np.float32)
        self.list_start = np.searchsorted(term[rare], np.arange(len(vocabulary) + 1))

    def weights(self, term: np.ndarray, row: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Weights in unit vectors; a term of -1 is none of the vocabulary and counts in the norm only."""
        w = (1 + np.log(tf)) * np.where(term >= 0, self.weight[term], self.other)
        norm = np.sqrt(np.bincount(row, w * w, minlength=n))
        return w / np.maximum(norm[row], 1e-12)

    def numbered(self, term: np.ndarray) -> np.ndarray:
        """Numbers of terms in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == term, at, -1)

    def search(self, term: np.ndarray, row: np.ndarray, q: np.ndarray, n: int, k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries, given by postings in the order of row: the examples of the k largest positive cosines (ties: the smaller id), and these.

        but: an id for each query whose examples are left out.
        """
        known = term >= 0
        term, row, q = term[known], row[known], q[known]
        cut = np.searchsorted(row, np.arange(n + 1))
        out = []
        for a in range(0, n, QUERIES):
            b = min(n, a + QUERIES)
            part = slice(cut[a], cut[b])
            out += self._search(term[part], row[part] - a, q[part], b - a, k, None if but is None else but[a:b])
        return out

    @staticmethod
    def _kth(sums: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of the k-th largest of each row: the k-th largest of the maxima of eight each."""
        n, wide = sums.shape
        best = sums.reshape(n, -1, 8).max(2)
        if best.shape[1] <= 4 * k:
            return np.partition(sums, wide - k, 1)[:, wide - k] if k else np.zeros(n)
        return np.partition(best, best.shape[1] - k, 1)[:, -k]

    def _search(self, term: np.ndarray, row: np.ndarray, q: np.ndarray, n: int, k: int, but: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        wide, k = self.blocks * BLOCK, min(k, self.n)
        start, count = self.list_start[term], self.list_start[term + 1] - self.list_start[term]
        at = _ranges(start, count)
        sums = np.bincount(np.repeat(row * wide, count) + self.list_row[at], self.list_w[at] * np.repeat(q, count), minlength=n * wide).reshape(n, wide).astype(np.float32)
        column = self.column[term]
        common = column >= 0
        head = np.zeros((n, len(self.bound)), np.float32)
        head[row[common], column[common]] = q[common]
        sums[:, self.n :] = NEVER
        if but is not None:
            sums[:, : self.n][self.ids == but[:, None]] = NEVER
        bound = head @ self.bound + sums.reshape(n, self.blocks, BLOCK).max(2) + 1e-5
        opened = np.zeros((n, self.blocks), bool)
        for most in (4, self.blocks):
            least = self._kth(sums, k)
            to_open = (bound >= least[:, None]) & ~opened
            if most < self.blocks:
                best = np.argpartition(-bound, most, 1)[:, :most]
                few = np.zeros_like(to_open)
                np.put_along_axis(few, best, True, 1)
                to_open &= few
            for block in np.flatnonzero(to_open.any(0)):
                who = np.flatnonzero(to_open[:, block])
                sums[who, block * BLOCK : (block + 1) * BLOCK] += head[who] @ self.dense[block]
            opened |= to_open
        least = self._kth(sums, k)
        near = sums >= np.maximum(least - 1e-4, 1e-9)[:, None]
        edge, query = np.searchsorted(row, np.arange(n + 1)), np.zeros(len(self.vocabulary))
        out = []
        for i in range(n):
            mine = slice(edge[i], edge[i + 1])
            rows = np.flatnonzero(near[i])
            query[term[mine]] = q[mine]
            count = self.row_start[rows + 1] - self.row_start[rows]
            at = _ranges(self.row_start[rows], count)
            cos = np.bincount(np.repeat(np.arange(len(rows)), count), query[self.row_term[at]] * self.row_w[at], minlength=len(rows)).astype(np.float64)
            query[term[mine]] = 0
            best = np.lexsort((self.ids[rows], -np.round(cos, 9)))[:k]
            best = best[cos[best] > 0]
            out.append((rows[best], cos[best]))
        return out


class Examples:
    """What an index is built from, in few bytes: this is broadcast, and each worker builds the index once."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, other: float, ids: np.ndarray, toxic: np.ndarray, term: np.ndarray, size: np.ndarray, tf: np.ndarray):
        tf = tf.astype(np.uint8 if not len(tf) or tf.max() < 256 else np.uint32)
        self.parts = vocabulary, weight.astype(np.float32), other, ids, toxic.astype(np.int8), term.astype(np.int32), size.astype(np.int32), tf
        self._index: BlockMaxIndex | None = None

    def __getstate__(self) -> tuple:
        return self.parts

    def __setstate__(self, parts: tuple) -> None:
        self.parts, self._index = parts, None

    @property
    def index(self) -> BlockMaxIndex:
        if self._index is None:
            vocabulary, weight, other, ids, toxic, term, size, tf = self.parts
            self._index = BlockMaxIndex(vocabulary, weight.astype(np.float64), other, ids, toxic, term, np.repeat(np.arange(len(ids), dtype=np.int32), size), tf.astype(np.int64))
        return self._index


def votes(cos: np.ndarray, toxic: np.ndarray) -> float:
    """Share of the toxic among neighbours, each weighing cos / (1 - cos), nearly."""
    w = cos / (1.05 - np.minimum(cos, 1.0))
    return float((w * toxic).sum() / w.sum()) if len(w) else 0.0


class Calibration:
    """Isotonic regression of labels on votes, with a prior of one example; apart, the share among texts without terms."""

    def __init__(self, vote: np.ndarray, toxic: np.ndarray, without: np.ndarray):
        prior = (toxic.sum() + without.sum() + 0.5) / (len(toxic) + len(without) + 1)
        self.empty = float((without.sum() + prior) / (len(without) + 1))
        order = np.lexsort((toxic, vote))
        pools: list[list[float]] = []  # sum, count, sum of votes
        for v, y in zip(vote[order], toxic[order]):
            pools.append([float(y), 1.0, float(v)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top)]
        self.x = np.array([p[2] / p[1] for p in pools] or [0.0])
        self.y = np.array([(p[0] + prior) / (p[1] + 1) for p in pools] or [prior])
        self.y = np.maximum.accumulate(self.y)

    def __call__(self, vote: float, any_terms: bool) -> float:
        return float(np.interp(vote, self.x, self.y)) if any_terms else self.empty


def relevance(held: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """What labels tell about terms in `held` examples, `toxic` of them toxic: by chi-square with Yates's correction, LEAST_WEIGHT to one."""
    off = np.maximum(np.abs(toxic - held * share) - 0.5, 0)
    surprise = off * off / np.maximum(held * share * (1 - share), 1e-9)
    return np.maximum(np.sqrt(surprise / (surprise + HALF_SURPRISE)), LEAST_WEIGHT)


def sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, data, toxic) of the labelled sample: documents that aren't held out, within its bounds."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    data = C.data_of(docs).filter(F.col("doc_id").isNotNull())
    size = data.select("doc_id", F.octet_length("data").alias("size")).join(F.broadcast(chosen), "doc_id")
    size = size.groupBy("doc_id", "toxic").agg(F.sum("size").alias("size")).filter(F.col("size") <= EXAMPLE_BYTES // 64)
    total = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # `examples` rows
    within = size.withColumn("total", total).filter(F.col("total") <= EXAMPLE_BYTES).select("doc_id", "toxic")
    return data.join(F.broadcast(within), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> tuple[Broadcast[Examples], Calibration] | None:
    """The examples, broadcast, and the calibration of their votes; None without any labelled document."""
    spark = docs.sparkSession
    taken = C.write_scratch(sample(docs, labels, examples), "examples")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "data", SLICE):
            term, owner, tf = _counts(*term_hashes(*C.binary_column(batch["data"])))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            part = [slice(a, b) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "term": C.packed([term[c] for c in part]), "tf": C.packed([tf[c].astype(np.int32) for c in part])})

    rows = taken.mapInArrow(vectors, "doc_id long, toxic int, term binary, tf binary").toArrow().sort_by([("doc_id", "ascending"), ("term", "ascending"), ("tf", "ascending")])
    if not rows.num_rows:
        return None
    ids, toxic = rows["doc_id"].to_numpy(), np.clip(rows["toxic"].to_numpy(), 0, 1).astype(np.int64)
    size, tf = np.array([len(x.as_buffer()) // 4 for x in rows["tf"]]), np.concatenate([C.read(x, np.int32) for x in rows["tf"]])
    words, term = np.unique(np.concatenate([C.read(x, np.uint64) for x in rows["term"]]), return_inverse=True)
    del rows
    if not len(words):
        words = np.zeros(1, np.uint64)
    told = spark.sparkContext.broadcast(words)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = told.value, 0
        df = np.zeros(len(words), np.int64)
        for batch in C.slices(batches, "data", SLICE):
            term, owner, _ = _counts(*term_hashes(*C.binary_column(batch["data"])))
            at = np.minimum(np.searchsorted(words, term), len(words) - 1)
            df += np.bincount(at[words[at] == term], minlength=len(words))
            n += batch.num_rows
        some = np.flatnonzero(df)
        for a in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_pydict({"t": pa.array(some[a : a + (1 << 16)], pa.int32()), "df": df[some[a : a + (1 << 16)]]})
        yield pa.RecordBatch.from_pydict({"t": pa.array([-1], pa.int32()), "df": pa.array([n], pa.int64())})

    stats = C.data_of(docs).select("data").mapInArrow(seen, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    t, n = stats["t"].to_numpy(), stats["df"].to_numpy()
    n_docs, df = int(n[t < 0].sum()), np.zeros(len(words))
    df[t[t >= 0]] = n[t >= 0]
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    weight = idf * relevance(np.bincount(term, minlength=len(words)), np.bincount(term, np.repeat(toxic, size), minlength=len(words)), toxic.mean())
    held = spark.sparkContext.broadcast(Examples(words, weight, LEAST_WEIGHT * (np.log((n_docs + 1) / 2) + 1), ids, toxic, term, size, tf))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "data", SLICE):
            index = held.value.index
            found = neighbours(index, batch["data"], k, C.ids_of(batch["doc_id"]))
            yield pa.RecordBatch.from_pydict({"vote": np.array([votes(c, index.toxic[r]) for r, c, _ in found]), "toxic": batch["toxic"], "any": np.array([x for *_, x in found], bool)})

    v = taken.mapInArrow(alone, "vote double, toxic int, any boolean").toArrow()
    vote, y, some = v["vote"].to_numpy(), np.clip(v["toxic"].to_numpy(), 0, 1), v["any"].to_numpy(zero_copy_only=False).astype(bool)
    return held, Calibration(vote[some], y[some], y[~some])


def neighbours(index: BlockMaxIndex, texts: pa.Array, k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The nearest examples of each text and their cosines, and whether the text has terms."""
    n = len(texts)
    term, owner, tf = _counts(*term_hashes(*C.binary_column(texts)))
    term = index.numbered(term)
    found = index.search(term, owner, index.weights(term, owner, tf, n), n, k, but)
    some = np.bincount(owner, minlength=n) > 0
    return [(r, c, bool(s)) for (r, c), s in zip(found, some)]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), k: int = NEIGHBOURS, **fitting) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, evidence (the neighbours that voted), and columns in keep.

    Null and empty texts have no terms: they get the smoothed share of the toxic among such examples.
    Equal texts get equal scores; of examples at one distance, those of smaller doc_ids count. Labels
    repeated for a doc_id count as toxic if any is; null labels or doc_ids don't count. Without usable
    labels the score is 0. A text of any length is scored whole, in a batch of its own. No rows: no rows.
    """
    model = fit(docs, labels, k=k, **fitting)
    data = C.data_of(docs, keep)
    if model is None:
        none = F.array().cast(EVIDENCE)
        return data.drop("data").withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "evidence": none}).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
    held, calibration = model
    carried = data.schema[2:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value.index
        for batch in C.slices(batches, "data", SLICE):
            own = batch["data"].dictionary_encode()  # equal texts are searched once
            found = neighbours(index, own.dictionary, k)
            told = np.array([calibration(votes(c, index.toxic[r]), some) for r, c, some in found])
            which = own.indices.to_numpy()
            scores, near = told[which], [found[i] for i in which]
            rows = np.concatenate([r for r, _, _ in near])
            evidence = pa.StructArray.from_arrays([pa.array(index.ids[rows]), pa.array(np.concatenate([c for _, c, _ in near])), pa.array(index.toxic[rows].astype(np.int32))], ["doc_id", "cosine", "toxic"])
            cut = np.r_[0, np.cumsum([len(r) for r, _, _ in near])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], **{f.name: batch[f.name] for f in carried}, "score": scores, "predicted": pa.array((scores >= THRESHOLD).astype(np.int32)),
                "evidence": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), evidence),
            })

    shape = T.StructType([data.schema["doc_id"], *carried, *T.StructType.fromDDL(f"score double, predicted int, evidence {EVIDENCE}")])
    return data.mapInArrow(score, shape).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
