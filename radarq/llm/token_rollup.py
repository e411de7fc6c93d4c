"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A change is a signed row: +1 document and its tokens for an insert, the same negated for a delete,
both for a revision. A batch of changes is summed to a few delta rows and committed under its id, by
a rename: a batch that is there is never counted twice, however often it is sent. Totals are the sum
of all committed deltas; compaction folds them into one and remembers which batches it holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, batch string, d_docs long, d_tokens long"
SLICE = 256


def counter(version: str):
    """Texts to numbers of tokens, for a public tokenizer by the name of its file."""
    path = public_tokenizers.path(version)
    if version.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    encoder = tokens.encoder(path)
    return lambda texts: [len(x) for x in encoder.ids(texts)]


_counters: dict = {}


def count_tokens(docs: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for each row and tokenizer version; null text has no tokens.

    Repeated rows are counted each, null keys stay null, texts of any length are counted whole, other
    columns are left out. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text", SLICE):
            texts = [t or "" for t in piece["text"].to_pylist()]
            for v in versions:
                if v not in _counters:
                    _counters[v] = counter(v)
                yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "source": piece["source"], "lang": piece["lang"], "tokenizer": pa.array([v] * len(texts), pa.string()), "n_tokens": pa.array(np.array(_counters[v](texts), np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that replace others, under the same keys or not."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Committed deltas under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.Path(f"{self.path}/deltas"))

    def batches(self) -> DataFrame:
        """(batch) ids of committed batches, folded ones included."""
        names = self._names()
        found = self.spark.createDataFrame([(n[6:],) for n in names if n.startswith("batch=")], "batch string")
        return found.union(self._ids(names).filter("batch is not null").select("batch")).distinct()

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/deltas")))

    def _ids(self, names: list[str]) -> DataFrame:
        """(batch, fold): the batches that the folds among names hold, and the older folds that they replace."""
        paths = [f"{self.path}/deltas/{n}/ids" for n in names if n.startswith("folded=")]
        kind = "batch string, fold string"
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _committed(self, batch: str) -> bool:
        names = self._names()
        return f"batch={batch}" in names or bool(self._ids(names).filter(F.col("batch") == batch).limit(1).count())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sum and add a batch of changes; False, and nothing done, if the batch is there already.

        Changes without rows commit an empty batch. Null sources, languages or tokenizers are groups
        of their own.
        """
        if not batch or any(c in batch for c in "/=\\"):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._committed(batch):
            return False
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        delta.filter("d_docs <> 0 or d_tokens <> 0").coalesce(1).write.parquet(staged)
        if self._move(staged, f"{self.path}/deltas/batch={batch}"):
            return True
        self._fs.delete(self._path(staged), True)  # another attempt of the same batch was first
        return False

    def _move(self, old: str, new: str) -> bool:
        """Rename old to new if there is no new; FileSystem.rename would move old into it."""
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(old).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(old), self._path(new), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _deltas(self) -> tuple[list[str], list[str], list[str]]:
        """Names, from one listing, of the folds and of the batches that count, and of what a fold has taken the place of."""
        names = self._names()
        given = [n[6:] for n in names if n.startswith("batch=")]
        told = self._ids(names).filter(F.col("fold").isNotNull() | F.col("batch").isin(given)).collect()  # of what is listed only
        over = {f"batch={r.batch}" for r in told if r.batch is not None} | {r.fold for r in told if r.fold is not None}
        return [n for n in names if n.startswith("folded=") and n not in over], [n for n in names if n.startswith("batch=") and n not in over], [n for n in names if n in over]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups at zero are gone."""
        folded, names, _ = self._deltas()
        return self._sum(folded, names)

    def _sum(self, folded: list[str], names: list[str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{n}/sums" for n in folded] + [f"{self.path}/deltas/{n}" for n in names]
        kind = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        deltas = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        out = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all deltas into one table of sums; a crash leaves either the old or the new state.

        The new fold comes by one rename and names what it replaces: from then on readers skip that, and
        it goes now or, after a crash, with the next compaction. Sums and ids are of one listing: a batch
        that is committed meanwhile stays as it is. One compaction at a time.
        """
        folded, names, over = self._deltas()
        if names:
            self._fold(folded, names, over)
        for n in (*over, *names, *(folded if names else ())):
            self._fs.delete(self._path(f"{self.path}/deltas/{n}"), True)

    def _fold(self, folded: list[str], names: list[str], over: list[str]) -> None:
        replaced = [*folded, *(n for n in over if n.startswith("folded="))]
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self._sum(folded, names).select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens")).coalesce(1).write.parquet(f"{staged}/sums")
        new = self.spark.createDataFrame([*((n[6:], None) for n in names), *((None, n) for n in replaced)], "batch string, fold string")
        new.union(self._ids(folded).filter("batch is not null")).write.parquet(f"{staged}/ids")
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/deltas/folded={uuid.uuid4().hex}")):
            raise OSError(f"cannot move {staged}")


VERSIONS = ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after inserts, a repeat, revisions, deletes and a compaction.

    One half is inserted, sent again (which counts once), deleted and inserted anew; the other one is
    inserted with the first half of each text and then revised.
    """
    docs = C.table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, f"{C.scratch_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2))
    draft = docs.filter(half == 1).withColumn("text", F.expr("substring(text, 1, length(text) div 2)"))
    # numbers only: texts are counted once
    kept = {"whole": docs, "draft": draft}
    for name, rows in kept.items():
        count_tokens(rows, VERSIONS).write.parquet(f"{rollup.path}/counts-{name}")
    whole, before = (spark.read.parquet(f"{rollup.path}/counts-{name}") for name in kept)
    one, two = (whole.filter(half == k) for k in (0, 1))
    rollup.commit("inserts-0", inserts(one))
    rollup.commit("inserts-1", inserts(before))
    rollup.commit("inserts-0", inserts(one))
    rollup.commit("revisions-1", revisions(before, two))
    rollup.commit("deletes-0", deletes(one))
    rollup.compact()
    rollup.commit("inserts-2", inserts(one))
    for name in kept:
        rollup._fs.delete(rollup._path(f"{rollup.path}/counts-{name}"), True)
    return rollup.totals()
