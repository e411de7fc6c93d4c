"""Helpers shared by the training-data operators: shared scratch tables, blocks and vectorised text.

Large tables are dealt into *blocks* (groups of whole documents, a few MB each) and index keys into
*shards* (hash ranges). Blocks send each shard one packed row of distinct keys and get one packed row
back, so a key that a third of all documents hold costs one entry a block, wherever it is counted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other
BLOCK_BYTES = 8 << 20
MIN_BLOCKS = 64
SLICE_BYTES = 4 << 20

Key = tuple[pa.Scalar, ...]

_recorders: list[list[str]] = []


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Paths of scratch tables written inside go to paths; whoever records may drop them later."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded tables; call only when nothing lazy reads them any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found


def write_scratch(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here. options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}-{name}"
    df.write.options(compression="zstd", **options).parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column: sizes blocks and shards."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).head()[0]


def count_of_blocks(n_bytes: int) -> int:
    return max(MIN_BLOCKS, -(-n_bytes // BLOCK_BYTES))


def in_blocks(docs: DataFrame, n_blocks: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(block, doc_id, data) and keep_0, keep_1, ...: UTF-8 text, null as empty.

    Dealt by doc_id and text, so that neither null doc_ids nor the rows of a repeated one meet in one block.
    """
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)),
    )


def data_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, data) and keep_0, keep_1, ...: UTF-8 text, null as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)),
    )


def binary_column(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary column as one uint8 buffer and n + 1 offsets into it; null as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ids_of(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow long column as int64, null as NO_ID."""
    return col.fill_null(NO_ID).to_numpy().astype(np.int64, copy=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """r^j and r^-j modulo a prime under 2^31, as far as asked for so far."""

    def __init__(self, prime: int, r: int):
        self.prime, self.r, self.inv = np.uint64(prime), np.uint64(r), np.uint64(pow(r, -1, prime))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            self.up = np.r_[self.up, self.up * (self.up[-1] * self.r % self.prime) % self.prime]
            self.down = np.r_[self.down, self.down * (self.down[-1] * self.inv % self.prime) % self.prime]
        return self.up, self.down


#: Two primes: modulo a power of two, some texts of two letters have equal hashes for every base.
ROLLS = Powers(2147483647, 1_103_515_245), Powers(2147483629, 1_664_525_013)
PIECE = 1 << 19
AT_ONCE = 1 << 22  # terms under 2^40 whose sums stay below 2^64


def _running(terms: np.ndarray, prime: np.uint64) -> np.ndarray:
    """Running sums of terms under 2^40, from 0 on; of many terms modulo the prime."""
    run = np.zeros(len(terms) + 1, np.uint64)
    if len(terms) <= AT_ONCE:
        np.cumsum(terms, out=run[1:])
        return run
    for k in range(0, len(terms), AT_ONCE):
        run[k + 1 : k + 1 + AT_ONCE] = (np.cumsum(terms[k : k + AT_ONCE]) + run[k]) % prime
    return run


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], of 62 bits drawn from two polynomials; spans ascend by start, and by end."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + PIECE, "left")))
        top = int(end[j - 1])
        symbols = data[base:top].astype(np.uint64) + np.uint64(1)
        a, b = start[i:j] - base, end[i:j] - base
        found = np.zeros(j - i, np.uint64)
        for roll in ROLLS:
            up, down = roll.upto(top - base + 1)
            run = _running(symbols * up[: top - base], roll.prime)
            found = (found << np.uint64(32)) | (run[b] + (roll.prime if len(symbols) > AT_ONCE else np.uint64(0)) - run[a]) % roll.prime * down[a] % roll.prime
        out[i:j] = found
        i = j
    return mix(out ^ mix((end - start).astype(np.uint64)))


#: Word bytes after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and how many words lie before each offset."""
    low = LOWER[data]
    is_word = IS_WORD[low]
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = is_word[edge]
    end[edge - 1] = is_word[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, per document, the range of its words as n + 1 bounds."""
    low, s, e, bounds = word_spans(data, offsets)
    return span_hashes(low, s, e), bounds


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has some rows and some bytes of column at most; a longer value comes alone."""
    for batch in batches:
        size = np.diff(binary_column(batch[column].cast(pa.large_binary()))[1])
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(size[at : at + rows]), most, "right"))
            yield batch.slice(at, max(n, 1))
            at += max(n, 1)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def read(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)
