"""Benchmark decontamination with DataFrame functions only.

A window of m words holds, wherever it starts, one whole aligned block of b = (m + 1) // 2 words
(blocks start at word 0, b, 2b, ... of the document). So a document is cut into blocks of b words,
the blocks probe a broadcast hash set of all b-grams of the items' windows, and only around a hit
are the candidate windows spelled out and compared, word for word, with the items' windows.
Nothing is shuffled before a window has been verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: The bound under which the set of benchmark n-grams is broadcast; a larger one is joined by shuffle.
BROADCAST_NGRAMS = 5_000_000

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words as an array; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _gram(ws: Column, start: Column, n: Column | int) -> Column:
    """n words from the one-based start, as one string."""
    return F.array_join(F.slice(ws, start, n), " ")


def _grams(ws: Column, n: Column) -> Column:
    """Array of all (pos, gram) of n words, n at most the number of words."""
    return F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: _gram(ws, i, n))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_NGRAMS else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: its columns and n_words, n_hit, n_items, items (sorted strings), contaminated.

    A window is 13 consecutive words of an item, or all words of a shorter one; items without words
    have none. A document word inside any occurrence of a window is hit. Null or empty text: no
    words, not contaminated; texts of any length are judged whole. A repeated doc_id is one document whose rows are judged each by itself;
    equal items count by item_id; a null item_id takes part in hits but not in items.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    m = F.least(F.size("ws"), F.lit(WINDOW))
    windows = items.select("item", m.alias("m"), F.explode(_grams(F.col("ws"), m)).alias("gram"))
    windows = windows.groupBy("m", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sizes = sorted({r.m for r in windows.select("m").distinct().collect()})  # at most 13 of them
    n_grams = windows.count() * (WINDOW // 2 + 1)  # each window has that many b-grams at most

    key = ["_id", "_of"]  # rows alike in doc_id and text have one result
    rows = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(C.NO_ID)).alias("_id"), F.xxhash64("text").alias("_of"), words(F.col("text")).alias("_ws")
    )
    parts = []
    for b in sorted({(m + 1) // 2 for m in sizes}):
        these = [m for m in sizes if (m + 1) // 2 == b]
        grams = windows.filter(F.col("m").isin(these)).select(F.split("gram", " ").alias("ws"))
        grams = grams.select(F.explode(_grams(F.col("ws"), F.lit(b))).alias("_gram")).select(F.xxhash64("_gram").alias("_key")).distinct()
        cut = rows.select(
            *key, "_ws", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("_ws") / b).cast("int")), lambda i: F.xxhash64(_gram(F.col("_ws"), i * b + 1, b)))).alias("_i", "_key")
        )
        if n_grams <= BROADCAST_NGRAMS:
            near = cut.join(F.broadcast(grams), "_key")
        else:  # blocks go without the words of their document, which come back to the hits
            hits = cut.select(*key, "_i", "_key").join(grams, "_key").select(*key, "_i")
            near = hits.join(rows.select(*key, "_ws").dropDuplicates(key), key)
        for m in these:
            low = F.greatest(F.col("_i") * b + 1 - (m - b), F.lit(1))
            high = F.least(F.col("_i") * b + 1, F.size("_ws") - m + 1)
            spelled = near.filter(high >= low).select(
                *key, F.explode(F.transform(F.sequence(low, high), lambda p: F.struct(p.alias("p"), _gram(F.col("_ws"), p, m).alias("gram")))).alias("w")
            )
            found = spelled.select(*key, F.col("w.p").alias("p"), F.col("w.gram").alias("gram")).join(_maybe_broadcast(windows.filter(F.col("m") == m).drop("m"), n_grams), "gram")
            parts.append(found.select(*key, "p", F.lit(m).alias("m"), "items"))

    counted = rows.select(*key, "doc_id", F.size("_ws").cast("long").alias("n_words"))
    if parts:
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        # a document's hit positions are bounded by its own words
        spans = hits.groupBy(*key).agg(
            F.array_sort(F.collect_set(F.struct("p", (F.col("p") + F.col("m")).alias("e")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        merged = F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("top")),
            lambda s, x: F.struct((s.n + F.greatest(x.e - F.greatest(x.p, s.top), F.lit(0))).alias("n"), F.greatest(s.top, x.e).alias("top")),
        )
        spans = spans.select(*key, merged.n.cast("long").alias("n_hit"), "items")
        counted = counted.join(spans, key, "left")
    else:
        counted = counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.lit(None).cast("array<string>")})
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(len(ws), 13) AS m, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM bw WHERE len(ws) > 0)),
pos AS (
  SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, item_id, p, pos.m AS m FROM pos JOIN win ON pos.m = win.m AND pos.gram = win.gram),
cov AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS w FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
