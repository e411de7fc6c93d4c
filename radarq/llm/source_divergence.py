"""Source divergence audit by sorted runs.

A slice of documents is sorted by (language, term, source, document), and a scan of its runs gives each
term's occurrences and documents by source; those partial runs, a few for each term however common it
is, are dealt by (language, term), sorted by source within their task and scanned again as a stream.
A run of one term yields one row with its counts by source, or nothing if too few documents hold it.
The second pass deals these rows by language and bucket next to the language's groups; a bucket adds up
its part of every pair of sources and keeps its best terms, and the parts are summed and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 3
UNIT = 1_000_000_000
TOP = 200
SLICE_BYTES = 8 << 20  # of text sorted at once
BUCKET_TERMS = 20_000
DENSE = 1 << 21  # cells of a matrix at once
RUN_ROWS = 1 << 16  # of one term's run held before its sources are merged

RUN = "lang string, term string, source string, n long, docs long"
TERM = "lang string, term string, sources array<string>, counts array<long>"
PART = "lang string, source string, part string, item string, value long"

#: Term bytes: letters and every byte of a non-ASCII character.
IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


def runs_of(docs: pa.Table) -> pa.RecordBatch:
    """(lang, term, source, n, docs) of some documents, by sorting (lang, term, source, document) and scanning runs."""
    data, offsets = C.binary_column(docs["data"])
    is_term = IS_TERM[data]
    start, end = is_term.copy(), is_term.copy()
    start[1:] &= ~is_term[:-1]
    end[:-1] &= ~is_term[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = is_term[edge]
    end[edge - 1] = is_term[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, s, "right") - 1
    ends = np.r_[0, np.cumsum(e - s)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(C.LOWER[data[is_term]])]).dictionary_encode()
    term = words.indices.to_numpy().astype(np.int64)
    langs, sources = (docs[k].combine_chunks().dictionary_encode() for k in ("lang", "source"))
    lang, source = (x.indices.to_numpy().astype(np.int64)[doc] for x in (langs, sources))
    n_terms, n_sources, n_docs = len(words.dictionary), len(sources.dictionary), len(docs)
    if len(langs.dictionary) * n_terms * n_sources * n_docs < 1 << 62:
        key = np.sort(((lang * n_terms + term) * n_sources + source) * n_docs + doc)
        group, doc = key // max(n_docs, 1), key % max(n_docs, 1)
        source, rest = group % max(n_sources, 1), group // max(n_sources, 1)
        term, lang = rest % max(n_terms, 1), rest // max(n_terms, 1)
    else:
        order = np.lexsort((doc, source, term, lang))
        lang, term, source, doc = lang[order], term[order], source[order], doc[order]
    new = np.r_[True, (term[1:] != term[:-1]) | (source[1:] != source[:-1]) | (lang[1:] != lang[:-1])] if len(term) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    first_of_doc = new.copy()
    first_of_doc[1:] |= doc[1:] != doc[:-1]
    return pa.RecordBatch.from_pydict({
        "lang": langs.dictionary.take(pa.array(lang[at])), "term": words.dictionary.take(pa.array(term[at])).cast(pa.large_string()).cast(pa.string()), "source": sources.dictionary.take(pa.array(source[at])),
        "n": np.diff(np.r_[at, len(term)]).astype(np.int64), "docs": np.add.reduceat(first_of_doc.astype(np.int64), at) if len(at) else np.zeros(0, np.int64),
    })


def partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in C.slices(batches, "data", 1 << 16):
        held.append(piece)
        size += piece["data"].nbytes
        if size >= SLICE_BYTES:
            yield runs_of(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield runs_of(pa.Table.from_batches(held))


def kept_terms(min_docs: int):
    """Scans rows sorted by (lang, term, source) as they come; a term's open run is carried over batches."""

    def close(run: pa.Table) -> pa.RecordBatch:
        """Whole runs of terms: those in enough documents, sources merged."""
        run = run.combine_chunks()
        n, docs = run["n"].to_numpy(), run["docs"].to_numpy()
        new_term, new_source = _changes(run, ("lang", "term")), _changes(run, ("lang", "term", "source"))
        at = np.flatnonzero(new_source)
        counts, first = np.add.reduceat(n, at), np.flatnonzero(new_term)
        enough = np.add.reduceat(docs, first) >= min_docs
        sizes = np.diff(np.r_[np.searchsorted(at, first), len(at)])
        use = np.repeat(enough, sizes)
        ends = pa.array(np.r_[0, np.cumsum(sizes[enough])], pa.int32())
        heads = run.select(["lang", "term"]).take(pa.array(first[enough])).combine_chunks()
        return pa.RecordBatch.from_pydict({
            "lang": _one(heads["lang"]), "term": _one(heads["term"]),
            "sources": pa.ListArray.from_arrays(ends, _one(run["source"].take(pa.array(at[use])))), "counts": pa.ListArray.from_arrays(ends, pa.array(counts[use], pa.int64())),
        })

    def merged(run: pa.Table) -> pa.RecordBatch:
        """Part of one term's run, a row for each source."""
        at = np.flatnonzero(_changes(run, ("source",)))
        heads = run.take(pa.array(at))
        return pa.RecordBatch.from_pydict({c: _one(heads[c]) for c in ("lang", "term", "source")} | {c: np.add.reduceat(run[c].to_numpy(), at) for c in ("n", "docs")})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(np.flatnonzero(_changes(pa.Table.from_batches([batch]), ("lang", "term")))[-1])
            if held and not cut and all(held[-1][c][-1] == batch[c][0] for c in ("lang", "term")):
                held.append(batch)
                if sum(b.num_rows for b in held) > RUN_ROWS:
                    held = [merged(pa.Table.from_batches(held))]
                continue
            whole = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
            if whole:
                yield close(pa.Table.from_batches(whole))
            held = [batch.slice(cut)]
        if held:
            yield close(pa.Table.from_batches(held))

    return scan


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before in any of some columns; the first does."""
    out = np.ones(len(table), bool)
    if len(table) > 1:
        differs = [pc.not_equal(table[c].slice(1), table[c].slice(0, len(table) - 1)).to_numpy() for c in names]
        out[1:] = np.logical_or.reduce([d.astype(bool) for d in differs])
    return out


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) in 64 bits, a thousandth at a time; totals under 9 * 10^15."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Over the rows of counts (terms by sources), the sum of apart(p, q) for every two sources.

    For each source, the terms that it has are held against all others; those that it hasn't share one p,
    so what they add is a sum over all terms, found from the distinct counts of the other, less those it has.
    """
    n = len(totals)
    p, none = share(counts, totals), share(np.zeros(n, np.int64), totals)
    values = []
    for t in range(n):
        seen, times = np.unique(p[:, t], return_counts=True)
        values.append((seen, times))
    out = np.zeros((n, n), np.int64)
    for s in range(n):
        for t in range(n):
            seen, times = values[t]
            out[s, t] = (apart(none[s], seen) * times).sum()
        has = np.flatnonzero(counts[:, s])
        step = max(1, DENSE // n)
        for k in range(0, len(has), step):
            rows = has[k : k + step]
            out[s] += (apart(p[rows, s][:, None], p[rows]) - apart(none[s], p[rows])).sum(0)
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language lies from the others, and by which terms.

    Null text, lang and source are ''. Every row of docs is a document, also where doc_ids repeat or are null.
    A group without terms has rows of part `pair` all the same, of value 0 where its language keeps no term;
    a language with one source has no pairs. Ties rank by the item's bytes. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    n_bytes = C.text_bytes(docs)
    partial = rows.mapInArrow(partial_runs, RUN)
    n_tasks = max(16, -(-n_bytes // (32 << 20)))
    dealt = partial.repartition(n_tasks, "lang", "term").sortWithinPartitions("lang", "term", "source")
    terms = C.write_scratch(dealt.mapInArrow(kept_terms(min_docs), TERM), "terms")

    sums = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = C.write_scratch(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")

    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / BUCKET_TERMS)).cast("int")
    spread = groups.filter("v > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1))).groupBy("lang", "bucket")
    placed = terms.join(kept.withColumn("n_buckets", buckets).select("lang", "n_buckets"), "lang")
    placed = placed.select("lang", "term", "sources", "counts", F.pmod(F.xxhash64("term"), "n_buckets").cast("int").alias("bucket")).groupBy("lang", "bucket")

    def measure(key: C.Key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        names = groups["source"].to_pylist()
        column = {s: i for i, s in enumerate(names)}
        total = groups["n"].to_numpy() + groups["v"].to_numpy()
        whole = np.array([groups["n"].to_numpy().sum() + groups["v"][0].as_py()])
        n = len(names)
        pairs = np.zeros((n, n), np.int64)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        terms = terms.take(pc.sort_indices(terms["term"].combine_chunks().cast(pa.binary())))
        step = max(1, DENSE // n)
        for k in range(0, len(terms), step):
            part = terms.slice(k, step).combine_chunks()
            sources, numbers = _one(part["sources"]), _one(part["counts"])
            of = np.repeat(np.arange(len(part)), pc.list_value_length(sources).to_numpy())
            encoded = sources.flatten().dictionary_encode()
            place = np.array([column[x] for x in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy()]
            counts = np.zeros((len(part), n), np.int64)
            counts[of, place] = numbers.flatten().to_numpy()
            pairs += pair_sums(counts, total)
            p, q = share(counts[of, place], total[place]), share(counts.sum(1), whole)[of]
            far = p > q
            best.append((place[far], k + of[far], apart(p, q)[far]))
        place, row, value = (np.concatenate(x) for x in zip(*best)) if best else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((row, -value, place))  # rows ascend by term
        place, row, value = place[order], row[order], value[order]
        at = np.searchsorted(place, place)
        use = np.arange(len(place)) - at < top
        place, row, value = place[use], row[use], value[use]
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        source = pa.array(names, pa.string())
        return pa.table({
            "lang": pa.array([key[0].as_py()] * (len(i) + len(place)), pa.string()), "source": source.take(pa.array(np.r_[i, place])),
            "part": pa.array(["pair"] * len(i) + ["term"] * len(place), pa.string()),
            "item": pa.concat_arrays([source.take(pa.array(j)), _one(terms["term"].take(pa.array(row)))]), "value": pa.array(np.r_[pairs[i, j], value], pa.int64()),
        })

    found = C.write_scratch(placed.cogroup(spread).applyInArrow(measure, PART), "parts")
    other = groups.select("lang", F.col("source").alias("item"))
    empty = groups.filter("v = 0").select("lang", "source").join(other, "lang").filter("source <> item")
    empty = empty.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(empty)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, i, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
gp AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)::HUGEINT) // (coalesce(n.n, 0) + v.v)::HUGEINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
lp AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.c) + 1)::HUGEINT) // (max(m.n) + max(v.v))::HUGEINT AS q
  FROM k JOIN c USING (lang, term) JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m USING (lang) GROUP BY k.lang, k.term),
pv AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (
  SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, CAST((gp.p - lp.q) * (gp.p - lp.q) // lp.q AS BIGINT) AS value
  FROM gp JOIN lp USING (lang, term) WHERE gp.c > 0 AND gp.p > lp.q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
