"""The stages one by one and together, against plain versions."""

import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from radarq.llm import common as C
from radarq.llm import toxicity

from . import plain
from .conftest import odd
from .test_models import whole_ids


@pytest.fixture(scope="module")
def folder(spark, small):
    """The smallest tables, with a null and an empty text and a repeated row."""
    d = tempfile.mkdtemp(prefix="spark-")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(5000, None, "en", "web", None), (5001, "", "en", None, 0), (5002, "a b c", None, "web", 5), (5002, "a b c", None, "web", 5)], docs.schema)
    docs.union(more).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", f"{d}/{t}.parquet")
    return d


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_run(spark, folder):
    docs = C.table(spark, folder, "documents")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, C.table(spark, folder, "labels")).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    lines = plain.dedup_lines(list(rows))
    rows = [(d, lines[d][0]) for d, _ in rows]
    near = plain.near_duplicates(rows)
    rows = [(d, t) for d, t in rows if near[d][0] == d]
    items = [(r.item_id, r.text) for r in C.table(spark, folder, "benchmark").collect()]
    hit = plain.contamination(rows, items)
    rows = [(d, t) for d, t in rows if not (hit[d][1] and 20 * hit[d][1] >= hit[d][0])]
    assert 0 < len(rows) < docs.count() and toxic
    want = sorted((d, len(ids) + 1) for (d, _), ids in zip(rows, whole_ids([t for _, t in rows])))
    out = P.run(spark, folder).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(n for _, n in want)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_clashing_columns_and_empty_tables(spark, folder, stage):
    docs = C.table(spark, folder, "documents")
    strange = odd(docs)
    out = stage(spark, strange, folder)
    if stage is not P.STAGES[-1][1]:
        assert out.columns == strange.columns and out.schema == strange.schema
        assert 0 < out.count() <= strange.count()
        assert out.agg(F.min("score")).first()[0] == 7
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_clean_documents_stay(spark, folder):
    docs = C.table(spark, folder, "documents")
    out = docs
    for _, stage in P.STAGES[:4]:
        before = out.count()
        out = C.write_scratch(stage(spark, out, folder), "test")
        assert out.count() >= 0.7 * before
    assert np.all([r.n_chars == len(r.text) for r in out.collect()])
