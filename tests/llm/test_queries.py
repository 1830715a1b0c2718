"""Registered queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerlog.llm import queries  # noqa: F401
from answerlog.llm.registry import QUERIES, SQL
from tests.llm.test_corpus_operators import plain_components, shingles_of
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_stages(spark, messy):
    """Each stage keeps the columns and does what its operator says; clean rows stay."""
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, "")
    one = stages["n-gram Jaccard join"](spark, docs, "")
    cut = stages["substring dedup"](spark, docs, "")
    masked = stages["secret scans"](spark, docs, "")
    for df in (good, one, cut, masked):
        assert df.dtypes == docs.dtypes
    assert good.count() < docs.count() and masked.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, _, find = plain_components(rows)
    groups = {find(i) for i, (_, t) in enumerate(rows) if shingles_of(t)}
    assert one.filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count() == len(groups)
    for r in cut.filter("text IS NOT NULL AND n_chars IS NOT NULL").collect():
        assert r.n_chars == len(r.text)
    # The line of credentials, and three texts that are long runs of hexadecimal letters.
    assert masked.filter("text LIKE '%[SECRET]%'").count() == 4


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    by_doc = collections.defaultdict(int)
    for r in pieces:
        by_doc[r.doc_id] += r.length
    assert 0 < len(by_doc) < docs.count()
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in pieces)
