"""The registered corpus queries on the small tables: against SQL, held-out labels, and the pipeline by hand."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA
from test_corpus_operators import brute_groups, brute_secrets

import corpus_pipeline
from kinescribe.llm import packing, quality
from kinescribe.llm.queries import oracle_sql, queries

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in SF.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries()[name](spark, str(SF)).toPandas()
    want = con.sql(oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got.astype(str)) == rows(want.astype(str))


def test_all_documents_have_results(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries().items():
        if name not in ("op7_chat_format", "op9_packing"):
            assert query(spark, str(SF)).count() == n, name


def test_held_out_accuracy(spark):
    sf = DATA / "sf0.01"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert len(m) > 50 and (m.predicted == m.quality).mean() > 0.95


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = queries()["op10_quality"](spark, str(SF)).toPandas()
    good = stages["quality"](spark, docs, str(SF)).toPandas()
    assert set(good.doc_id) == set(scored[scored.predicted == 1].doc_id)

    step = stages["near_duplicates"](spark, spark.createDataFrame(good), str(SF)).toPandas()
    groups = brute_groups(list(zip(good.doc_id, good.text.fillna(""))), 5)
    assert sorted(step.doc_id) == sorted(i for i, (_, c) in groups.items() if i == c)

    clean = stages["secrets"](spark, spark.createDataFrame(step), str(SF)).toPandas()
    assert sorted(clean.doc_id) == sorted(step.doc_id)
    before = dict(zip(step.doc_id, step.text))
    for i, text in zip(clean.doc_id, clean.text):
        assert (text == before[i]) == (not brute_secrets(before[i])[1])
        assert not brute_secrets(text)[0]

    mixed = stages["mix"](spark, spark.createDataFrame(clean), str(SF)).toPandas()
    assert list(mixed.columns) == list(docs.columns)
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    words = lambda d: d.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert abs(words(mixed) - words(clean)) < 0.25 * words(clean)

    packed = corpus_pipeline.run(spark, str(SF)).toPandas()
    encode = packing.tokenizer("byte_bpe_50k.json")
    tokens = sum(len(x) + 1 for x in encode(mixed.text.tolist()))
    assert packed.length.sum() == tokens and packed.groupby("sequence_id").length.sum().max() <= 2048
    crc = {zlib.crc32(np.append(encode([t])[0], np.uint32(1)).astype("<u4")[:2048][:512].tobytes()) for t in mixed.text if len(encode([t])[0]) < 500}
    assert crc <= set(packed.ids_crc32)
    assert corpus_pipeline.ORACLE_SQL is None
