"""Every query that has SQL, against DuckDB on the smallest tables."""

import os
from urllib.parse import quote

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from skein.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df().astype(object)
    got = catalogue.queries()[name](spark, DATA).toPandas().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.where(got.notna(), None)) == rows(want.where(want.notna(), None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_each_twentieth_vector_is_asked(spark):
    x = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").df()
    ids, v = x.vec_id.tolist(), np.stack(x.embedding.to_numpy()).astype(float)
    want = set()
    for k in range(len(ids)):
        if ids[k] % 20 == 0:
            s = np.round(np.clip(v @ v[k], 0, 1), 6)
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != k and s[j] >= 0.3)[:5]
            want |= {(ids[k], i) for _, i in best}
    got = {(r.query_id, r.vec_id) for r in catalogue.queries()["cosine_topk_20"](spark, DATA).collect()}
    assert got == want and len({q for q, _ in got}) > len(ids) // 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_url_params_of_whole_texts(spark, tmp_path):
    odd = [(10**9, "a*b~c d+e%f&g=h/i?é日😀\n'\"-_.!()")]
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: f"q={quote(r.text, safe='')}&page={r.doc_id % 5}" for r in df.collect()}
    assert {r.doc_id: r.qs for r in catalogue.queries()["url_params_whole"](spark, str(tmp_path)).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_fulltext_search_has_every_item(spark):
    got = [r.url for r in catalogue.queries()["fulltext_search_whole"](spark, DATA).collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("'https://' || source || '.example/' || doc_id AS url")
    assert {r.url for r in docs.collect()} <= set(got) and len({u.lower() for u in got}) == len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
