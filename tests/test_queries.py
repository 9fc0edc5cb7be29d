"""Every registered query of the library against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from framelode.operators import cluster
from framelode.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LARGER = DATA.replace("sf0.001", "sf0.01")  # the smallest events table has no shots


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: str(list(x)) if isinstance(x, list | np.ndarray) else x)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, db, name):
    got = tidy(catalog.QUERIES[name](spark, DATA).toPandas())
    want = tidy(db.execute(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert got[c].tolist() == want[c].tolist()
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c


def test_distance_at_the_limit(spark, tmp_path):
    """Two frames 0.5 apart but for the last bit, which depends on the order of the sum."""
    a, b = (3, 0, 1, 2, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0), (3, 1, 1, 2, 1, 0, 0, 0, 2, 1, 0, 0, 1, 0)
    texts = ["".join(chr(16 * k + 37) * n for k, n in enumerate(h)) for h in (a, b, a)]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("histogram_summary_gpu", "histogram_summary_gpu_fused"):
        want = sorted(con.execute(catalog.ORACLES[name]).fetchall())
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == want == [("s", 0)], name


def test_queries_without_oracle():
    assert {*catalog.QUERIES} - {*catalog.ORACLES} == {"xmeans", "shot_summary"}


def test_xmeans_groups(spark):
    rows = catalog.QUERIES["xmeans"](spark, DATA).collect()
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    for label in {r["label"] for r in vectors}:
        own = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors if r["label"] == label}
        found = [r for r in rows if r["video_id"] == label]
        assert sum(r["n"] for r in found) == len(own) and all(r["frame_id"] in own for r in found) and 1 <= len(found) <= 10
        label_of, centres = cluster.xmeans(np.array([own[k] for k in sorted(own)]), 1, 10, 300)
        one = ((np.array(list(own.values())) - np.mean(list(own.values()), 0)) ** 2).sum()
        many = sum(((np.array([own[k] for k in sorted(own)])[label_of == j] - c) ** 2).sum() for j, c in enumerate(centres))
        assert many <= one + 1e-9 and sorted(r["n"] for r in found) == sorted(np.bincount(label_of)[np.bincount(label_of) > 0])


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no larger tables")
def test_shot_summary(spark):
    frames = {r["frame_id"] for r in catalog.QUERIES["shot_frames"](spark, LARGER).collect()}
    found = [r["frame_id"] for r in catalog.QUERIES["shot_summary"](spark, LARGER).collect()]
    assert found and len(found) == len(set(found)) and set(found) <= frames
