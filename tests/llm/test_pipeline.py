"""The pipeline's stages on small tables with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"word{i}x" for i in range(500)]
    text = lambda n=60: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs, toxic = [], []
    for i in range(150):
        t = text()
        if i % 5 == 0:
            t += " idiot moron 1diot loser trash"
        elif i % 10 == 1:
            t += " " + items[i % 5][1]
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        toxic.append((i, 1, int(i % 5 == 0)))
    copy = docs[2][1].split()
    copy[7] = "edited"
    docs += [(200, docs[2][1], "en", "s1", 1), (201, docs[2][1], "en", "s1", 1), (202, docs[3][1], "en", None, 1), (203, None, "en", "s1", 0), (204, "", "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tables}/out-{name}"
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
        assert name == "sharding" or docs.columns == columns
    ids = {k: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for k, df in out.items()}
    every = [*range(150), *range(200, 205)]
    clean = [i for i in every if i >= 200 or i % 5]
    assert ids["toxicity"] == clean
    unique = [i for i in clean if i not in (200, 201, 202, 204)]
    assert ids["near_duplicates"] == unique
    left = [i for i in unique if i >= 200 or i % 10 != 1]
    assert ids["decontamination"] == left
    assert set(ids["mixing"]) <= set(left) and len(ids["mixing"]) > len(left)
    shards = out["sharding"].collect()
    assert sorted(r["doc_id"] for r in shards) == ids["mixing"]
    assert sorted(r["slot"] * 40 + r["shard"] for r in shards) == list(range(len(shards)))
    assert sorted((r["doc_id"], str(r["text"]), r["source"]) for r in shards) == sorted((r["doc_id"], str(r["text"]), r["source"]) for r in out["mixing"].collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in shards)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tables, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    if empty == "documents":
        assert not rows
    elif empty == "labels":
        assert any(i < 150 and i % 5 == 0 for i in ids)  # nothing is toxic
    else:
        assert any(i < 150 and i % 10 == 1 for i in ids)  # nothing is contaminated


def test_clashing_columns_and_repeated_rows(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "row", "ident", "n", "key", "copy", "piece")})
    docs = docs.unionByName(docs.filter("doc_id IN (2, 3, 203)"))
    docs = docs.unionByName(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sharding" or docs.columns == columns
    assert {"doc_size", "doc_shard", "doc_slot", "size", "shard", "slot"} <= set(docs.columns)
    assert sorted(r["slot"] * 40 + r["shard"] for r in docs.collect()) == list(range(docs.count()))


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "decontamination"])
def test_few_texts_of_a_batch_are_held_at_once(spark, make, monkeypatch, stage):
    """A batch may hold all texts of a task: 20 MB here, of which Python takes a part at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from framelode.llm import decontamination, near_copies, toxicity

    df = make([], extra=False).select("doc_id", "text")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, function, schema: function)
    model = toxicity.Model(np.ones((toxicity.SIZE,) * 3, np.float32), {"zzzz": 1.0}, np.zeros(7))
    scan = {
        "toxicity": lambda: toxicity.keep_clean(df, model),
        "near_duplicates": lambda: near_copies.sketches(df.toDF("key", "text")),
        "decontamination": lambda: decontamination.keep_clean(df, items),
    }[stage]()
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["ab" * 2000] * 5000)], ["doc_id", "text"])
    peaks = []
    for n in (1024, 1024, 5000):  # what is made once is there after the first
        tracemalloc.start()
        assert sum(b.num_rows for b in scan(iter([batch.slice(0, n)]))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < peaks[1] + 4_000_000


def test_batches_are_small_while_it_runs(spark, tables, monkeypatch):
    key, written, seen = corpus_pipeline.BATCH_KEY, corpus_pipeline.scratch.written, []
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline.scratch, "written", lambda df, name: seen.append(int(spark.conf.get(key))) or written(df, name))
    try:
        for given, wanted in ((10_000, 512), (0, 512), (100, 100)):
            spark.conf.set(key, given)
            corpus_pipeline.in_small_batches(spark)
            assert int(spark.conf.get(key)) == wanted
        spark.conf.set(key, 9000)
        assert corpus_pipeline.run(spark, tables).count() > 100
        assert seen == [512] * 4 and spark.conf.get(key) == "9000"
    finally:
        spark.conf.set(key, before)
