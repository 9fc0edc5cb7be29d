"""The corpus pipeline: documents through five stages, each one operator of ``framelode.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read back as the next one's docs. All but the last
return the columns of documents.

Each stage takes null texts as empty ones, null ids and repeated ids as rows of their own, and an empty table gives an empty
one. Without labels no document is toxic; without a benchmark none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelode import scratch
from framelode.llm import decontamination, mixing, near_copies, sharding, toxicity

#: Rows of an Arrow batch. One of Spark's 10,000 holds all texts of a task, in the JVM outside its heap and in Python.
BATCH = 512
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """From now on batches of this session have ``BATCH`` rows at most: a stage's rows go through Python after it returns."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH:
        spark.conf.set(BATCH_KEY, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is fitted on labelled rows that are not held out. Copies score
    alike; a text without words has no hits and stays."""
    in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.filter(~toxicity.held_out(labels["doc_id"]))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, Jaccard of 0.8 or more; candidates from the Gray-order
    index over SimHash fingerprints and from MinHash bands): the least id, null ids last; of rows that agree in every column,
    one. Texts without words are one group."""
    in_small_batches(spark)
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null items and ids of items match nothing."""
    in_small_batches(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. The null source is a source; a text without words has no weight in it and is
    kept with its odds."""
    in_small_batches(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the size, shard and slot of each; rows that agree in every column get places of their own."""
    return sharding.sharded_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, seeds and pivots have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's scratch tables go when its output is written, and its output when
    the next one's is; those of the last stay until ``scratch.purge``, as it is read after this returns. The session's batches are
    then as before: the last stage uses none."""
    batch = spark.conf.get(BATCH_KEY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(scratch.CREATED)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, f"stage-{name}")
            scratch.release(spark, since, keep=1)
    spark.conf.set(BATCH_KEY, batch)
    return docs
