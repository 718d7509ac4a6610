"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. Language ID: documents that the language models reject go.
2. Line dedup: exact copies of an earlier line go, and lines of five words or more within one word edit of one; documents left without a word go.
3. N-gram Jaccard join: of every group of linked documents the one of smallest id stays.
4. Benchmark decontamination: documents with a hit go.
5. BPE: token ids' and decoded texts' digests of what is left.

Every stage but the last returns the columns of ``documents``. ``n_chars``, where there, is that of the new text.

Stages 3 and 4 decide on rows, not on ids: a row is known by a hash of all its columns, so rows that share an id, or have none,
are judged one by one. Where a column is null it is hashed as such. Extra columns, whatever their names, are kept. An empty
table stays empty. The intermediate tables lie in the session's shared folder and go as soon as the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm.bpe import bpe_round_trip
from gistmill.llm.decontaminate import decontaminate
from gistmill.llm.jaccard_join import jaccard_components
from gistmill.llm.language_id import keep_identified, train
from gistmill.llm.line_dedup import drop_repeated_lines
from gistmill.llm.queries import tokenizer
from gistmill.llm.session import checkpoint, shared_folder

#: No SQL can express these stages; tests hold the run against brute force.
ORACLE_SQL = None
#: Rows' keys, of 8 bytes, are broadcast up to this number; beyond it they are shuffled.
MOST_BROADCAST = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of all their columns, and its name."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    columns = [docs[c] for c in docs.columns]
    return docs.withColumn(name, F.xxhash64(*columns, *[c.isNull() for c in columns])), name


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the one-column table ``gone``, without the key."""
    gone = checkpoint(gone.toDF("gone_key").distinct())
    small = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, docs[key] == gone["gone_key"], "left_anti").drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are learned from this input's rows with a language, held-out ids left out; null texts, and texts without a letter, go."""
    return keep_identified(docs, train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest line by id stays; rows without an id come last. Null texts and texts that lose nothing stay as they are."""
    out = drop_repeated_lines(docs, own_words=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of smallest id stays (of several with that id the one of smallest key; of rows alike in all columns one).

    Rows without a word link with nothing and all stay. Rows without an id only stay where their component has no id.
    """
    docs, key = _keyed(docs)
    found = checkpoint(jaccard_components(docs, count_links=False, carry=key))
    alike = found.where("leader AND n_shingles > 0").groupBy("carried").agg(F.count("*").alias("n")).where("n > 1").select("carried")
    repeated = checkpoint(alike.select(F.col("carried").alias("again")))
    once = docs.join(repeated, docs[key] == repeated["again"], "left_semi").dropDuplicates([key]).drop(key)
    gone = found.where("NOT leader").select("carried").unionByName(alike)
    kept = _without(docs, key, gone)
    return kept if repeated.isEmpty() else kept.unionByName(once)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row goes whose text shares a window with an item, whatever its id; null texts stay."""
    docs, key = _keyed(docs)
    bad = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).where("contaminated").select("doc_id")
    return _without(docs, key, bad)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A result for every row; a null text has no tokens."""
    return bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", clean), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; only the last one's table is left in the shared folder."""
    jvm, folder = spark.sparkContext._jvm, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
