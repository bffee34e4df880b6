"""A corpus pipeline of five stages over `documents`.

Language identification drops texts of no known language, BagMinHash keeps one document of each group of near-duplicates, repeated
lines and sentences are cut, the mix repeats or drops documents so that sources reach their targets, and
packing deals the result to training sequences. Each stage's rows are written as Parquet and read
again for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shared_folder
from quern.llm.language_id import UNKNOWN, identify, learn
from quern.llm.minhash import deduplicate
from quern.llm.mixing import entropy_mix
from quern.llm.packing import pack_documents
from quern.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Distance from the nearest language's profile, of 1, from which a text is of no known language.
FARTHEST = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; `lang` is what was found."""
    judged = identify(docs.select(*COLUMNS), learn(docs))
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("distance") < FARTHEST))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return deduplicate(docs.select(*COLUMNS))


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the units that an earlier one has; one that has nothing left goes."""
    cut = substring_dedup(docs.select(*COLUMNS))
    left = cut.filter((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that agree in doc_id and text are one document."""
    key = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    keyed = docs.select(*COLUMNS, key.alias("_key")).dropDuplicates(["_key"])
    copies = entropy_mix(keyed, doc_id="_key").filter("copies > 0").select(F.col("doc_id").alias("_d"), "copies")
    taken = keyed.join(copies, F.col("_key") == F.col("_d"))
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_cut),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Tokens and signatures are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    """Remove a stage's rows once the next stage has written its own."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
