"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a maximal run of characters other than space and the ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array (empty for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between jobs: spark.checkpoint.dir, or the checkpoint folder that the context was given.

    Where neither is set, a temporary folder stands in if the master is this machine alone; elsewhere that is an error, as executors couldn't read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, prolonged where `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any name, as it can't name those with a backtick: `run` has them by place."""
    numbered = [f"c{k}" for k in range(len(schema.fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(numbered)

    fields = [StructField(name, f.dataType, f.nullable) for name, f in zip(numbered, schema.fields, strict=True)]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(renamed, StructType(fields)).toDF(*schema.names)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of earlier rounds.

    It removes what the driver no longer refers to, but only notices when the driver's garbage is collected.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def md5_int(value: Column, digits: int = 8) -> Column:
    """An integer from the first hexadecimal digits of the MD5 of a string; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def groups_of(batches, key: str):
    """The groups of sorted record batches, as Arrow tables; a group may span batches."""
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.concat_tables([*held, table.slice(a, b - a)])
            held = []
        held.append(table.slice(edges[-2], edges[-1] - edges[-2]))
    if held:
        yield pa.concat_tables(held)
