"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermatch.session import cut_lineage

# Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WHITE = r"\x20\x09-\x0D"
WORD = f"[^{WHITE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the tests' own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(0))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, without their lineage."""
    return cut_lineage(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_process(key: tuple, make: Callable[[], Any], version: str = "") -> Any:
    """Something costly that all tasks of a Python worker use: compiled tables, memos, a version of a model.

    Functions travel by value, so their modules' globals are new in every task; this holder is not.
    """
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    state = holder.__dict__.setdefault("state", {})
    if key not in state or state[key][0] != version:
        state[key] = version, make()
    return state[key][1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read back; cuts the lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


KEY = ("row_key_a", "row_key_b")


def row_key(df: DataFrame) -> list[Column]:
    """128 bits of hash over all columns: names a row, and equal rows alike."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*columns).alias(KEY[0]), F.xxhash64(F.lit("b"), *columns).alias(KEY[1])]


def one_row_each(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, beside those of ``keyed``, joined by row key.

    The keys of ``keyed`` are distinct; of equal rows of ``docs`` the first one stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, *row_key(docs)).join(keyed, list(KEY))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(KEY[0]))
    return joined.withColumn("copy_number", first).where("copy_number = 1").drop("copy_number", *KEY)
