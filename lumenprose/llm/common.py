"""Shared helpers: tables, defined columns, shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process (tests), a temporary
    folder is made and set; on a cluster an unset folder is an error, as no executor would see the driver's own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenprose-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): only the columns in use, so that other columns can't clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether a label is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that Python objects stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2048, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and of about ``size`` bytes of text at most (one longer text is one batch)."""
    for batch in batches:
        total = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, min(at + rows, int(total.searchsorted(before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Returns memory that is held but not in use to the system, so that a Python worker that waits for a task stays small."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], ddl: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns in the order of ``ddl`` ("a long, b string")."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        columns = None
        give_back()

    return df.mapInArrow(run, ddl)
