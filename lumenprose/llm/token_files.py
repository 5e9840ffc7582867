"""Operator 1: token ids of documents in compressed files, in ascending order of doc_id.

``write`` deals the documents by ranges of doc_id, encodes them and writes segments (see ``rans``) as rows of a Parquet
folder through Spark's committer, so that a lost executor's task is simply run again and readers of any file system
can open it. ``read`` decodes segments side by side; only one running total for each written part (their number is the
number of partitions) is broadcast.

Null texts are empty; null ids come first; rows that repeat an id are ordered by their text. No rows give no segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import id_and_text, map_rows, scratch, slices, table, text_slices
from .tokens import tokenizer

SEGMENT_TOKENS = 1 << 20
END_ID = 2
_SEGMENT = "part long, seq long, part_start long, first_doc long, n_docs long, n_tokens long, payload binary"


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every whole text, appends ``end_id``, writes the segments to ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        size = 0

        def close() -> list:
            nonlocal seq, start, size, names, docs
            row = [[part], [seq], [start], [names[0]], [len(names)], [size], [rans.encode_segment(names, docs)]]
            seq, start, size, names, docs = seq + 1, start + size, 0, [], []
            return row

        for batch in text_slices(batches, 1):
            known = tokenizer(vocabulary)
            end = known.dtype.type(end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column(1)), strict=True):
                names.append(doc_id)
                docs.append(np.append(ids, end))
                size += len(docs[-1])
                if size >= segment_tokens:
                    yield close()
        if names:
            yield close()

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_rows(ordered, encode, _SEGMENT).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as binary of little-endian unsigned 32-bit integers) of each document in the files."""
    segments = spark.read.parquet(path)
    # one row for each written part: ranges don't overlap, so their first ids order them
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min("first_doc").alias("first"), F.max(F.col("first_doc").isNull()).alias("null_first"))
    order = Window.orderBy(F.desc("null_first"), "first", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    located = segments.join(F.broadcast(before), "part").select((F.col("before") + F.col("part_start")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in slices(batches, 1):
            start = batch.column(0)[0].as_py()
            names, docs = rans.decode_segment(batch.column(1)[0].as_py())
            starts = start + np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1])).astype(np.int64)
            for at in range(0, len(names), 512):
                yield [names[at : at + 512], starts[at : at + 512], [d.astype("<u4").tobytes() for d in docs[at : at + 512]]]

    return map_rows(located, decode, "doc_id long, start long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns of what ``read`` returns."""
    return decoded.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return digest(read(spark, path))
