"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, bagminhash, merkle, mtree, packing, piece_codec, quality, sharding, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [token_files.op1_token_files, quality.op2_quality, anchors.op3_substring_dedup, piece_codec.op4_sentencepiece, sharding.op5_sharding, bagminhash.op6_near_duplicates, merkle.op7_merkle, packing.op8_packing, mtree.op9_mtree, toxicity.op10_toxicity]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.sql(), "op9_mtree": mtree.SQL}
