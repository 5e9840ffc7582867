"""Checks on a stream of documents: each micro-batch is segmented, checked and scored by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import detectors, findings, scoring
from ..operators.segments import segments


def check_stream(docs: DataFrame, path: str, checkpoint: str, structured: bool = True, allow: list[str] | None = None) -> StreamingQuery:
    """Writes each new document's score to ``path``; a document is complete in its micro-batch, so no state is kept."""

    def batch(rows: DataFrame, number: int) -> None:
        segs = segments(rows, structured=structured).persist()
        found = findings.finish(detectors.detect(segs), segs, allow)
        scoring.score(rows, segs, found, pooled=False).write.mode("overwrite").parquet(f"{path}/batch={number}")
        segs.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
