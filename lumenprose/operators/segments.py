"""Segments: sentences, titles and table cells with their kind, place and word count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .blocks import blocks

SIGNAL = r"(?Ud)^\s*(?:(WARNING|CAUTION|NOTE)\b\s*[:.\-–—]?|((?i:warning|caution|note))\s*:)\s*"


def segments(docs: DataFrame, doc_type: str = "auto", structured: bool = True) -> DataFrame:
    """(doc_id, seg_no, block, idx, line, kind, text, masked, words) of documents (doc_id, text).

    ``doc_type`` is auto, proc or desc; it sets the kind of ordinary sentences. Documents are shuffled once,
    by their id, which also serves line numbers, numbers within the document and joins of findings by document.
    """
    if doc_type not in ("auto", "proc", "desc"):
        raise ValueError(f"doc_type must be auto, proc or desc, not {doc_type!r}")
    # documents are dealt before any work on texts; the windows below need no other exchange
    dealt = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = dealt.select("doc_id", X.clean(F.col("text")).alias("t")).select("doc_id", F.explode(blocks(F.col("t"), structured)).alias("b")).select("doc_id", "b.block", F.col("b.kind").alias("shape"), F.col("b.signal").alias("given"), F.col("b.lines").alias("lines"))
    rows = rows.withColumn("joined", F.array_join(F.transform("lines", lambda x: x["content"]), "\n"))
    rows = rows.withColumn("masked", X.mask(F.col("joined")))
    head = F.regexp_extract("masked", SIGNAL, 0)
    named = (F.col("shape") != "title") & (F.length(head) > 0) & (F.length(head) < F.length("masked"))
    word = F.lower(F.concat(F.regexp_extract("masked", SIGNAL, 1), F.regexp_extract("masked", SIGNAL, 2)))
    rows = rows.withColumn("signal", F.when(named, word).otherwise(F.col("given"))).withColumn("masked", F.when(named, F.concat(F.repeat(F.lit(" "), F.length(head)), F.substring("masked", F.length(head) + 1, F.length("masked")))).otherwise(F.col("masked")))
    rows = rows.withColumn("cut", F.when(F.col("shape").isin("title", "cell"), F.array("masked")).otherwise(X.sentences(F.col("masked"))))
    both = F.arrays_zip(F.col("cut").alias("masked"), F.when(F.col("masked") == F.col("joined"), F.col("cut")).otherwise(X.cut_alike(F.col("joined"), F.col("cut"))).alias("text"))
    rows = rows.select("doc_id", "block", "shape", "signal", F.transform("lines", lambda x: x["line"]).alias("numbers"), F.posexplode(both).alias("piece", "s"))
    lead = F.length(F.regexp_extract("s.masked", r"(?U)^\s*", 0))
    size = F.length(F.regexp_replace("s.masked", r"(?U)^\s+|\s+$", ""))
    before = Window.partitionBy("doc_id", "block").orderBy("piece")
    down = F.coalesce(F.sum(newlines(F.col("s.text"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + newlines(F.substring("s.text", F.lit(1), lead))
    rows = rows.withColumn("line", F.get("numbers", down.cast("int"))).filter(F.col("s.masked").rlike(r"(?U)\w"))
    rows = rows.withColumn("idx", (F.row_number().over(before) - 1).cast("int"))
    # pieces are in order of idx; with them in the order, one sort serves the numbers in a block and in the document
    order = Window.partitionBy("doc_id").orderBy("block", "piece")
    rows = rows.withColumn("seg_no", F.row_number().over(order))
    rows = rows.select("doc_id", "seg_no", "piece", "block", "shape", "signal", "idx", "line", F.substring("s.text", lead + 1, size).alias("text"), F.substring("s.masked", lead + 1, size).alias("masked"))
    command = X.is_imperative(F.col("masked"))
    step = (F.col("shape") == "num") & (F.col("idx") == 0)
    kind = F.when(F.col("shape").isin("title", "cell"), F.col("shape")).when(F.col("signal") != "", F.col("signal"))
    kind = kind.when(step, F.lit("proc")).when(command, "proc").otherwise("desc") if doc_type == "auto" else kind.otherwise(F.lit(doc_type))
    rows = rows.withColumn("command", command).withColumn("kind", kind)
    if structured:
        rows = _demoted(rows)
    rows = rows.withColumn("words", X.count_words(F.col("masked")))
    return rows.select("doc_id", "seg_no", "block", "idx", "line", "kind", "text", "masked", "words")


def newlines(x):
    return F.regexp_count(x, F.lit("\n"))


def _demoted(rows: DataFrame) -> DataFrame:
    """In a list of adjacent numbered blocks of which less than half are commands, the others are descriptions."""
    step = (F.col("shape") == "num") & (F.col("idx") == 0) & (F.col("kind") == "proc")
    sofar = Window.partitionBy("doc_id").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("is_step", step).withColumn("island", F.when(F.col("is_step"), F.col("block") - F.sum(F.col("is_step").cast("int")).over(sofar)))
    whole = Window.partitionBy("doc_id", "island", "is_step")
    few = 2 * F.sum(F.col("command").cast("int")).over(whole) < F.count("*").over(whole)
    return marked.withColumn("kind", F.when(F.col("is_step") & ~F.col("command") & few, "desc").otherwise(F.col("kind"))).drop("is_step", "island")
