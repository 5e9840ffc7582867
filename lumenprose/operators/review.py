"""Reviews: decisions on findings, and added findings and rewrites anchored to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from . import detectors
from .dictionary import dictionary_findings
from .findings import finish
from .segments import segments

#: Schema of a review; items of confirm and reject may also be bare ids (see ``read``).
REVIEW = "confirm array<struct<id:string,reason:string,note:string>>, reject array<struct<id:string,reason:string,note:string>>, add array<struct<rule:string,doc_id:bigint,line:string,quote:string,fix:string,note:string>>, rewrites array<struct<doc_id:bigint,line:string,original:string,rewrite:string>>, notes string"


def read(json: Column) -> Column:
    """A review from its JSON text. Bare ids become objects first."""
    listed = F.regexp_replace(json, r'(?<=[\[,])\s*"([FR]\d+)"\s*(?=[,\]])', r'{"id":"$1"}')
    return F.from_json(listed, REVIEW)


def decide(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with the status and note of (doc_id, id, status, note), and decisions on unknown ids. A rejection wins."""
    last = decisions.groupBy("doc_id", "id").agg(F.max(F.struct((F.col("status") == "rejected").alias("late"), "status", "note")).alias("d")).select("doc_id", "id", F.col("d.status").alias("new_status"), F.col("d.note").alias("note"))
    out = findings.drop("note").join(last, ["doc_id", "id"], "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("note", F.coalesce("note", F.lit(""))).drop("new_status")
    counts = (F.col("source") != "house") & (F.col("status") != "rejected") & (F.col("status").isin("confirmed", "added") | (F.col("conf") == "high"))
    return out.withColumn("counted", counts), decisions.join(findings.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def locate(items: DataFrame, segs: DataFrame, quote: str = "quote") -> DataFrame:
    """``items`` (doc_id, n, line, quote) with seg_no, start, end of the segment that holds the quote; null if none does.

    Segments within two lines come first, the nearest first, then the others in order; without a quote only the nearest
    segment counts. Quotes are compared without regard to case and white space.
    """
    plain = lambda c: F.translate(c, "’‘“” ", "''\"\" ")
    words = F.filter(F.split(F.trim(plain(F.coalesce(F.col(quote), F.lit("")))), r"\s+"), lambda w: w != "")
    wanted = items.withColumn("_line", F.coalesce(F.expr("try_cast(line as int)"), F.lit(0))).withColumn("_words", F.array_join(F.transform(words, lambda w: F.lower(w)), " "))
    s = segs.filter("kind <> 'title'").select("doc_id", "seg_no", F.col("line").alias("_at"), "text")
    flat = F.lower(F.regexp_replace(plain(F.col("text")), r"\s+", " "))
    low = F.lower(plain(F.col("text")))
    rows = wanted.join(s, "doc_id", "left")
    height = F.regexp_count("text", F.lit("\n"))
    near = (F.col("_line") > 0) & (F.col("_line") >= F.col("_at") - 2) & (F.col("_line") <= F.col("_at") + height + 2)
    has = F.when(F.col("_words") == "", near).otherwise(F.contains(flat, F.col("_words")))
    order = Window.partitionBy("doc_id", "n").orderBy(F.when(has, 0).otherwise(1), F.when(near, 0).otherwise(1), F.when(near, F.abs(F.col("_at") - F.col("_line"))), "seg_no")
    best = rows.withColumn("_has", F.coalesce(has, F.lit(False))).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    # the place in the text: white space in the text may be longer than the quote's
    before = F.length(F.call_function("substring_index", flat, F.col("_words"), F.lit(1)))
    start = F.when(F.col("_words") == "", 0).otherwise(_unflattened(low, before))
    end = F.when(F.col("_words") == "", F.length("text")).otherwise(_unflattened(low, before + F.length("_words")))
    hit = F.col("_has")
    return best.select(*items.columns, F.when(hit, F.col("seg_no")).alias("seg_no"), F.when(hit, start).cast("int").alias("start"), F.when(hit, end).cast("int").alias("end"))


def _unflattened(text: Column, at: Column) -> Column:
    """The place in ``text`` of a place in the text with each run of white space as one blank."""
    runs = F.filter(X.matches(text, r"(?U)\s{2,}"), lambda m: F.length(F.regexp_replace(F.substring(text, F.lit(1), m["start"]), r"(?U)\s+", " ")) < at)
    return at + F.aggregate(runs, F.lit(0), lambda s, m: s + m["end"] - m["start"] - 1)


def added(items: DataFrame, segs: DataFrame, first: int = 1) -> DataFrame:
    """Findings of added items whose rule gives findings: ids R1.. in order; without a place they are notes that don't count."""
    tiers = items.sparkSession.createDataFrame([(r, t) for r, t in L.TIER.items() if t], "rule string, tier int")
    good = items.join(F.broadcast(tiers), "rule")
    numbered = good.withColumn("id", F.concat(F.lit("R"), F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) + F.lit(first - 1)))
    return locate(numbered, segs).select("doc_id", "n", "id", "rule", "tier", "seg_no", "start", "end", "quote", F.lit("added").alias("status"), F.lit("review").alias("source"), F.col("seg_no").isNotNull().alias("counted"))


def recheck(rewrites: DataFrame, allow: list[str] | None = None, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, left): what the checker still counts in each rewrite (doc_id, n, rewrite), as "rule: quote".

    Each rewrite is a document of its own, under a key of its document and number; ``words`` is a dictionary's lookup.
    """
    keyed = rewrites.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n").cast("string")))
    segs = segments(keyed.select(F.col("_key").alias("doc_id"), F.col("rewrite").alias("text"))).persist()
    found = detectors.detect(segs)
    if words is not None:
        found = found.unionByName(dictionary_findings(segs, words, allow).select(*found.columns))
    found = finish(found, segs, allow).filter("counted")
    left = found.groupBy(F.col("doc_id").alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "start", "rule", "quote"))), lambda x: F.concat(x["rule"], F.lit(": "), x["quote"])), ", ").alias("left"))
    return keyed.join(left, "_key", "left").select("doc_id", "n", "rewrite", F.coalesce("left", F.lit("")).alias("left"))

