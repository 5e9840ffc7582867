"""A whole check: documents in, segments, findings and scores out; reviews applied to it; rows to store.

Documents are rows (doc_id, text). A null text has no segments and the full score; documents that share an id are one
document. All parts are DataFrames, so a check of a large collection is a plan until a part of it is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import message
from . import detectors, dictionary, findings, review, scoring
from .segments import segments

REWRITES = "doc_id long, n int, original string, rewrite string, seg_no int, left string"
WARNINGS = "doc_id long, warning string"


@dataclass(frozen=True)
class Check:
    """``findings`` have status, message and whether they count; ``scores`` has a row with doc_id null for all together."""

    docs: DataFrame
    segs: DataFrame
    findings: DataFrame
    scores: DataFrame
    rewrites: DataFrame
    warnings: DataFrame
    level: int = 80
    mark: int = 80
    allow: list[str] = field(default_factory=list)
    words: DataFrame | None = None
    reviewed: bool = False
    #: The findings before any review, which are stored.
    first: DataFrame | None = None

    def release(self) -> None:
        """Gives back what the check holds on the executors."""
        self.segs.unpersist()
        if self.first is not None:
            self.first.unpersist()


def check(docs: DataFrame, level: int | str = 80, mark: int | None = None, doc_type: str = "auto", allow: list[str] | None = None, words: DataFrame | None = None, names: list[str] | None = None) -> Check:
    """Segments, findings and scores of ``docs``. ``words`` (from ``dictionary.lookup``) adds the findings of a dictionary,
    which yield to the built-in ones at the same place; ``names`` leaves only these detectors."""
    level = scoring.parse_level(level)
    mark = level if mark is None else mark
    segs = segments(docs, doc_type).persist()
    found = detectors.detect(segs, names)
    if words is not None:
        found = found.unionByName(dictionary.dictionary_findings(segs, words, allow).select(*found.columns))
    found = findings.finish(found, segs, allow)
    found = found.withColumn("message", message(F.col("rule"), F.col("fix"))).withColumn("note", F.lit(""))
    # reviews and numbers read the findings many times; without this, each time would run all detectors again
    found = found.persist()
    spark = docs.sparkSession
    return Check(docs, segs, found, scoring.score(docs, segs, found, mark), spark.createDataFrame([], REWRITES), spark.createDataFrame([], WARNINGS), level, mark, list(allow or []), words, first=found)


def apply_review(done: Check, decisions: DataFrame | None = None, items: DataFrame | None = None, rewrites: DataFrame | None = None) -> Check:
    """The check after a review, scored again.

    ``decisions``: (doc_id, id, status, note), status confirmed or rejected. ``items``: (doc_id, n, rule, line, quote, fix,
    note) are findings of the reader; one whose quote isn't found stays as a note that doesn't count. ``rewrites``: (doc_id,
    n, line, original, rewrite); the last one of a segment holds, and what the checker still counts in it is in ``left``.
    What can't be applied gives a row of ``warnings``, never an error.
    """
    found, said = done.findings, [done.warnings]
    warn = lambda rows, text: said.append(rows.select("doc_id", text.alias("warning")))
    if decisions is not None:
        found, unknown = review.decide(found, decisions)
        warn(unknown, F.format_string("%s: no finding has the id %s", F.col("status"), F.col("id")))
    if items is not None:
        new = _numbered(review.added(items, done.segs), done.findings)
        notes = items.select("doc_id", "n", F.coalesce("fix", F.lit("")).alias("fix"), F.coalesce("note", F.lit("")).alias("note"))
        new = new.join(notes, ["doc_id", "n"]).withColumn("message", message(F.col("rule"), F.col("fix")))
        place = done.segs.select("doc_id", "seg_no", F.col("line").alias("_at"), "text")
        inside = F.substring("text", F.lit(1), F.col("start"))
        new = new.join(place, ["doc_id", "seg_no"], "left").withColumn("line", (F.col("_at") + F.regexp_count(inside, F.lit("\n"))).cast("int"))
        new = new.withColumn("quote", F.when(F.col("seg_no").isNull(), F.col("quote")).otherwise(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))))
        new = new.withColumn("conf", F.lit("high")).withColumn("det", F.lit(None).cast("int")).select(*found.columns, "n")
        warn(items.join(new.select("doc_id", "n"), ["doc_id", "n"], "left_anti"), F.format_string("added %d: %s isn't a rule that gives findings", F.col("n"), F.col("rule")))
        warn(new.filter("seg_no is null"), F.format_string("added %d: the quote wasn't found, so it is a note", F.col("n")))
        found = found.unionByName(new.drop("n"))
    again = done.rewrites
    if rewrites is not None:
        some = F.trim(F.coalesce("rewrite", F.lit(""))) != ""
        warn(rewrites.filter(~some), F.format_string("rewrite %d: no text", F.col("n")))
        placed = review.locate(rewrites.filter(some), done.segs, "original")
        warn(placed.filter("seg_no is null"), F.format_string("rewrite %d: its sentence wasn't found", F.col("n")))
        left = review.recheck(placed.select("doc_id", "n", "rewrite"), done.allow, done.words).select("doc_id", "n", "left")
        last = Window.partitionBy("doc_id", "seg_no").orderBy(F.desc("n"))
        placed = placed.withColumn("_k", F.row_number().over(last)).filter("seg_no is null or _k = 1")
        fresh = placed.join(left, ["doc_id", "n"]).select("doc_id", F.col("n").cast("int").alias("n"), "original", "rewrite", "seg_no", "left")
        older = again.join(fresh.filter("seg_no is not null").select("doc_id", "seg_no"), ["doc_id", "seg_no"], "left_anti").select(*fresh.columns)
        again = older.unionByName(fresh)
    warnings = said[0]
    for rows in said[1:]:
        warnings = warnings.unionByName(rows)
    return replace(done, findings=found, scores=scoring.score(done.docs, done.segs, found, done.mark), rewrites=again, warnings=warnings, reviewed=True)


def _numbered(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with ids that go on after the reviewed findings that a document has already."""
    had = old.filter("source = 'review'").groupBy("doc_id").agg(F.count("*").cast("int").alias("_had"))
    after = F.substring("id", 2, 20).cast("int") + F.coalesce("_had", F.lit(0))
    return new.join(had, "doc_id", "left").withColumn("id", F.concat(F.lit("R"), after)).drop("_had")


def before(counts: DataFrame, slices: int = 256) -> DataFrame:
    """(doc_id, before): the sum of ``n`` of all documents (doc_id, n) with a smaller id.

    The ids are cut at quantiles into ``slices`` of about equal size; sums run inside a slice, and only the slices' totals
    (``slices`` rows) are added up in one task. The quantiles are read first, so a task that runs again sees the same cuts.
    """
    cuts = counts.agg(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 10 * slices).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    dealt = counts.withColumn("_slice", place)
    total = dealt.groupBy("_slice").agg(F.sum("n").alias("_n"))
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_slice", F.coalesce(F.sum("_n").over(sofar(Window.orderBy("_slice"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n").over(sofar(Window.partitionBy("_slice").orderBy("doc_id"))), F.lit(0))
    return dealt.withColumn("_in", inside).join(F.broadcast(total), "_slice").select("doc_id", (F.col("_base") + F.col("_in")).alias("before"))


def pooled(done: Check) -> tuple[DataFrame, DataFrame]:
    """Segments and findings with ``pool_id``: S1, S2, ... and F1, F2, ... through all documents in order of their ids.
    Findings that a reader added keep their own ids."""

    def numbered(rows: DataFrame, letter: str, number: Column) -> DataFrame:
        place = before(rows.groupBy("doc_id").agg(F.count("*").alias("n")))
        return rows.join(place, "doc_id").withColumn("pool_id", F.concat(F.lit(letter), F.col("before") + number)).drop("before")

    own = done.findings.filter("source <> 'review'")
    found = numbered(own, "F", F.substring("id", 2, 20).cast("long"))
    added = done.findings.filter("source = 'review'").withColumn("pool_id", F.col("id"))
    return numbered(done.segs, "S", F.col("seg_no").cast("long")), found.unionByName(added)


def result_rows(done: Check) -> DataFrame:
    """(doc_id, result): one JSON text for each document, to be written with ``write.text`` or ``write.parquet``: its score,
    segments, findings, rewrites and warnings, each list in order."""
    scores = done.scores.filter("doc_id is not null")

    def listed(rows: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
        item = F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), F.struct(*columns).alias("x"))
        return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias(name))

    out = scores.select("doc_id", F.struct(*(c for c in scores.columns if c != "doc_id")).alias("score"))
    parts = [
        listed(done.segs, "segments", ["seg_no"], ["seg_no", "block", "idx", "line", "kind", "text", "words"]),
        listed(done.findings, "findings", ["seg_no", "start", "id"], ["id", "rule", "tier", "conf", "message", "fix", "seg_no", "line", "start", "end", "quote", "source", "status", "note"]),
        listed(done.rewrites, "rewrites", ["n"], ["seg_no", "original", "rewrite", "left"]),
        listed(done.warnings, "warnings", ["warning"], ["warning"]),
    ]
    for p in parts:
        out = out.join(p, "doc_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), out.schema[c].dataType))
    body = F.struct(F.lit(1).alias("schema"), F.lit(done.level).alias("level"), F.lit(done.mark).alias("pass_mark"), F.lit(done.reviewed).alias("reviewed"), "score", *(empty(c).alias(c) for c in ("segments", "findings", "rewrites", "warnings")))
    return out.select("doc_id", F.to_json(body).alias("result"))
