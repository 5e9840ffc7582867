"""What happens to findings after detection: shields, overlaps, numbers; and the allow list."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def allow_pattern(terms: list[str]) -> str | None:
    """A pattern of the allowed terms, longer ones first, with the usual endings."""
    phrases = {" ".join(t.split()) for t in terms if t} - {""}
    if not phrases:
        return None
    # re.escape writes a blank as "\ "; in a text it may be any white space
    longest_first = sorted(phrases, key=lambda p: (-len(p), p))
    any_of = "|".join(re.escape(p) for p in longest_first).replace("\\ ", r"\s+")
    inside_word = r"[\w'\-]"
    return rf"(?Udi)(?<!{inside_word})(?:{any_of})(?:e?[sd]|ing)?(?!{inside_word})"


def shield(findings: DataFrame, segs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Without the findings that lie inside a quotation (strictly) or an allowed term (ends included)."""
    rx = allow_pattern(allow or [])
    quoted = F.filter(X.top_spans(F.col("masked")), lambda s: F.substring(F.col("masked"), s["start"] + 1, F.lit(1)) == '"')
    allowed = F.transform(X.matches(F.col("masked"), rx), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) if rx else F.array().cast("array<struct<start:int,end:int>>")
    some = F.col("masked").contains('"') | (F.col("masked").rlike(rx) if rx else F.lit(False))
    spans = segs.filter(some).select("doc_id", "seg_no", quoted.alias("q"), allowed.alias("w"))
    rows = findings.join(spans, ["doc_id", "seg_no"], "left")
    inside = F.exists("q", lambda s: (s["start"] < F.col("start")) & (F.col("end") < s["end"])) | F.exists("w", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]))
    return rows.filter(~F.coalesce(inside, F.lit(False))).select(*findings.columns)


def suppress(findings: DataFrame) -> DataFrame:
    """In order of place (longer ones first), a finding that overlaps a kept one of the same rule in its segment goes.

    A dropped finding doesn't extend what is covered, so this is a fold over each segment's and rule's few findings.
    """
    rest = [c for c in findings.columns if c not in ("doc_id", "seg_no", "rule", "start", "end", "det")]
    item = F.struct("start", (-F.col("end")).alias("back"), "det", "end", F.struct(*rest).alias("rest"))
    groups = findings.groupBy("doc_id", "seg_no", "rule").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kind = groups.schema["all"].dataType.simpleString()
    zero = F.struct(F.lit(-1).alias("top"), F.array().cast(kind).alias("kept"))
    kept = F.aggregate("all", zero, lambda s, x: F.struct(F.when(x["start"] >= s["top"], x["end"]).otherwise(s["top"]).alias("top"), F.when(x["start"] >= s["top"], F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept")), lambda s: s["kept"])
    return groups.select("doc_id", "seg_no", "rule", F.explode(kept).alias("x")).select("doc_id", "seg_no", "rule", "x.start", "x.end", "x.det", "x.rest.*").select(*findings.columns)


def number(findings: DataFrame) -> DataFrame:
    """``id``: F1, F2, ... in document order, for each document."""
    order = Window.partitionBy("doc_id").orderBy("seg_no", "start", F.desc("end"), "det", "rule", "fix")
    return findings.withColumn("id", F.concat(F.lit("F"), F.row_number().over(order)))


def finish(findings: DataFrame, segs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Shielded, without overlaps, numbered, with quote, status and whether it counts."""
    rows = number(suppress(shield(findings, segs, allow)))
    place = segs.select("doc_id", "seg_no", F.col("line").alias("seg_line"), "text")
    rows = rows.join(place, ["doc_id", "seg_no"]).withColumn("quote", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("line", (F.col("seg_line") + F.regexp_count(F.substring("text", F.lit(1), F.col("start")), F.lit("\n"))).cast("int")).drop("text", "seg_line")
    return rows.withColumn("status", F.lit("open")).withColumn("counted", (F.col("source") != "house") & (F.col("conf") == "high"))
