"""Report views: each is a query over segments and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the report's lists.
WORST, WORD_ROWS, LISTED = 8, 30, 50
WORD_RULES = ["1.1", "1.2", "1.3", "1.14"]


def state(enforced: int = 100) -> Column:
    return F.when(F.col("status") == "rejected", "rejected").when(F.col("source") == "house", "house").when(F.col("seg_no").isNull(), "doc").when(F.col("counted"), F.when(F.col("tier") > enforced, "beyond").otherwise("counted")).otherwise("open")


def by_rule(findings: DataFrame, enforced: int = 100) -> DataFrame:
    s = F.col("state")
    rows = findings.withColumn("state", state(enforced)).filter(s != "house")
    counts = {"counted": s.isin("counted", "beyond"), "open": s == "open", "other": ~s.isin("counted", "beyond", "open")}
    return rows.groupBy("rule").agg(*(F.count_if(c).alias(k) for k, c in counts.items())).orderBy(F.desc("counted"), F.desc("open"), "rule")


def by_word(findings: DataFrame, enforced: int = 100, most: int = WORD_ROWS) -> DataFrame:
    rows = findings.withColumn("state", state(enforced)).filter(F.col("rule").isin(WORD_RULES) & (F.col("fix") != "") & (F.size(F.split(F.trim("quote"), r"\s+")) <= 4))
    has = lambda *x: F.bool_or(F.col("state").isin(*x))
    label = F.when(has("house"), "house").when(has("counted", "beyond"), "not approved").when(has("open"), "open").otherwise("accepted")
    return rows.groupBy(F.lower("quote").alias("word"), "rule", "fix").agg(F.count("*").alias("n"), label.alias("label")).orderBy(F.desc("n"), "word", "rule", "fix").limit(most)


def worst_sentences(segs: DataFrame, findings: DataFrame, enforced: int = 100, most: int = WORST, rewrites: DataFrame | None = None) -> DataFrame:
    """The sentences with the heaviest findings; a rewrite (doc_id, seg_no) weighs 10, also where nothing was found."""
    rows = findings.withColumn("state", state(enforced)).filter("seg_no is not null and state <> 'rejected'")
    weight = F.sum(F.when(F.col("state") == "counted", 3 + (100 - F.col("tier")) / 20.0).otherwise(1.0))
    heavy = rows.groupBy("doc_id", "seg_no").agg(weight.alias("weight"), F.count("*").alias("n"))
    if rewrites is not None:
        once = rewrites.filter("seg_no is not null").select("doc_id", "seg_no").distinct()
        heavy = heavy.unionByName(once.select("*", F.lit(10.0).alias("weight"), F.lit(0).cast("long").alias("n"))).groupBy("doc_id", "seg_no").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    return heavy.join(segs.select("doc_id", "seg_no", "kind", "text"), ["doc_id", "seg_no"]).orderBy(F.desc("weight"), "doc_id", "seg_no").limit(most)


def gauges(segs: DataFrame, findings: DataFrame, enforced: int = 100) -> DataFrame:
    """(gauge, limit, worst, over, n) of sentences, paragraphs, multi-word nouns and instructions in a sentence.

    Multi-word nouns are those of findings; if there are none, the longest has the three words that are permitted.
    """
    words = segs.filter(F.col("kind").isin("proc", "desc")).select(F.col("kind").alias("gauge"), F.when(F.col("kind") == "proc", 20).otherwise(25).alias("limit"), F.col("words").cast("long").alias("v"))
    paras = segs.filter("kind = 'desc'").groupBy("doc_id", "block").agg(F.count("*").alias("v")).select(F.lit("paragraph").alias("gauge"), F.lit(6).alias("limit"), "v")
    sizes = words.union(paras).groupBy("gauge", "limit").agg(F.max("v").alias("worst"), F.count_if(F.col("v") > F.col("limit")).alias("over"), F.count("*").alias("n"))
    live = findings.withColumn("state", state(enforced)).filter(F.col("state").isin("counted", "beyond", "open"))
    noun, long = F.col("rule") == "2.1", F.size(F.split(F.trim("quote"), r"\s+")).cast("long")
    seen = live.agg(F.max(F.when(noun, long)).alias("longest"), F.count_if(noun & (long > 3)).alias("over"), F.count_if(noun).alias("nouns"), F.count_if(F.col("rule") == "5.2").alias("two"))
    texts = segs.agg(F.count("*").alias("all"), F.count_if(F.col("kind") == "proc").alias("proc"))
    # two rows of counts become one
    one = texts.unionByName(seen, allowMissingColumns=True).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("all", "proc", "longest", "over", "nouns", "two")))
    row = lambda gauge, limit, worst, over, n: F.struct(F.lit(gauge).alias("gauge"), F.lit(limit).alias("limit"), worst.alias("worst"), over.alias("over"), n.alias("n"))
    none = F.col("nouns") == 0
    nouns = row("multi-word noun", 3, F.when(none, F.lit(3).cast("long")).otherwise(F.col("longest")), F.col("over"), F.when(none, F.least("all", F.lit(1).cast("long"))).otherwise(F.col("nouns")))
    steps = row("instructions", 1, F.when(F.col("two") > 0, F.lit(2).cast("long")).otherwise(F.lit(1).cast("long")), F.col("two"), F.when(F.col("proc") > 0, F.greatest("proc", "two")).otherwise(F.lit(0).cast("long")))
    return sizes.union(one.select(F.explode(F.array(nouns, steps)).alias("g")).select("g.*").filter("n > 0"))


def states(findings: DataFrame, enforced: int = 100) -> DataFrame:
    """(state, n) of all findings."""
    return findings.groupBy(state(enforced).alias("state")).agg(F.count("*").alias("n"))


def files(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, name, segments, words, score, result) of each document; ``docs`` has a name. The result is pass, fail or no text."""
    result = F.when(F.col("no_text"), "no text").when(F.col("passed"), "pass").otherwise("fail")
    return docs.select("doc_id", "name").join(scores.filter("doc_id is not null"), "doc_id").select("doc_id", "name", "segments", "words", "score", result.alias("result"))


def kinds(segs: DataFrame) -> DataFrame:
    return segs.groupBy("kind").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


def annotated(segs: DataFrame, findings: DataFrame, enforced: int = 100) -> DataFrame:
    """(doc_id, seg_no, start, end, chunk, state): each segment cut at all spans, each chunk with its most severe cover."""
    severity = F.when(F.col("state") == "counted", 4).when(F.col("state") == "open", 3).when(F.col("state") == "beyond", 2).when(F.col("state") == "house", 1)
    spans = findings.withColumn("state", state(enforced)).withColumn("severity", severity).filter("severity is not null").join(segs.select("doc_id", "seg_no", "text"), ["doc_id", "seg_no"]).filter((F.col("end") > F.col("start")) & ~((F.col("start") == 0) & (F.col("end") == F.length("text"))))
    each = spans.groupBy("doc_id", "seg_no", "text").agg(F.collect_list(F.struct("severity", "state", "start", "end")).alias("s"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length("text")), F.transform("s", lambda x: x["start"]), F.transform("s", lambda x: x["end"]))))
    each = each.withColumn("cuts", cuts).select("doc_id", "seg_no", "text", "s", "cuts", F.explode(F.sequence(F.lit(0), F.size(cuts) - 2)).alias("k"))
    a, b = F.get("cuts", F.col("k")), F.get("cuts", F.col("k") + 1)
    cover = F.array_max(F.filter("s", lambda x: (x["start"] <= F.col("a")) & (F.col("b") <= x["end"])))
    each = each.withColumn("a", a).withColumn("b", b)
    return each.select("doc_id", "seg_no", F.col("a").alias("start"), F.col("b").alias("end"), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("chunk"), cover["state"].alias("state"))
