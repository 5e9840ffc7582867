"""The registered queries and their SQL.

Detectors find nothing in the corpus for many rules, so their queries run over generated documents: each part's key put into
own sentences (``templates``). The SQL states the findings that these sentences must give. Other queries run over the whole
``documents`` and ``conversations`` tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import checking, detectors, dictionary, findings, review, scoring, views
from ..operators.segments import segments
from .corpus_rules import CORPUS_RULES_SQL, corpus_rules
from .templates import cases

CASES = cases()
DETECTORS = sorted({c[1] for c in CASES})
STEP = 1_000_000
#: More than there are sentences: key * SENTENCES + number tells all pairs apart, which number * STEP + key doesn't.
SENTENCES = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generated(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(doc_id, text): each part with each sentence of these detectors; doc_id is key * SENTENCES + number."""
    rows = [(n, s) for n, d, s, _ in CASES if d in names]
    # a few dozen sentences against the parts: each part is widened, nothing is shuffled
    parts = table(spark, sf_dir, "part").select("p_partkey")
    wide = parts.select("p_partkey", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(s).alias("line")) for n, s in rows))).alias("c"))
    return wide.select((F.col("p_partkey").cast("long") * SENTENCES + F.col("c.n")).alias("doc_id"), F.regexp_replace("c.line", F.lit(r"\{k\}"), F.col("p_partkey").cast("string")).alias("text"))


def detector_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        segs = segments(generated(spark, sf_dir, [name]))
        # the ids of the SQL repeat where keys reach STEP, so findings get them only at the end
        number, key = F.pmod("doc_id", F.lit(SENTENCES)), F.shiftright("doc_id", SENTENCES.bit_length() - 1)
        return detectors.detect(segs, [name]).select((number * STEP + key).alias("doc_id"), "rule", "conf", "start", "end")

    return run


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _signal(sentence: str) -> str:
    return next((p for p in ("NOTE: ", "WARNING: ", "CAUTION: ") if sentence.startswith(p)), "")


def expected(names: list[str]) -> str:
    """SQL of the findings that the sentences of these detectors must give: doc_id, rule, conf, quote, start, end."""
    rows = []
    for n, d, s, found in CASES:
        if d in names:
            body = s.removeprefix(_signal(s))
            for rule, conf, quote, nth in found:
                rows.append(f"({n}, {_quote(body)}, {_quote(rule)}, {_quote(conf)}, {_quote(body if quote == '*' else quote)}, {nth})")
    if not rows:
        rows = ["(0, '', '', '', '', 0)"]
    return f"""(SELECT n * {STEP} + p_partkey AS doc_id, rule, conf, replace(quote, '{{k}}', p_partkey::VARCHAR) AS quote,
      CASE WHEN nth = 1 THEN instr(replace(body, '{{k}}', p_partkey::VARCHAR), replace(quote, '{{k}}', p_partkey::VARCHAR)) - 1
        ELSE length(split_part(body, quote, 1)) + length(replace(split_part(body, quote, 2), '{{k}}', p_partkey::VARCHAR)) + length(quote) END AS start
      FROM part CROSS JOIN (VALUES {", ".join(rows)}) AS t(n, body, rule, conf, quote, nth) WHERE rule <> '')"""


def detector_sql(name: str) -> str:
    return f'SELECT doc_id, rule, conf, start::INTEGER AS start, (start + length(quote))::INTEGER AS "end" FROM {expected([name])} e'


# ---- scores over generated documents of several sentences

#: Sentences of the scored documents: text, and the worst tier of a counted finding (0: none).
SCORED = [("Read the label of part {k}.", 0), ("You can't move part {k}.", 60), ("The pump is turning near part {k}.", 80), ("The colour of part {k} is good.", 100), ("Stop the pump of part {k}.", 0)]


def _scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's document has the first 1 + key modulo 5 of the sentences."""
    pieces = [F.when(F.col("p_partkey") % 5 >= k, F.regexp_replace(F.lit(s), r"\{k\}", F.col("p_partkey").cast("string"))) for k, (s, _) in enumerate(SCORED)]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", *pieces).alias("text"))


#: Detectors of the scored documents; ``findings_all`` runs all of them.
CORE = ["sentence_length", "paragraph_length", "semicolons", "contractions", "tenses", "spelling", "inclusive"]


def _checked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    segs = segments(docs).persist()
    return segs, findings.finish(detectors.detect(segs, CORE), segs)


def score_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scored_docs(spark, sf_dir)
    segs, found = _checked(docs)
    return scoring.score(docs, segs, found, pooled=False).select("doc_id", "segments", "violations", "band_60", "band_80", "band_100", "score", "passed")


def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scored_docs(spark, sf_dir)
    segs, found = _checked(docs)
    return scoring.score(docs, segs, found).filter("doc_id is null").select("segments", "violations", F.round("band_60", 9).alias("band_60"), "score", "passed", "no_text")


_SENTENCES = "(SELECT p_partkey AS doc_id, t.k, t.tier FROM part JOIN (VALUES " + ", ".join(f"({k}, {t})" for k, (_, t) in enumerate(SCORED)) + ") AS t(k, tier) ON p_partkey % 5 >= t.k)"
_BANDS = "count(*) AS segments, count(*) FILTER (tier > 0) AS violations, " + ", ".join(f"count(*) FILTER (tier = 0 OR tier > {t}) / count(*)::DOUBLE AS band_{t}" for t in (60, 80, 100))
_SCORE = "floor((60 * band_60 + 20 * band_80 + 20 * band_100) * 10 + 1e-9) / 10"
SCORE_SQL = f"SELECT doc_id, segments, violations, band_60, band_80, band_100, {_SCORE} AS score, {_SCORE} >= 80 AS passed FROM (SELECT doc_id, {_BANDS} FROM {_SENTENCES} s GROUP BY doc_id) b"
ROLLUP_SQL = f"SELECT segments, violations, round(band_60, 9) AS band_60, {_SCORE} AS score, {_SCORE} >= 80 AS passed, FALSE AS no_text FROM (SELECT {_BANDS} FROM {_SENTENCES} s) b"


def by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs, found = _checked(_scored_docs(spark, sf_dir))
    return views.by_rule(found)


BY_RULE_SQL = f"SELECT CASE tier WHEN 60 THEN '4.2' WHEN 80 THEN '3.2' ELSE '1.14' END AS rule, count(*) AS counted, 0::BIGINT AS open, 0::BIGINT AS other FROM {_SENTENCES} s WHERE tier > 0 GROUP BY tier"


def by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs, found = _checked(_scored_docs(spark, sf_dir))
    return views.by_word(found)


BY_WORD_SQL = f"SELECT 'colour' AS word, '1.14' AS rule, 'color' AS fix, count(*) AS n, 'not approved' AS label FROM {_SENTENCES} s WHERE tier = 100 HAVING count(*) > 0"


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = checking.check(_scored_docs(spark, sf_dir), names=[*CORE, "noun_clusters", "two_instructions"])
    return views.gauges(done.segs, done.findings)


GAUGES_SQL = f"""WITH s AS (SELECT *, CASE WHEN k IN (0, 4) THEN 'proc' ELSE 'desc' END AS kind,
    CASE k WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 7 ELSE 6 END AS words FROM {_SENTENCES} x)
SELECT kind AS gauge, CASE kind WHEN 'proc' THEN 20 ELSE 25 END AS "limit", max(words)::BIGINT AS worst, 0::BIGINT AS over, count(*) AS n FROM s GROUP BY kind
UNION ALL SELECT 'paragraph', 6, max(c), count(*) FILTER (c > 6), count(*) FROM (SELECT doc_id, count(*) AS c FROM s WHERE kind = 'desc' GROUP BY doc_id) p
UNION ALL SELECT 'multi-word noun', 3, 3, 0, 1 FROM s HAVING count(*) > 0
UNION ALL SELECT 'instructions', 1, 1, 0, count(*) FROM s WHERE kind = 'proc' HAVING count(*) > 0"""


# ---- the corpus


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    turns = table(spark, sf_dir, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("doc_id"), "text")
    return docs.union(turns)


_BOTH = "(SELECT doc_id, text FROM documents UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations)"
_WORDS = r"string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+')"


def gendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their number of gendered pronouns: one match of a word is one hit, wherever its sentence ends."""
    rx = r"(?Udi)\b(?:he|she|him|his|hers|her|himself|herself)\b"
    return _both(spark, sf_dir).select("doc_id", F.regexp_count(X.clean(F.col("text")), F.lit(rx)).cast("long").alias("hits")).filter("hits > 0")


GENDERED_SQL = f"SELECT doc_id, hits FROM (SELECT doc_id, len(list_filter({_WORDS}, lambda w: w IN ('he', 'she', 'him', 'his', 'hers', 'her', 'himself', 'herself')))::BIGINT AS hits FROM {_BOTH} b) x WHERE hits > 0"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitution words in the corpus: each approved alternative's word with its number of uses, single words only."""
    rows = [r for r in detectors.word_rows() if " " not in r["word"]]
    known = spark.createDataFrame([(f, r["word"]) for r in rows for f in L.forms(r["word"], r["pos"])], "w string, word string").dropDuplicates(["w"])
    words = _both(spark, sf_dir).select(F.explode(F.split(F.lower(X.clean(F.col("text"))), r"[^\p{L}\p{N}\p{M}_]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.join(F.broadcast(known), "w").groupBy("w").agg(F.sum("n").alias("n"))


VOCABULARY_SQL = f"SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM {_BOTH} b) x WHERE w IN (" + ", ".join(sorted({_quote(f) for r in detectors.word_rows() if " " not in r["word"] for f in L.forms(r["word"], r["pos"])})) + ") GROUP BY w"


def seg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and words of each document."""
    return segments(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"))


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the corpus, by document and rule."""
    segs = segments(table(spark, sf_dir, "documents")).persist()
    return findings.finish(detectors.detect(segs), segs).groupBy("doc_id", "rule", "conf").agg(F.count("*").alias("n"))


# ---- dictionary and review

ENTRIES = [(1, "STOP", "v", True, [], ["STOPS", "STOPPED"]), (2, "PUMP", "n", True, [], []), (3, "MAKE SURE", "v", True, [], []), (4, "commence", "v", False, ["START (v)"], []), (5, "device", "n", False, ["UNIT (n)"], []), (6, "SAFE", "adj", True, [], [])]
CLASSIFIED = "stop:approved stops:approved pumps:approved sure:approved commence:unapproved commenced:unapproved commencing:unapproved devices:unapproved stopping:form safer:form safely:form pump:approved gizmo:unknown make:approved".split()


def dict_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = dictionary.lookup(spark.createDataFrame(ENTRIES, "entry int, word string, pos string, approved boolean, alts array<string>, forms array<string>"))
    words = spark.createDataFrame([(x.split(":")[0],) for x in CLASSIFIED], "word string")
    return dictionary.classify(words, table_).select("word", "kind")


DICT_SQL = "SELECT word, kind FROM (VALUES " + ", ".join(f"('{x.split(':')[0]}', '{x.split(':')[1]}')" for x in CLASSIFIED) + ") AS t(word, kind)"


def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scored document's first finding rejected where the key is even, confirmed where it is odd; then counted findings."""
    segs, found = _checked(_scored_docs(spark, sf_dir))
    found = found.persist()
    decisions = found.filter("id = 'F1'").select("doc_id", "id", F.when(F.col("doc_id") % 2 == 0, "rejected").otherwise("confirmed").alias("status"), F.lit("").alias("note"))
    decided, _ = review.decide(found, decisions)
    return decided.groupBy("doc_id").agg(F.count_if("counted").alias("counted"), F.count_if(F.col("status") == "rejected").alias("rejected"))


REVIEW_SQL = f"SELECT doc_id, count(*) - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS counted, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS rejected FROM {_SENTENCES} s WHERE tier > 0 GROUP BY doc_id"


def review_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after a review: the first finding of documents with even keys is rejected, and each document with a finding
    gets one that a reader adds at its first sentence."""
    done = checking.check(_scored_docs(spark, sf_dir), names=CORE)
    first = done.findings.filter("id = 'F1'")
    decisions = first.filter("doc_id % 2 = 0").select("doc_id", "id", F.lit("rejected").alias("status"), F.lit("").alias("note"))
    items = first.select("doc_id", F.lit(1).alias("n"), F.lit("2.1").alias("rule"), F.lit("1").alias("line"), F.lit("the label").alias("quote"), F.lit("").alias("fix"), F.lit("").alias("note"))
    scores = checking.apply_review(done, decisions, items).scores
    return scores.filter("doc_id is not null").select("doc_id", "segments", "violations", "score", "passed")


_REVIEWED = f"(SELECT doc_id, k, CASE WHEN k = 1 AND doc_id % 2 = 0 THEN 0 WHEN k = 0 AND doc_id % 5 >= 1 THEN 60 ELSE tier END AS tier FROM {_SENTENCES} s)"
RESCORE_SQL = f"SELECT doc_id, segments, violations, {_SCORE} AS score, {_SCORE} >= 80 AS passed FROM (SELECT doc_id, {_BANDS} FROM {_REVIEWED} s GROUP BY doc_id) b"


def pooled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of segments and findings through all documents."""
    segs, found = checking.pooled(checking.check(_scored_docs(spark, sf_dir), names=CORE))
    return segs.select("doc_id", "seg_no", "pool_id").union(found.select("doc_id", "seg_no", "pool_id"))


POOLED_SQL = f"""SELECT doc_id, (k + 1)::INTEGER AS seg_no, 'S' || row_number() OVER (ORDER BY doc_id, k) AS pool_id FROM {_SENTENCES} s
UNION ALL SELECT doc_id, (k + 1)::INTEGER, 'F' || row_number() OVER (ORDER BY doc_id, k) FROM {_SENTENCES} s WHERE tier > 0"""


def check_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by all detectors, and of all together."""
    return checking.check(table(spark, sf_dir, "documents")).scores


def enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 101).select(F.col("id").alias("level"), scoring.enforced_tier(F.col("id")).alias("tier"))


ENFORCED_SQL = "SELECT range AS level, CASE WHEN range <= 60 THEN 60 WHEN range <= 80 THEN 80 ELSE 100 END AS tier FROM range(0, 101)"

_QUERIES = {"score_doc": score_doc, "score_rollup": score_rollup, "by_rule": by_rule, "by_word": by_word, "gauges": gauges, "gendered": gendered, "vocabulary": vocabulary, "corpus_rules": corpus_rules, "seg_counts": seg_counts, "findings_all": findings_all, "dict_classify": dict_classify, "review_apply": review_apply, "review_rescore": review_rescore, "pooled_ids": pooled_ids, "check_documents": check_documents, "enforced_tier": enforced}
_SQL = {"score_doc": SCORE_SQL, "score_rollup": ROLLUP_SQL, "by_rule": BY_RULE_SQL, "by_word": BY_WORD_SQL, "gauges": GAUGES_SQL, "gendered": GENDERED_SQL, "vocabulary": VOCABULARY_SQL, "corpus_rules": CORPUS_RULES_SQL, "dict_classify": DICT_SQL, "review_apply": REVIEW_SQL, "review_rescore": RESCORE_SQL, "pooled_ids": POOLED_SQL, "enforced_tier": ENFORCED_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | {f"det_{d}": detector_query(d) for d in DETECTORS}


def oracle_sql() -> dict[str, str]:
    return _SQL | {f"det_{d}": detector_sql(d) for d in DETECTORS}
