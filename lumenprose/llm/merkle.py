"""Operator 7 [native]: document fingerprints as Merkle trees over paragraphs and sections.

A text's paragraphs are its lines; a paragraph's leaves are its clauses, cut
to four words at most. A leaf has a 32-bit hash of its text; a
paragraph's hash is taken of its leaves' hashes, a section's of up to ``SECTION`` paragraphs' hashes and the root's of the
sections' hashes and the text (sha2-256). The fingerprint is written as ``root:sections/paragraphs/leaves``: the root in full, the other levels shortened,
so that equal texts have equal fingerprints, roots test equality, and going down only where branches differ locates edits.

Only Spark SQL functions are used.

Defined cases: null texts are empty; an empty text has a root and one empty branch; very long texts are read whole, each row by
itself; rows that repeat an id are ordered by their text when neighbours are sought, null ids come first; a single row is its
own neighbour; equal texts (ties) have equal fingerprints; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, table

#: Paragraphs in a section; hex digits of a section's or paragraph's, and of a leaf's hash.
SECTION, BRANCH, LEAF = 16, 12, 8
#: A leaf: up to four words, or fewer where one ends with a mark.
LEAVES = r"\s*+\S++(?<![.!?,;:])(?:\s++\S++(?<![.!?,;:])){0,2}(?:\s++\S++)?+|\s*+\S++|\s++"


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def tree(text: Column) -> Column:
    """For each paragraph (line) the array of its leaves' 32-bit hashes."""
    return F.transform(F.split(text, r"\n"), lambda x: F.transform(F.regexp_extract_all(x, F.lit(LEAVES), F.lit(0)), lambda y: F.hash(F.trim(y))))


def fingerprints(rows: DataFrame, **names: tuple[str, str]) -> DataFrame:
    """``rows`` with a fingerprint for each name = (column of a text, column of its ``tree``).

    Each level is a column of its own, so that it is computed once however often the next level uses it.
    """
    for name, (text, leaves) in names.items():
        shown = F.transform(F.col(leaves), lambda x: F.array_join(F.transform(x, lambda v: F.lpad(F.lower(F.substring(F.hex(v.cast("long")), -LEAF, LEAF)), LEAF, "0")), "."))
        rows = rows.withColumn("_joined", shown)
        rows = rows.withColumn("_paragraphs", F.transform("_joined", lambda x: F.concat(F.substring(_sha(x), 1, BRANCH), F.lit("="), x)))
        rows = rows.withColumn("_groups", F.transform(F.sequence(F.lit(0), F.floor((F.size("_paragraphs") - 1) / SECTION).cast("int")), lambda i: F.slice("_paragraphs", i * SECTION + 1, F.lit(SECTION))))
        rows = rows.withColumn("_sections", F.transform("_groups", lambda g: F.concat(F.substring(_sha(F.array_join(F.transform(g, lambda p: F.substring(p, 1, BRANCH)), ",")), 1, BRANCH), F.lit("("), F.array_join(g, ","), F.lit(")"))))
        # the root also covers the text, so texts whose shortened hashes all agree still differ in the root
        root = _sha(F.concat(_sha(F.array_join(F.transform("_sections", lambda x: F.substring(x, 1, BRANCH)), "/")), _sha(F.col(text))))
        rows = rows.withColumn(name, F.concat(root, F.lit(":"), F.array_join("_sections", "/"))).drop("_joined", "_paragraphs", "_groups", "_sections")
    return rows


def leaves_of(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(F.substring_index(print_, ":", -1), r"[0-9a-f]{12}[=(]", " "), r"[^0-9a-f]+", " "), r"\s+"))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves against all leaves of two fingerprints (Dice), 1 where the roots agree, 0 to 1."""
    x, y = F.filter(leaves_of(a), lambda v: v != ""), F.filter(leaves_of(b), lambda v: v != "")
    dice = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(dice).cast("double")


def likeness_of(x: Column, y: Column, same: Column) -> Column:
    """The same from the trees that two fingerprints hold."""
    return F.when(same, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))).cast("double")


def edits(a: Column, b: Column) -> Column:
    """Indexes (from 0) of the paragraphs of ``a`` whose branch is not in ``b``: where an edit lies.

    Where the roots agree nothing else is read; only sections that ``b`` doesn't have are entered.
    """

    def sections(p: Column) -> Column:
        return F.split(F.substring_index(p, ":", -1), "/")

    def paragraphs(p: Column) -> Column:
        return F.regexp_extract_all(p, F.lit(r"([0-9a-f]{12})="), F.lit(1))

    known = F.transform(sections(b), lambda s: F.substring(s, 1, BRANCH))
    other = F.filter(F.transform(sections(a), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: ~F.array_contains(known, F.substring(x["s"], 1, BRANCH)))
    y = paragraphs(b)
    found = F.flatten(F.transform(other, lambda x: F.filter(F.transform(paragraphs(x["s"]), lambda v, j: F.when(~F.array_contains(y, v), x["i"] * SECTION + j)), lambda v: v.isNotNull())))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(found)


def _literal(values: list[int | None]) -> Column:
    """An array of longs that the planner folds into one literal, however many values there are."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tree, next, next_tree): also the next document by ascending id; after the last one, the first.

    Ids are dealt by ranges whose bounds (as many as partitions) are literals, so that each range is ordered by itself. The
    first document of a range is also sent to the range before it; only the ranges' first ids reach the driver.
    """
    spark = docs.sparkSession
    known = id_and_text(docs)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = known.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("b")).first()["b"]
    bounds = sorted(set(got or []))
    at = F.size(F.filter(_literal(bounds), lambda b: b <= F.col("doc_id")))
    dealt = known.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(at).cast("int"))
    firsts = {r["range"]: r["first"]["doc_id"] for r in dealt.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect()}
    order = sorted(firsts)
    # where the first document of each range is also needed: at the end of the range before it
    before = dict(zip(order, [order[-1], *order], strict=False)) if order else {}
    first_of = F.get(_literal([firsts.get(r) for r in range(len(bounds) + 1)]), F.col("range"))
    also = F.when(F.col("doc_id").eqNullSafe(first_of), F.get(_literal([before.get(r) for r in range(len(bounds) + 1)]), F.col("range")).cast("int"))
    places = F.filter(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest")), F.struct(also.alias("at"), F.lit(1).alias("guest"))), lambda x: x["at"].isNotNull())
    sent = dealt.select("doc_id", "text", tree(F.col("text")).alias("tree"), F.explode(places).alias("s")).select("doc_id", "text", "tree", "s.at", "s.guest")
    window = Window.partitionBy("at").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    rows = sent.withColumn("next", F.lead("text").over(window)).withColumn("next_tree", F.lead("tree").over(window)).filter("guest = 0")
    return rows.select("doc_id", "text", "tree", F.coalesce("next", "text").alias("next"), F.coalesce("next_tree", "tree").alias("next_tree"))


def edited(text: Column, next_: Column) -> Column:
    """The last half of the code points replaced by as many (or all) first ones of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_, F.lit(1), half))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next"))).withColumn("edited_tree", tree(F.col("edited")))
    for name in ("tree", "edited_tree", "next_tree"):
        rows = rows.withColumn(f"{name}_leaves", F.array_distinct(F.flatten(name)))
    near = {"near_edited": ("edited_tree_leaves", F.col("text") == F.col("edited")), "near_next": ("next_tree_leaves", F.col("text") == F.col("next"))}
    rows = rows.withColumns({k: likeness_of(F.col("tree_leaves"), F.col(leaves), same) for k, (leaves, same) in near.items()})
    rows = fingerprints(rows, fingerprint=("text", "tree"), edited_fingerprint=("edited", "edited_tree"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
