"""Sources: folders of text files, bytes in several encodings, tables of substitutions."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SUFFIXES = (".md", ".markdown", ".txt", ".rst")
# Folders that are left out.
SKIPPED = ".git node_modules .venv venv check-reports __pycache__".split()


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 with a mark, else UTF-8 with or without one, else Windows-1252; line ends become LF."""
    head = F.hex(F.substring(content, 1, 2))
    utf8 = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    # Windows-1252 differs from Latin-1 at 0x80 to 0x9F only
    latin = F.translate(F.decode(content, "ISO-8859-1"), bytes(range(0x80, 0xA0)).decode("latin-1"), bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace"))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(utf8.cast("string")), utf8.cast("string")).otherwise(latin)
    return F.regexp_replace(text, "\r\n?", "\n")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of a folder's text files, without hidden and vendor folders; equal paths (by lower case) once."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    low = F.lower("path")
    kept = raw.filter(low.rlike(r"\.(?:md|markdown|txt|rst)$") & ~F.col("path").rlike(r"/\.[^/]+/") & ~F.col("path").rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy(low).orderBy("path"))).filter("_n = 1")
    return first.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), decoded(F.col("content")).alias("text"))


def inputs(spark: SparkSession, places: list[str]) -> DataFrame:
    """(doc_id, name, text) of files, folders and globs, in any store that Spark reads.

    A file that is named itself is read whatever its suffix; a folder gives its text files without hidden and vendor
    folders; a glob gives the files it matches outside of vendor folders that it doesn't name. ``name`` is the path below
    the place it came from, or the file's own name. Of equal paths (by lower case) the first in the order of ``places``
    stays. A place that gives nothing is a FileNotFoundError.
    """
    found = []
    for k, place in enumerate(places):
        base = place.rstrip("/")
        pattern = any(c in place for c in "*?[{")
        try:
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(not pattern).lower()).load(place).select("path", "content")
        except AnalysisException as e:
            raise FileNotFoundError(f"no input at {place}") from e
        path = F.col("path")
        own = path.endswith(base) & F.lit(not pattern)
        below = F.when(F.contains(path, F.lit(base + "/")) & F.lit(not pattern), F.substring_index(path, base + "/", -1)).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))
        below = F.when(own, F.lit(PurePosixPath(base).name)).otherwise(below)
        # a place that lies in such a folder itself, or names one, is meant
        left_out = [s for s in SKIPPED if s not in PurePosixPath(base).parts]
        vendor = F.concat(F.lit("/"), below if not pattern else path).rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in left_out) + ")/")
        text = path.rlike(r"(?i)\.(?:md|markdown|txt|rst)$") & ~F.concat(F.lit("/"), below).rlike(r"/\.[^/]+/")
        rows = raw.filter(own | (~vendor & (text | F.lit(pattern)))).select(F.lit(k).alias("_place"), "path", below.alias("name"), "content")
        if rows.select("path").isEmpty():
            raise FileNotFoundError(f"no text files at {place}")
        found.append(rows)
    if not found:
        raise FileNotFoundError("no input is named")
    rows = reduce(DataFrame.unionByName, found)
    first = Window.partitionBy(F.lower("path")).orderBy("_place", "path")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(F.xxhash64("path").alias("doc_id"), "name", decoded(F.col("content")).alias("text"))


def substitution_lines(spark: SparkSession, path: str) -> list[str]:
    """Rows of a tab-separated substitution table as lines for ``detectors.word_rows``; it is a small table by nature."""
    rows = spark.read.text(path).filter("value <> '' and not startswith(value, '#')").collect()
    out = []
    for r in rows[1:]:
        cells = (r["value"].split("\t") + [""] * 9)[:9]
        word, pos, use, rule, tier, _, ctx, conf, _ = (c.strip() for c in cells)
        out.append(f"{word} | {pos} | {use} | {rule} {tier} {ctx} {conf}")
    return out
