"""Masks, sentences, word counts, kinds and blocks."""

import pytest
from pyspark.sql import functions as F

from lumenprose.functions import lexicon as L
from lumenprose.functions import text as X
from lumenprose.operators.blocks import read_blocks
from lumenprose.operators.segments import segments


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,masked", [
    ("Use `a b` now", "Use _____ now"),
    ("See https://a.b/c, then", "See _____________, then"),
    ("A **bold** word", "A   bold   word"),
    ("An <b>x</b> &amp; y", "An    x           y"),
    ("It’s “so”", "It's \"so\""),
    ("snake_case stays", "snake_case stays"),
])
def test_mask_keeps_length(spark, text, masked):
    got = value(spark, text, X.mask)
    assert got == masked and len(got) == len(text)


@pytest.mark.parametrize("text,n", [("One. Two! Three?", 3), ("See fig. 3 now. Go.", 2), ("It is e.g. Good so.", 1), ("Wait. then go", 1), ("A list:\nB", 2), ("", 1)])
def test_sentences(spark, text, n):
    got = value(spark, text, X.sentences)
    assert len(got) == n and "".join(got) == text


@pytest.mark.parametrize("text,n", [("Open the valve", 3), ("Add 20 kg of sand", 4), ("See (the long note) now", 3), ("Say \"a b c\" twice", 3), ("Go to Main Street Road now", 4), ("A well-known part", 3), ("", 0)])
def test_count_words(spark, text, n):
    assert value(spark, text, X.count_words) == n


def test_match_offsets(spark):
    got = value(spark, "ab xaby ab", lambda t: X.matches(t, "(?Ud)a(b)", 1))
    assert [(m["start"], m["end"], m["text"], m["g"]) for m in got] == [(0, 2, "ab", ["b"]), (4, 6, "ab", ["b"]), (8, 10, "ab", ["b"])]


def test_blocks():
    text = "---\nt: x\n---\n# Head\n\nPara one\nline two\n\n- item\n1. step\n\n```\ncode here\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n<!-- gone\nstill -->\nTitle\n=====\n> [!TIP]\n> Text\n"
    got = [(b["kind"], b["signal"], " ".join(x["content"] for x in b["lines"])) for b in read_blocks(text)]
    assert got == [("title", "", "Head"), ("para", "", "Para one line two"), ("item", "", "item"), ("num", "", "step"), ("cell", "", "a"), ("cell", "", "b"), ("cell", "", "c"), ("cell", "", "d"), ("title", "", "Title"), ("para", "note", "Text")]


def test_segments_lines_and_kinds(spark):
    text = "# Head\n\nOpen the lid. The lid\nis hot. It is on.\n\n1. The element melts.\n2. The water boils.\n3. Close the tap.\n\nWARNING: Do not touch it."
    rows = segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id", "seg_no").collect()
    assert [(r.kind, r.line, r.text) for r in rows] == [("title", 1, "Head"), ("proc", 3, "Open the lid."), ("desc", 3, "The lid\nis hot."), ("desc", 4, "It is on."), ("desc", 6, "The element melts."), ("desc", 7, "The water boils."), ("proc", 8, "Close the tap."), ("warning", 10, "Do not touch it.")]


def test_plain_and_structured_agree(spark):
    text = "First one. Second\none here.\n\nThird: a part. 20 kg of it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert segments(docs).collect() == segments(docs, structured=False).collect()


def test_doc_type(spark):
    docs = spark.createDataFrame([(1, "The lid is hot.")], "doc_id long, text string")
    assert segments(docs, "proc").first().kind == "proc"
    with pytest.raises(ValueError):
        segments(docs, "other")


def test_forms():
    assert set(L.forms("stop", "v")) == {"stop", "stops", "stoped", "stoping", "stopped", "stopping"}
    assert L.forms("ability", "n") == ["ability", "abilities"]
    assert L.spellings()["colours"] == "colors" and L.spellings()["metred"] == "metered" and L.spellings()["travelled"] == "traveled"
