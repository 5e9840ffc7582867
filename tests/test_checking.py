"""The whole check: results, reviews applied to it, numbers through all documents, stored rows, inputs, gauges."""

import json

import pytest
from pyspark.sql import functions as F

from lumenprose.functions import lexicon as L
from lumenprose.operators import checking, dictionary, findings, scoring, views
from lumenprose.sources import files

NAMES = ["substitutions", "semicolons", "noun_clusters", "two_instructions"]
TEXTS = [(3, "Utilize it; verify the seal.\nRead it."), (1, "Read it."), (2, None), (9, "")]


@pytest.fixture(scope="module")
def done(spark):
    return checking.check(spark.createDataFrame(TEXTS, "doc_id long, text string"), names=NAMES)


def test_check(done):
    found = done.findings.orderBy("start").collect()
    assert [(r.doc_id, r.id, r.quote, r.status) for r in found] == [(3, "F1", "Utilize", "open"), (3, "F2", ";", "open"), (3, "F3", "verify", "open")]
    assert all(r.message and (not r.fix or r.fix in r.message) for r in found)
    scores = {r.doc_id: r for r in done.scores.collect()}
    assert scores[3].score == 50.0 and scores[2].no_text and scores[9].no_text and scores[None].segments == 3


def test_levels(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert checking.check(docs, "strict", names=NAMES).mark == 100 and checking.check(docs, 60, 10, names=NAMES).mark == 10
    for bad in (101, -1, "odd", True):
        with pytest.raises(ValueError):
            checking.check(docs, bad, names=NAMES)


def test_allowed_terms():
    import re

    rx = findings.allow_pattern(["pump", "pump  seal", " ", "a.b"]).replace("(?Udi)", "(?i)")
    assert [m.group() for m in re.finditer(rx, "Pump\nseals, pumped, a.bs, axb, my-pump, pumping")] == ["Pump\nseals", "pumped", "a.bs", "pumping"]
    assert findings.allow_pattern(["", " "]) is None


def test_review_is_scored_again(spark, done):
    decisions = spark.createDataFrame([(3, "F1", "rejected", "a name"), (3, "F2", "rejected", ""), (3, "F3", "rejected", ""), (3, "F8", "confirmed", "")], "doc_id long, id string, status string, note string")
    items = spark.createDataFrame([(1, 1, "1.11", "1", "read it", "Examine it", "why"), (1, 2, "8.4", "1", "Read", "", ""), (3, 3, "1.6", "9", "absent", None, None)], "doc_id long, n int, rule string, line string, quote string, fix string, note string")
    rewrites = spark.createDataFrame([(3, 1, "1", "Utilize it; verify the seal.", "Utilize the seal."), (3, 2, "1", "Utilize it; verify the seal.", "Use it."), (3, 3, "7", "absent", "Use it."), (3, 4, "1", "x", " ")], "doc_id long, n int, line string, original string, rewrite string")
    after = checking.apply_review(done, decisions, items, rewrites)
    rows = {(r.doc_id, r.id): r for r in after.findings.collect()}
    assert rows[3, "F1"].status == "rejected" and rows[3, "F1"].note == "a name" and not rows[3, "F1"].counted
    assert (rows[1, "R1"].quote, rows[1, "R1"].counted, rows[1, "R1"].fix) == ("Read it", True, "Examine it")
    assert not rows[3, "R1"].counted and rows[3, "R1"].seg_no is None and len(rows) == 5
    assert {r.doc_id: r.score for r in after.scores.collect()}[3] == 100.0 and {r.doc_id: r.score for r in after.scores.collect()}[1] == 80.0
    assert [(r.n, r.seg_no, r.left) for r in after.rewrites.orderBy("n").collect()] == [(2, 1, ""), (3, None, "")]
    assert after.warnings.count() == 5 and after.reviewed and not done.reviewed
    # a second review goes on with the numbers
    again = checking.apply_review(after, items=items.filter("n = 1"))
    assert {r.id for r in again.findings.filter("doc_id = 1").collect()} == {"R1", "R2"}
    heavy = views.worst_sentences(after.segs, after.findings, rewrites=after.rewrites).collect()
    assert (heavy[0].doc_id, heavy[0].seg_no, heavy[0].weight) == (3, 1, 10.0)
    stored = {r.doc_id: json.loads(r.result) for r in checking.result_rows(after).collect()}
    assert set(stored) == {1, 2, 3, 9} and stored[2]["segments"] == [] and stored[2]["findings"] == []
    assert stored[3]["reviewed"] and [f["id"] for f in stored[3]["findings"]] == ["R1", "F1", "F2", "F3"]


def test_dictionary_in_a_check(spark):
    rows = [(1, "READ", "v", True, [], []), (2, "utilize", "v", False, ["OPERATE (v)"], []), (3, "commence", "v", False, ["START (v)"], [])]
    words = dictionary.lookup(spark.createDataFrame(rows, "entry int, word string, pos string, approved boolean, alts array<string>, forms array<string>"))
    docs = spark.createDataFrame([(1, "Utilize this. Read this.")], "doc_id long, text string")
    got = {(r.quote, r.source) for r in checking.check(docs, words=words, names=["substitutions"]).findings.collect()}
    assert ("Utilize", "rules") in got and ("Utilize", "dict") not in got


def test_numbers_through_all_documents(spark):
    sizes = [(i * 7 - 900, i % 4) for i in range(3000)] + [(2**62, 5), (-(2**62), 2)]
    got = {r.doc_id: r.before for r in checking.before(spark.createDataFrame(sizes, "doc_id long, n long"), 16).collect()}
    total = 0
    for i, n in sorted(sizes):
        assert got[i] == total
        total += n
    assert checking.before(spark.createDataFrame([], "doc_id long, n long")).count() == 0


def test_gauges_and_states(spark):
    docs = spark.createDataFrame([(1, "Remove the cover and clean the filter."), (2, "The pump motor bracket bolt torque is low.")], "doc_id long, text string")
    done = checking.check(docs, names=NAMES)
    got = {r.gauge: (r.limit, r.worst, r.over, r.n) for r in views.gauges(done.segs, done.findings).collect()}
    assert got["instructions"] == (1, 2, 1, 1) and got["multi-word noun"][0] == 3 and got["multi-word noun"][1] > 3 and got["multi-word noun"][2] == 1
    assert sum(r.n for r in views.states(done.findings).collect()) == done.findings.count()
    empty = checking.check(docs.limit(0), names=NAMES)
    assert views.gauges(empty.segs, empty.findings).count() == 0
    named = views.files(docs.withColumn("name", F.lit("a.md")), done.scores).collect()
    assert {(r.doc_id, r.result) for r in named} <= {(d, x) for d in (1, 2) for x in ("pass", "fail", "no text")} and len(named) == 2


def test_inputs(spark, tmp_path):
    for name in ("a.md", "one/a.md", "one/.hidden/b.md", "one/node_modules/c.md", "one/d.py", "two/note.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    base = str(tmp_path)
    get = lambda *p: sorted((r.name, r.text) for r in files.inputs(spark, list(p)).collect())
    assert get(base) == [("a.md", "a.md"), ("one/a.md", "one/a.md")]
    assert get(f"{base}/two/note.log") == [("note.log", "two/note.log")]
    assert get(f"{base}/one/*.py") == [("d.py", "one/d.py")]
    assert get(f"{base}/one", base) == [("a.md", "a.md"), ("a.md", "one/a.md")]
    for missing in (f"{base}/none", f"{base}/one/*.none", f"{base}/two"):
        with pytest.raises(FileNotFoundError):
            get(missing)


def test_each_rule_of_a_detector_has_a_message():
    from lumenprose.functions.messages import MESSAGES
    from lumenprose.operators import detectors

    assert set(MESSAGES) <= set(L.TIER)
    assert {r for _, rule, _ in detectors.REGISTRY for r in ([rule] if isinstance(rule, str) else rule) if r in L.TIER} <= set(MESSAGES)


def test_findings_are_computed_once(spark):
    """Reviews read the findings many times, and the total of scores doesn't plan what is below it a second time."""
    done = checking.check(spark.createDataFrame([(1, "You can't go.")], "doc_id long, text string"), names=["contractions"])
    assert done.findings.is_cached
    decisions = spark.createDataFrame([(1, "F1", "rejected", "")], "doc_id long, id string, status string, note string")
    checking.apply_review(done, decisions).release()
    assert not done.first.storageLevel.useMemory
    docs = spark.createDataFrame([(1,)], "doc_id long")
    segs = spark.createDataFrame([(1, 1, "desc", 3)], "doc_id long, seg_no int, kind string, words int")
    found = spark.createDataFrame([(1, 1, 60, True)], "doc_id long, seg_no int, tier int, counted boolean")
    scores = scoring.score(docs, segs, found)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    assert [tuple(r) for r in scores.select("doc_id", "segments", "violations", "score").orderBy("doc_id").collect()] == [(None, 1, 1, 0.0), (1, 1, 1, 0.0)]
    assert [tuple(r) for r in scoring.score(docs.limit(0), segs.limit(0), found.limit(0)).select("doc_id", "segments", "score").collect()] == [(None, 0, 100.0)]
