"""Detectors on own sentences, shields, overlaps, scores, dictionary, review, settings."""

import pytest
from pyspark.sql import functions as F

from lumenprose.operators import detectors, dictionary, findings, review, scoring, settings, views
from lumenprose.operators.segments import segments
from lumenprose.plans import templates


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(n, s.replace("{k}", "7")) for n, _, s, _ in templates.cases()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    segs = segments(docs).persist()
    return docs, segs, detectors.detect(segs).persist()


def test_every_sentence_gives_its_findings(checked):
    docs, segs, found = checked
    names = [r[0] for r in detectors.REGISTRY]
    got = {}
    for r in found.join(segs.select("doc_id", "seg_no", "text"), ["doc_id", "seg_no"]).collect():
        got.setdefault((r.doc_id, names[r.det]), []).append((r.rule, r.conf, r.text[r.start : r.end]))
    for n, name, sentence, wanted in templates.cases():
        body = sentence.replace("{k}", "7")
        for p in ("NOTE: ", "WARNING: ", "CAUTION: "):
            body = body.removeprefix(p)
        want = sorted((rule, conf, body if q == "*" else q.replace("{k}", "7")) for rule, conf, q, _ in wanted)
        assert sorted(got.get((n, name), [])) == want, sentence


def test_precision_and_recall_gate(checked):
    """The gates of a labelled corpus: high confidence 0.95, low 0.6, recall 0.8, by the detector that a sentence is for."""
    _, _, found = checked
    names = [r[0] for r in detectors.REGISTRY]
    got = {(r.doc_id, names[r.det], r.rule, r.conf) for r in found.collect()}
    of = {n: d for n, d, _, _ in templates.cases()}
    got = {g for g in got if of[g[0]] == g[1]}
    want = {(n, d, rule, conf) for n, d, _, f in templates.cases() for rule, conf, _, _ in f}
    for conf, gate in (("high", 0.95), ("low", 0.6)):
        these = {g for g in got if g[3] == conf}
        assert len(these & want) / len(these) >= gate
    assert len(got & want) / len(want) >= 0.8


def finished(spark, text, allow=None):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    segs = segments(docs).persist()
    return docs, segs, findings.finish(detectors.detect(segs, ["substitutions", "inclusive", "semicolons"]), segs, allow)


def test_quotes_and_allowed_terms_shield(spark):
    _, _, f = finished(spark, "Read \"they utilize it\" here. Utilize it.")
    assert [(r.rule, r.quote, r.id) for r in f.collect()] == [("1.1", "Utilize", "F1")]
    _, _, f = finished(spark, "Utilize it; verify the seal.", ["verify"])
    assert sorted(r.quote for r in f.collect()) == [";", "Utilize"]


def test_dropped_overlaps_do_not_extend(spark):
    rows = [(1, 1, "x", 60, "high", "", 0, 5, "rules", 0), (1, 1, "x", 60, "high", "", 3, 9, "rules", 0), (1, 1, "x", 60, "high", "", 6, 8, "rules", 0)]
    f = spark.createDataFrame(rows, "doc_id long, seg_no int, rule string, tier int, conf string, fix string, start int, end int, source string, det int")
    assert sorted((r.start, r.end) for r in findings.suppress(f).collect()) == [(0, 5), (6, 8)]


def test_scores(spark):
    docs = spark.createDataFrame([(1, "Utilize it. Read the note."), (2, None), (3, "Read it.")], "doc_id long, text string")
    segs = segments(docs).persist()
    f = findings.finish(detectors.detect(segs, ["substitutions"]), segs)
    rows = {r.doc_id: r for r in scoring.score(docs, segs, f).collect()}
    assert rows[1].score == 50.0 and rows[1].violations == 1 and not rows[1].passed
    assert rows[2].score == 100.0 and rows[2].no_text and rows[3].score == 100.0
    assert rows[None].segments == 3 and rows[None].score == pytest.approx(66.6)


def test_review(spark):
    _, segs, f = finished(spark, "Utilize it; verify the seal.")
    decisions = spark.createDataFrame([(1, "F1", "confirmed", ""), (1, "F1", "rejected", "no"), (1, "F9", "rejected", "")], "doc_id long, id string, status string, note string")
    decided, unknown = review.decide(f, decisions)
    assert {r.id: r.status for r in decided.collect()}["F1"] == "rejected" and [r.id for r in unknown.collect()] == ["F9"]
    items = spark.createDataFrame([(1, 1, "1.5", "1", "VERIFY  the", "", ""), (1, 2, "8.4", "1", "x", "", ""), (1, 3, "1.6", "9", "absent", "", "")], "doc_id long, n int, rule string, line string, quote string, fix string, note string")
    got = {r.id: (r.rule, r.start, r.end, r.counted) for r in review.added(items, segs).collect()}
    assert got == {"R1": ("1.5", 12, 22, True), "R2": ("1.6", None, None, False)}
    left = review.recheck(spark.createDataFrame([(1, 1, "Utilize it."), (1, 2, "Use it.")], "doc_id long, n int, rewrite string")).collect()
    assert sorted((r.n, r.left) for r in left) == [(1, "1.1: Utilize"), (2, "")]
    parsed = spark.createDataFrame([('{"confirm": ["F1", "F2"], "reject": [{"id": "F3", "reason": "r"}]}',)], "j string").select(review.read(F.col("j")).alias("r")).first().r
    assert [x.id for x in parsed.confirm] == ["F1", "F2"] and parsed.reject[0].reason == "r"


def test_dictionary(spark):
    rows = spark.createDataFrame([(1, 1, "Words (intro)", ""), (1, 2, "STOP (v),", ""), (1, 3, "STOPS, STOPPED", ""), (1, 4, "commence", ""), (1, 5, "(v)", "START (v), BEGIN NOW (v)")], "page int, row_no int, c1 string, c2 string")
    entries = dictionary.parse_rows(rows).orderBy("entry").collect()
    assert [(e.word, e.pos, e.approved, e.forms, e.alts) for e in entries] == [("STOP", "v", True, ["STOPS", "STOPPED"], []), ("commence", "v", False, [], ["START (v)", "BEGIN NOW (v)"])]
    table = dictionary.lookup(dictionary.parse_rows(rows))
    segs = segments(spark.createDataFrame([(1, "Commence work. They stop. A stopper stops.")], "doc_id long, text string"))
    got = sorted((r.rule, r.conf, r.fix, r.start) for r in dictionary.dictionary_findings(segs, table).collect())
    assert ("1.1", "high", "START (v) or BEGIN NOW (v)", 0) in got and sum(g[1] == "low" for g in got) >= 2


def test_views_and_settings(spark):
    docs, segs, f = finished(spark, "Utilize it; verify the seal. Utilize it.")
    assert [(r.rule, r.counted) for r in views.by_rule(f).collect()] == [("1.1", 3), ("8.1", 1)]
    assert [(r.word, r.n) for r in views.by_word(f).collect()] == [("utilize", 2), ("verify", 1)]
    assert views.worst_sentences(segs, f).first().seg_no == 1
    chunks = [r.chunk for r in views.annotated(segs, f).filter("seg_no = 1").orderBy("start").collect()]
    assert "".join(chunks) == "Utilize it; verify the seal."
    got = settings.effective({"level": "strict", "allow": ["Pump"]}, {"allow": ["pump", "seal"], "odd": 1})
    assert got["level"] == 100 and got["allow"] == ["pump", "seal"] and got["warnings"]
    with pytest.raises(ValueError):
        scoring.parse_level(True)


def test_substitution_table_is_whole(spark):
    rows = detectors.word_rows()
    assert (len(rows), len({r["word"] for r in rows})) == (216, 216)
    assert sum(" " in r["word"] for r in rows) == 44 and sum(r["source"] == "house" for r in rows) == 9
    # words that table had not: low confidence, an object inside of a phrasal verb, a house phrase
    _, _, f = finished(spark, "Furthermore, numerous seals actually affect it. Switch it off. Tools like this leak. It should be noted that lamps burn.")
    assert [(r.rule, r.conf, r.source, r.quote) for r in f.orderBy("seg_no", "start").collect()] == [("1.1", "high", "rules", "Furthermore"), ("1.1", "high", "rules", "numerous"), ("1.1", "high", "rules", "actually"), ("1.1", "high", "rules", "affect"), ("9.3", "high", "rules", "Switch it off"), ("1.1", "low", "rules", "like"), ("HS", "high", "house", "It should be noted that"), ("1.1", "high", "rules", "should")]
