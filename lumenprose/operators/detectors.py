"""Detectors: each takes segments and gives findings, as DataFrame operations.

A finding row has doc_id, seg_no, rule, tier, conf (high or low), fix, start, end (code points in the segment), source and
det (the detector's place in the registry, which orders findings at the same place). Each detector filters by kind and by
its pattern first, so that matches are taken apart only where there are some.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X

FINDING = ["doc_id", "seg_no", "rule", "tier", "conf", "fix", "start", "end", "source", "det"]
I = "(?Udi)"


def S() -> Column:
    """A segment's masked text."""
    return F.col("masked")


def M() -> Column:
    """A match."""
    return F.col("m")


REGISTRY: list[tuple[str, tuple[str, ...], Callable[[DataFrame], DataFrame]]] = []


def detector(*rules: str):
    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY.append((fn.__name__, rules, fn))
        return fn

    return add


def alternation(*words: str | list[str]) -> str:
    return X.either([w for x in words for w in (x.split() if isinstance(x, str) else x)])


def hits(segs: DataFrame, rx: str, kinds: list[str] | None = None, groups: int = 0) -> DataFrame:
    """One row for each match of ``rx`` in segments of these kinds: the segment and the match ``m``."""
    rows = segs.filter(S().rlike(rx))
    if kinds:
        rows = rows.filter(F.col("kind").isin(kinds))
    return rows.select("doc_id", "seg_no", "kind", "idx", "masked", "text", F.explode(X.matches(S(), rx, groups, sure=True)).alias("m"))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are computed once: the planner puts no filter that uses them below them."""
    added = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("settled")
    return rows.select("*", added).select("*", *(F.col(f"settled.{k}") for k in columns)).drop("settled")


def group(k: int) -> Column:
    return F.get(M()["g"], F.lit(k - 1))


def found(rows: DataFrame, rule: str | Column, start: Column | None = None, end: Column | None = None, conf: str | Column = "high", fix: str | Column = "", tier: int | Column | None = None, source: str | Column = "rules") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if tier is None and isinstance(rule, str):
        tier = L.TIER[rule] or 100
    return rows.select("doc_id", "seg_no", lit(rule).alias("rule"), lit(tier).cast("int").alias("tier"), lit(conf).alias("conf"), lit(fix).alias("fix"), (M()["start"] if start is None else start).cast("int").alias("start"), (M()["end"] if end is None else end).cast("int").alias("end"), lit(source).alias("source"))


def lookup(key: Column, of: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), key)


def whole() -> tuple[Column, Column]:
    return F.lit(0), F.length("text")


@detector("5.1", "6.3")
def sentence_length(segs: DataFrame) -> DataFrame:
    safety = F.col("kind").isin("warning", "caution")
    long_ = (F.col("kind") == "desc") | safety & ~X.is_imperative(S())
    rows = segs.filter(F.col("kind").isin(L.SENTENCES) & (F.col("words") > 20)).withColumn("long", long_)
    rows = rows.filter((F.col("words") > 25) | ~F.col("long") & (F.col("kind") != "note"))
    return found(rows, F.when(F.col("long"), "6.3").otherwise("5.1"), *whole(), tier=60, fix="shorter sentences or a list")


@detector("6.6")
def paragraph_length(segs: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("idx"))
    return found(segs.filter("kind = 'desc'").withColumn("nth", nth).filter("nth = 7"), "6.6", *whole(), fix="shorter paragraphs")


@detector("8.1")
def semicolons(segs: DataFrame) -> DataFrame:
    return found(hits(segs, ";"), "8.1", fix="two sentences")


@detector("4.2")
def contractions(segs: DataFrame) -> DataFrame:
    rx = I + r"\b(\w+)(n't|'re|'ve|'ll|'d|'m)\b|\b(it|that|there|here|what|who|let|he|she|where|how)('s)\b"
    rows = hits(segs, rx, groups=4)
    base, end = F.lower(F.concat(group(1), group(3))), F.lower(F.concat(group(2), group(4)))
    whole = lookup(base, {"can": "cannot", "ca": "cannot", "wo": "will not", "sha": "shall not"})
    ends = lookup(end, {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would (or had)", "'m": " am", "'s": " is (or has)"})
    fix = F.when((end == "n't") & whole.isNotNull(), whole).when((base == "let") & (end == "'s"), "let us").otherwise(F.concat(base, ends))
    return found(rows, "4.2", fix=X.keep_case(M()["text"], fix))


@detector("GR-6")
def latin(segs: DataFrame) -> DataFrame:
    rows = hits(segs, I + r"(?<![\w.])(?:e\.\s?g\b\.?|i\.\s?e\b\.?|etc\b\.?|viz\.|cf\.|et\s+al\b\.?|vs\b\.?)")
    key = F.regexp_replace(F.lower(M()["text"]), r"(?U)[\s.]", "")
    return found(rows, "GR-6", fix=lookup(key, {"eg": "for example", "ie": "that is", "etc": "and other items", "viz": "that is", "cf": "refer to", "etal": "and others", "vs": "compared to"}))


@detector("3.4")
def complex_verbs(segs: DataFrame) -> DataFrame:
    modal = hits(segs, I + rf"\b(?:{alternation(L.MODALS)})\s+(?:not\s+)?have\s+(\w+)", L.SENTENCES, 1).filter(X.is_participle(group(1)))
    been = hits(segs, I + r"\b(?:has|have|had|having)\s+been\b", L.SENTENCES).filter(~X.prev_word(S(), M()["start"]).isin(L.MODALS))
    being = hits(segs, I + r"\b(?:am|is|are|was|were|be)\s+being\b", L.SENTENCES)
    going = hits(segs, I + r"\b(?:am|is|are|was|were)\s+going\s+to\b", L.SENTENCES)
    used = hits(segs, I + r"\bused\s+to\s+(\w+)", L.SENTENCES, 1).withColumn("prev", X.prev_word(S(), M()["start"]))
    used = used.filter(~F.col("prev").isin([*L.BE, "been", "being", "get", "gets", "got"]) & ~F.lower(group(1)).isin("it", "this", "that", "the"))
    plain = [found(modal, "3.4"), found(been, "3.4"), found(being, "3.4"), found(going, "3.4", fix="WILL")]
    return reduce(DataFrame.union, [*plain, found(used, "3.4", end=M()["end"] - F.length(group(1)) - 1, conf=F.when(F.col("prev").isin(L.SUBJECT_PRONOUNS), "high").otherwise("low"))])


@detector("3.2")
def tenses(segs: DataFrame) -> DataFrame:
    perfect = hits(segs, I + r"\b(has|have|had)\s+(?:(?:not|never|already|just|also|always|recently|now|since)\s+)?([A-Za-z]+)\b", L.SENTENCES, 2)
    perfect = perfect.filter((F.lower(group(2)) != "been") & X.is_participle(group(2)) & ~X.prev_word(S(), M()["start"]).isin(L.MODALS))
    after = X.next_word(S(), M()["end"])
    clear = (after == "") | after.isin(sorted({*L.DETERMINERS, *L.PREPOSITIONS}))
    going = hits(segs, I + r"\b(am|is|are|was|were|be)\s+(?:(?:not|still|currently|now|also|always|already|constantly|actively)\s+)?([A-Za-z]+)\b", L.SENTENCES, 2)
    word = F.lower(group(2))
    going = going.filter(X.is_ing(word) & ~word.isin([*L.ING_ADJECTIVES, "being"]) & ~((word == "going") & (X.next_word(S(), M()["end"]) == "to")))
    return found(perfect, "3.2", conf=F.when(clear, "high").otherwise("low")).union(found(going, "3.2"))


@detector("GR-1")
def make_sure(segs: DataFrame) -> DataFrame:
    rows = hits(segs, I + r"\b(?:make|makes|made|making)\s+sure\b(?=\s+\w)(?!\s+(?:that|of)\b)")
    return found(rows, "GR-1", fix=X.keep_case(M()["text"], F.concat(F.lower(M()["text"]), F.lit(" that"))))


@detector("1.14")
def spelling(segs: DataFrame) -> DataFrame:
    known = L.spellings()
    # words of ASCII letters, also where case is ignored: no letter beyond ASCII stands for one of them
    rows = hits(segs, rf"(?Ud)(?<![\w'\-])(?i-Uu:{alternation(list(known))})(?![\w'\-])").withColumn("british", F.lower(M()["text"]))
    table = segs.sparkSession.createDataFrame(list(known.items()), "british string, american string")
    # the table has a fixed number of rows
    rows = rows.join(F.broadcast(table), "british")
    return found(rows, "1.14", fix=X.keep_case(M()["text"], F.col("american")))


@detector("1.3")
def meanings(segs: DataFrame) -> DataFrame:
    about = hits(segs, I + rf"\babout(?=\s+(?:\d|(?:a\s+|an\s+)?(?:{alternation(L.NUMBER_WORDS)})\b))")
    nouns = "instructions?|procedures?|steps?|rules?|guidelines?|guide|advice|directions?|recommendations?|regulations?|precautions?|polic(?:y|ies)|prompts?"
    follow = hits(segs, I + rf"\b(follow(?:s|ed)?)\s+(?:(?:the|these|all|this|those|our|my|your|its|their|any)\s+)?(?:\w+\s+)?(?:{nouns})\b", groups=1)
    return found(about, "1.3", tier=80, fix=X.keep_case(M()["text"], F.lit("approximately"))).union(found(follow, "1.3", tier=80, end=M()["start"] + F.length(group(1)), fix=X.keep_case(group(1), F.lit("obey"))))


@detector("GR-7")
def inclusive(segs: DataFrame) -> DataFrame:
    roles = "users?|operators?|developers?|engineers?|technicians?|persons?|customers?|readers?|administrators?|admins?|someone|anyone|everyone|each|every|pilots?|mechanics?|drivers?|students?|workers?|employees?|clients?|owners?|authors?|writers?|programmers?|members?|visitors?|callers?|reviewers?"
    pronouns = hits(segs, I + r"\b(?:he/she|she/he|s/he|his/her|him/her|himself|herself|he|she|him|his|hers|her)\b")
    nouns = hits(segs, I + r"\b(?:man|woman|men|women|manpower|workman|workmen)\b")
    return found(pronouns, "GR-7", conf=F.when(S().rlike(I + rf"\b(?:{roles})\b"), "high").otherwise("low")).union(found(nouns, "GR-7", conf="low", fix="person, personnel"))


OBJECTS = "it them this that these those everything".split()


def word_rows(more: list[str] | None = None) -> list[dict]:
    """The substitution table, longer phrases first."""
    out = []
    for line in [*L.WORDS, *(more or [])]:
        word, pos, use, rest = (x.strip() for x in line.split("|"))
        rule, tier, ctx, conf = rest.split()
        if rule not in L.TIER or tier not in ("60", "80", "100") or ctx not in ("any", "v") or conf not in ("high", "low") or not word or not use:
            raise ValueError(f"bad substitution: {line!r}")
        out.append({"word": word.lower(), "pos": pos, "use": use, "rule": rule, "tier": int(tier), "ctx": ctx, "conf": conf, "source": "house" if rule == "HS" else "rules"})
    return sorted(out, key=lambda r: (-len(r["word"].split()), -len(r["word"])))


def _phrases(row: dict) -> list[str]:
    first, *rest = row["word"].split()
    middle = ["", *OBJECTS] if row["rule"] == "9.3" and rest else [""]
    return [" ".join(x for x in (form, obj, *rest) if x) for form in L.forms(first, row["pos"]) for obj in middle]


def substitutions(segs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Words and phrases that are not approved. A match that is dropped below still uses up its text."""
    out = []
    for source in ("rules", "house"):
        rows = [r for r in word_rows(more) if r["source"] == source]
        if not rows:
            continue
        table: dict[str, dict] = {}
        for r in rows:
            for p in _phrases(r):
                table.setdefault(p, r)
        pattern = X.tree([list(p) for p in table], lambda c: r"\s+" if c == " " else c)
        known = segs.sparkSession.createDataFrame([(p, r["use"], r["rule"], r["tier"], r["ctx"], r["conf"]) for p, r in table.items()], "phrase string, use string, w_rule string, w_tier int, ctx string, w_conf string")
        got = hits(segs, I + rf"(?<![\w'\-])(?:{pattern})(?![\w'\-])").withColumn("phrase", F.regexp_replace(F.lower(M()["text"]), r"(?U)\s+", " ")).join(F.broadcast(known), "phrase")
        first = X.first_token(S())
        name = (F.col("kind") != "title") & (M()["start"] > first) & X.starts_upper(M()["text"]) & ~F.regexp_extract(M()["text"], r"^\S+", 0).rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
        prev = X.prev_word(S(), M()["start"])
        verb = (M()["start"] == first) | prev.isin(L.VERB_CONTEXT) | (F.col("kind") == "proc") & prev.isin("and", "then", "or")
        got = got.filter((F.col("phrase") != "remaining") & ~name & ((F.col("ctx") != "v") | verb))
        out.append(found(got, F.col("w_rule"), fix=F.col("use"), conf=F.col("w_conf"), tier=F.col("w_tier"), source=source))
    return reduce(DataFrame.union, out)


detector("1.1", "1.2", "1.3", "9.3", "HS")(substitutions)


def words_at(segs: DataFrame, rx: str, kinds: list[str], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each token, of segments that match ``rx``, that passes ``keep`` (of its lower case; all without it): the segment, all tokens ``toks``, the place ``i`` and the token ``m``."""
    rows = segs.filter(F.col("kind").isin(kinds) & S().rlike(rx)).select("doc_id", "seg_no", "kind", "idx", "masked", "text", X.tokens(S()).alias("toks"))
    places = F.transform("toks", lambda t, i: F.struct(i.alias("i"), t.alias("m")))
    if keep:
        places = F.filter(places, lambda x: keep(F.lower(x["m"]["text"])))
    return rows.select("*", F.explode(places).alias("x")).select("*", "x.i", "x.m").drop("x")


def nth(i: Column) -> Column:
    return F.lower(F.coalesce(F.get("toks", i)["text"], F.lit("")))


@detector("3.5")
def ing_forms(segs: DataFrame) -> DataFrame:
    rows = words_at(segs, r"(?i)\wing", L.SENTENCES, X.is_ing)
    word, prev, after = F.lower(M()["text"]), F.when(F.col("i") > 0, nth(F.col("i") - 1)).otherwise(""), nth(F.col("i") + 1)
    gap = F.substring(S(), F.get("toks", F.col("i") - 1)["end"] + 1, M()["start"] - F.get("toks", F.col("i") - 1)["end"])
    comma = (F.col("i") > 0) & (F.trim(gap) == ",")
    conf = F.when(prev.isin(L.ING_STRONG), "high").when(prev.isin(L.ING_WEAK), F.when(after.isin(L.DETERMINERS), "high").otherwise("low")).when((F.col("i") == 0) | comma, "low")
    rows = rows.filter(X.is_ing(word) & ~word.isin([*L.ING_ADJECTIVES, *L.ING_PREPOSITIONS, "being"]) & ~prev.isin([*L.BE, "been", "being"])).withColumn("conf", conf).filter("conf is not null")
    return found(rows, "3.5", conf=F.col("conf"))


@detector("3.6")
def passive(segs: DataFrame) -> DataFrame:
    adverbs = "not|also|then|still|always|usually|automatically|now|only|never|often|immediately|first|already|fully|correctly|easily|quickly"
    rows = hits(segs, I + rf"\b(am|is|are|was|were|be|been|being)\s+(?:(?:{adverbs})\s+)?([A-Za-z]+)\b", L.SENTENCES, 2)
    word = F.lower(group(2))
    rows = rows.filter((word != "been") & X.is_participle(word))
    before = F.filter(F.slice(F.reverse(F.regexp_extract_all(F.lower(F.substring(S(), F.lit(1), M()["start"])), F.lit(X.TOKEN), F.lit(0))), 1, 3), lambda w: w != "not")
    last, second = F.coalesce(F.get(before, F.lit(0)), F.lit("")), F.coalesce(F.get(before, F.lit(1)), F.lit(""))
    must = (F.lower(group(1)) == "be") & (last.isin("must", "should", "shall") | (last == "to") & second.isin("is", "are", "has", "have", "needs", "need"))
    agent = F.substring(S(), M()["end"] + 1, F.length(S())).rlike(r"(?Ud)^(?:\s+[\w'\-]+){0,3}?\s+[Bb]y\s+(?i:the|a|an|this|that|these|those|its|their|your|our|you|us|them|users?|operators?|people)\b")
    conf = F.when(agent | must, "high").when(word.isin(L.STATES) | ~F.col("kind").isin("proc", "warning", "caution"), None).otherwise("low")
    return found(rows.withColumn("conf", conf).filter("conf is not null"), "3.6", conf=F.col("conf"))


@detector("3.7")
def nominals(segs: DataFrame) -> DataFrame:
    light = r"perform(?:s|ed|ing)?|carr(?:y|ies|ied|ying)\s+out|conduct(?:s|ed|ing)?|mak(?:e|es|ing)|made|do|does|did|doing|giv(?:e|es|ing)|gave|tak(?:e|es|ing)|took"
    noun = r"\w+(?:tion|sion|ment|ance|ence|ysis)|removal|approval|disposal|refusal|renewal|retrieval|arrival|failure|closure|exposure|review"
    rows = hits(segs, I + rf"\b(?:{light})\s+(?:(?:a|an|the|another|one|some|any|this|that)\s+)?({noun})\s+(?:of|on|to|for|with)\b", L.SENTENCES, 1)
    return found(rows.filter(~F.lower(group(1)).isin(L.NOT_NOMINAL)), "3.7", conf="low")


@detector("9.3")
def phrasal(segs: DataFrame) -> DataFrame:
    rows = hits(segs, I + r"\b([A-Za-z]+)(?=(\s+(?:up|out|off|down|away|back))\b(?!\s+(?:to|from)\b))", L.SENTENCES, 2)
    w = F.lower(group(1))
    cut = lambda n, end="": F.concat(F.substring(w, F.lit(1), F.greatest(F.lit(0), F.length(w) - n)), F.lit(end))
    bases = F.when(w.endswith("ing"), F.array(w, cut(3), cut(3, "e"), cut(4))).when(w.endswith("ied") | w.endswith("ies"), F.array(w, cut(3, "y"))).when(w.endswith("ed"), F.array(w, cut(2), cut(1), cut(3))).when(w.endswith("s"), F.array(w, cut(1), cut(2))).otherwise(F.array(w))
    return found(rows.filter(F.exists(bases, lambda b: b.isin(L.PHRASAL_VERBS))), "9.3", end=M()["end"] + F.length(group(2)), conf="low")


@detector("2.1")
def noun_clusters(segs: DataFrame) -> DataFrame:
    rows = segs.filter(F.col("kind").isin(L.SENTENCES) & S().rlike(r"(?U)(?:[^\s,;:]+\s+){3}")).select("doc_id", "seg_no", "masked")
    rows = settled(rows, toks=X.tokens(S()))

    def flags(t: Column, i: Column) -> Column:
        """What the fold needs of a token and the one before it."""
        before = F.get("toks", i - 1)
        gap = F.substring(S(), before["end"] + 1, t["start"] - before["end"])
        return X.let(F.struct(F.lower(t["text"]).alias("w"), F.when(i > 0, F.lower(before["text"])).otherwise("").alias("p")), lambda x: F.struct(
            (~(x["w"].isin(L.FUNCTION_WORDS) | X.is_adverb(x["w"]) | X.is_placeholder(x["w"]) | x["w"].rlike(r"\p{Nd}"))).alias("plain"),
            ((i > 0) & gap.rlike(r"(?U)^\s+$")).alias("joined"),
            (x["w"].endswith("ed") & X.is_participle(x["w"]) | x["w"].isin(L.VERB_S)).alias("after"),
            (x["w"].isin(L.VERB_S) & x["p"].isin(L.CLUSTER_SUBJECTS)).alias("first"),
            x["w"].isin(L.VERBS).alias("verb"),
            x["p"].isin([*L.VERB_CONTEXT, "and", "then", "or"]).alias("context"),
        ))

    rows = settled(rows, flags=F.transform("toks", flags))
    # a run needs four tokens one after another that may belong: only such segments are folded
    rows = rows.filter(F.array_join(F.transform("flags", lambda f: F.when(f["plain"], "1").otherwise("0")), "").contains("1111"))
    run = "array<struct<last:int,n:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(run).alias("done"))

    def step(s: Column, f: Column) -> Column:
        """``n``: length of the run that ends before place ``at``; ``done``: runs of four and more."""
        kept = F.when(f["joined"], s["n"]).otherwise(0)
        inside = f["plain"] & F.when(kept > 0, ~f["after"]).otherwise(~f["first"] & ~(f["verb"] & (~f["joined"] | f["context"])))
        ends = (s["n"] >= 4) & ~(f["joined"] & inside)
        done = F.when(ends, F.concat(s["done"], F.array(F.struct((s["at"] - 1).alias("last"), s["n"].alias("n"))))).otherwise(s["done"])
        return F.struct((s["at"] + 1).alias("at"), F.when(inside, kept + 1).otherwise(0).alias("n"), done.alias("done"))

    runs = F.aggregate("flags", zero, step, lambda s: F.when(s["n"] >= 4, F.concat(s["done"], F.array(F.struct((s["at"] - 1).alias("last"), s["n"].alias("n"))))).otherwise(s["done"]))
    rows = rows.select("doc_id", "seg_no", "toks", F.explode(runs).alias("run"))
    item = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), X.starts_upper(t["text"]).alias("up"))
    rows = settled(rows, r=F.transform(F.slice("toks", F.col("run.last") - F.col("run.n") + 2, F.col("run.n")), item))
    pairs = F.size(F.filter(F.sequence(F.lit(0), F.size("r") - 2), lambda k: F.get("r", k)["up"] & F.get("r", k + 1)["up"]))
    rows = rows.filter((F.size("r") - pairs >= 4) & F.exists("r", lambda x: ~x["up"]))
    return found(rows, "2.1", F.get("r", F.lit(0))["start"], F.element_at("r", -1)["end"], conf="low")


@detector("5.2")
def two_instructions(segs: DataFrame) -> DataFrame:
    rows = words_at(segs, I + r"\b(?:and|then)\b", ["proc"], lambda w: w.isin("and", "then"))
    word, prev = F.lower(M()["text"]), nth(F.col("i") - 1)
    rows = rows.filter((F.col("i") > 0) & word.isin("and", "then") & ~((word == "then") & (prev == "and"))).withColumn("prev", prev)
    rest = F.slice("toks", F.col("i") + 2, F.size("toks"))
    skipped = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, t: F.struct((s["n"] + (s["go"] & F.lower(t["text"]).isin(L.STEP_ADVERBS)).cast("int")).alias("n"), (s["go"] & F.lower(t["text"]).isin(L.STEP_ADVERBS)).alias("go")), lambda s: s["n"])
    rows = rows.withColumn("j", F.col("i") + 1 + skipped)
    rows = rows.withColumn("j", F.when((nth(F.col("j")) == "do") & (nth(F.col("j") + 1) == "not"), F.col("j") + 2).otherwise(F.col("j"))).withColumn("verb", nth(F.col("j")))
    rows = rows.filter(F.col("verb").isin(L.VERBS) & ~((F.col("verb") == "hold") & F.col("prev").isin("press", "push", "click", "tap")))
    return found(rows, "5.2", end=F.get("toks", F.col("j"))["end"], conf="low")


@detector("5.3")
def imperative(segs: DataFrame) -> DataFrame:
    rx = I + r"\b(?:you|users?|the\s+user|operators?|the\s+operator)\s+(?:must|should|need\s+to|needs\s+to|have\s+to|has\s+to|will\s+need\s+to|are\s+required\s+to|is\s+required\s+to)\b"
    rest = F.substring(S(), X.clause_start(S()) + 1, F.length(S()))
    first = F.regexp_extract(rest, X.TOKEN, 0)
    starts = segs.filter((F.col("kind") == "proc") & (F.col("idx") == 0) & ~S().rlike(rx) & ~X.is_imperative(S()) & (F.lower(first).isin(L.NOT_VERB_START) | X.is_ing(first))).withColumn("at", X.first_token(S())).withColumn("size", F.length(first))
    return found(hits(segs, rx, ["proc", "desc"]), "5.3", conf="low").union(found(starts, "5.3", F.col("at"), F.col("at") + F.col("size"), conf="low"))


@detector("5.4")
def condition_first(segs: DataFrame) -> DataFrame:
    rows = hits(segs.filter(X.is_imperative(S())), I + r"\s(if|when|unless|whenever|in\s+case|provided|as\s+soon\s+as)\b", ["proc"], 1)
    rows = rows.filter((M()["start"] >= X.clause_start(S())) & ~X.prev_word(S(), M()["start"]).isin(L.ASK_VERBS))
    first = rows.groupBy("doc_id", "seg_no").agg(F.min("m").alias("m"))
    return found(first, "5.4", M()["start"] + 1, conf="low")


@detector("5.5")
def note_instruction(segs: DataFrame) -> DataFrame:
    return found(segs.filter((F.col("kind") == "note") & X.is_imperative(S())), "5.5", X.first_token(S()), F.length("text"), conf="low")


@detector("7.2")
def safety_start(segs: DataFrame) -> DataFrame:
    rows = segs.filter(F.col("kind").isin("warning", "caution") & (F.col("idx") == 0) & ~X.is_imperative(S())).withColumn("at", X.first_token(S())).filter("at >= 0")
    first = F.regexp_extract(F.substring(S(), F.col("at") + 1, F.length(S())), X.TOKEN, 0)
    condition = X.clause_start(S()) > F.length(F.regexp_extract(S(), r"(?U)^\s*", 0))
    return found(rows, "7.2", F.col("at"), F.col("at") + F.length(first), conf=F.when(~condition & F.lower(first).isin(L.STATEMENT_START), "high").otherwise("low"))


@detector("7.3")
def safety_reason(segs: DataFrame) -> DataFrame:
    risk = I + r"\b(?:because|can|could|will|risk|danger|injur\w*|damage\w*|kill\w*|hot|toxic|flammable|explosive|sharp|poison\w*|pressuri[sz]ed|burn\w*|shock\w*)\b"
    alone = F.count("*").over(Window.partitionBy("doc_id", "block"))
    return found(segs.filter(F.col("kind").isin("warning", "caution")).withColumn("n", alone).filter((F.col("n") == 1) & ~S().rlike(risk)), "7.3", *whole(), conf="low")


@detector("7.1")
def signal_word(segs: DataFrame) -> DataFrame:
    rx = I + r"\b(?:injur(?:y|ies|e|ed)|kills?|killed|death|fatal|die|burns?|skin|eyes?|electric\s+shock|hurt|cuts?\s+(?:you|your))\b"
    first = hits(segs, rx, ["caution"]).groupBy("doc_id", "seg_no").agg(F.min("m").alias("m"))
    return found(first, "7.1", conf="low", fix="WARNING")


@detector("4.5")
def articles(segs: DataFrame) -> DataFrame:
    # the clause starts with step prefixes and a verb, then one more word; the tokens of its beginning are enough
    prefix = rf"(?:(?:{alternation(L.STEP_PREFIX)}|do\W+not)\W+)*"
    verbs = alternation(L.VERBS)
    start = X.clause_start(S())
    rows = segs.filter((F.col("kind") == "proc") & F.substring(S(), start + 1, F.length(S())).rlike(I + rf"^\W*{prefix}(?:{verbs})(?![\w])"))
    rows = settled(rows.select("doc_id", "seg_no", "masked"), toks=X.let(start, lambda c: F.filter(X.tokens(S()), lambda t: t["start"] >= c)))

    # how many leading tokens are step prefixes or "do not"
    words = F.transform("toks", lambda t: F.lower(t["text"]))
    text = F.array_join(words, " ")
    lead = F.regexp_extract(F.concat(text, F.lit(" ")), rf"^(?:(?:{alternation(L.STEP_PREFIX)}|do not) )*", 0)
    rows = settled(rows, i=F.size(F.split(lead, " ")) - 1)
    verb, noun, after = F.get("toks", F.col("i")), F.get("toks", F.col("i") + 1), F.coalesce(F.get("toks", F.col("i") + 2)["text"], F.lit(""))
    rows = settled(rows, v=verb, m=noun, after=after).filter("m is not null").filter(F.lower(F.col("v.text")).isin(L.VERBS))
    w, lw = M()["text"], F.lower(M()["text"])
    gap = F.substring(S(), F.col("v.end") + 1, M()["start"] - F.col("v.end"))
    bad = ~gap.rlike(r"(?U)^\s+$") | X.starts_upper(w) | lw.isin([*L.FUNCTION_WORDS, *L.BARE_OK, *L.VERBS]) | X.is_adverb(lw) | X.is_placeholder(w) | w.rlike(r"\p{Nd}") | X.is_ing(w) | lw.endswith("s") & ~lw.endswith("ss")
    label = F.col("after").rlike(r"^\p{Nd}|^\p{Lu}$")
    return found(rows.filter(~bad & ~label), "4.5", conf="low", fix=F.concat(F.lit("the "), w))


@detector("GR-4")
def this_alone(segs: DataFrame) -> DataFrame:
    rows = hits(segs, I + r"\b(this)\s+(?:is|was|can|could|will|would|causes?|caused|means|makes|lets|gives|shows|helps|occurs|prevents|results|happens|does|has|also)\b", L.SENTENCES, 1)
    return found(rows, "GR-4", end=M()["start"] + 4, conf="low")


def detect(segs: DataFrame, names: list[str] | None = None, more_words: list[str] | None = None) -> DataFrame:
    """Findings of all (or the named) detectors. ``segs`` should be stored or persisted: each detector scans it."""
    out = []
    for k, (name, _, fn) in enumerate(REGISTRY):
        if names is None or name in names:
            rows = fn(segs, more_words) if fn is substitutions else fn(segs)
            out.append(rows.withColumn("det", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select(*FINDING)
