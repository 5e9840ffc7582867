"""Operator 10: toxicity by a weighted finite-state pattern grammar over clauses.

A text is a tape of classes: INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END (of a clause), BREAK (of a line), OTHER.
The lexical layer gives each word its class; insult terminals (whole words and word beginnings) and their weights are
learned from the labels, the function words are fixed; a threat word weighs as much as the learned terminals do on average.
Then finite-state transducers read the tape:

* ``following`` (right to left): an INSULT or THREAT that a TARGET follows within four words is marked;
* ``target``: a marked INSULT, or one within four words after a TARGET, becomes TARGETED, any other PLAIN; a THREAT stays
  one only there;
* ``negation``: a match within three words after a NEGATION becomes NEGATED, at half its weight;
* ``report``: a match after a verb of reporting up to the clause's end, or inside double quotes up to the line's end,
  becomes REPORTED, at half its weight.

The three that run left to right are composed once into one machine, whose final acceptor adds each match's weight to its
label's sum. A document's features are these sums, the same for a word of the text, and its best clause; a logistic layer
fitted on the same labels turns them into a score. Its weights of THREAT are drawn to those of TARGETED, and are the same
where the labelled rows hold no threat.

Terminals are learned from rates, not from presence: long clean texts hold any word beginning by chance now and then, and
toxic ones hold theirs many times as often. A word beginning of any length, or a word, is a candidate if its occurrences
(``CAPPED`` in a document count at most) are beyond chance in toxic documents (signed root of the likelihood ratio of at
least ``EVIDENCE``), in two of them at least, at ``RATIO`` times the rate of the others. In the tree of beginnings a
longer one is taken for its share only where it is clearly purer than the shorter one.

Learning reads at most ``SAMPLE`` labelled rows whose crc32(doc_id) mod 5 is not 0, a third of them toxic if there are as
many (the smallest crc32s of that id with a salt), one text for each of these ids (the one of the smallest hash), and each
text once: a documented bound. Scoring reads all rows and whole texts.

Defined cases: null and empty texts, and texts without a match, have the score of the bias alone; each row is judged by its
own whole text, however long, in slices of rows of bounded size; repeated rows are scored alike; no rows give no rows; other
columns are neither read nor changed, whatever their names; labels that are null, or whose id is null, are not used, an id
that is labelled both ways is toxic; without labels of both classes nothing is a match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, id_and_text, map_rows, stored, table, text_slices

#: Labelled rows for learning, at most.
SAMPLE = 12_000
#: A terminal's evidence and rate against clean documents, at least; occurrences that count in one document, at most.
EVIDENCE, RATIO, CAPPED = 5.5, 4.0, 5
#: Lengths of word beginnings.
PREFIXES = range(2, 10)
THRESHOLD = 0.5

# Function words of the grammar (English, German, French, Spanish).
THREAT = "kill hurt punch smash beat destroy töten schlagen vernichten tuer frapper matar golpear".split()
TARGET = "you your he she they them him her this that these those du dich ihr euch sie dein tu toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATION = "not no never nor without isn't aren't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORT = "said says say wrote writes reported claims claimed quoted sagte sagt schrieb meinte dit disait écrit dijo dice escribió".split()

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|\"|\n|[.!?;]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
MATCHES = ("PLAIN", "TARGETED", "NEGATED", "REPORTED", "THREAT")
#: Sums by label, sums by label for a word, the best clause, whether there is a match.
FEATURES = (*MATCHES, *(f"{m}_RATE" for m in MATCHES), "BEST", "ANY")

# transducers

#: The symbols that transducers read and write. INSULT+ and THREAT+ have a target behind them.
SYMBOLS = ("OTHER", "INSULT", "THREAT", "TARGET", "NEGATION", "REPORT", "QUOTE", "END", "BREAK", "INSULT+", "THREAT+", *MATCHES[:4])
#: (state, symbol) -> (next state, symbol written, weight by which a match is multiplied)
Step = Callable[[object, str], tuple[object, str, float]]
_NO_WORD = ("QUOTE", "END", "BREAK")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer as a table over its reachable states; state 0 is the start."""

    table: tuple[tuple[tuple[int, str, float], ...], ...]

    @classmethod
    def of(cls, start: object, step: Step) -> Transducer:
        numbers, todo, rows = {start: 0}, [start], []
        for state in todo:
            row = []
            for symbol in SYMBOLS:
                to, out, weight = step(state, symbol)
                if to not in numbers:
                    numbers[to] = len(todo)
                    todo.append(to)
                row.append((numbers[to], out, weight))
            rows.append(tuple(row))
        return cls(tuple(rows))

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes; weights are multiplied."""

        def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
            a, middle, v = self.table[state[0]][SYMBOLS.index(symbol)]
            b, out, w = other.table[state[1]][SYMBOLS.index(middle)]
            return (a, b), out, v * w

        return Transducer.of((0, 0), step)

    def run(self, tape: list[int]) -> list[tuple[int, str, float]]:
        state, out, rows = 0, [], self.table
        for symbol in tape:
            got = rows[state][symbol]
            state = got[0]
            out.append(got)
        return out


def _since(state: int, symbol: str, zero: str, far: int) -> int:
    """Words since ``zero``, up to ``far``; the end of a clause is far."""
    if symbol == zero:
        return 0
    if symbol in ("END", "BREAK"):
        return far
    return state if symbol in _NO_WORD else min(far, state + 1)


def _following(state: int, symbol: str) -> tuple[int, str, float]:
    now = _since(state, symbol, "TARGET", 5)
    return now, symbol + "+" if symbol in ("INSULT", "THREAT") and now <= 4 else symbol, 1.0


def _target(state: int, symbol: str) -> tuple[int, str, float]:
    now = _since(state, symbol, "TARGET", 5)
    if symbol in ("INSULT", "INSULT+"):
        return now, "TARGETED" if now <= 4 or symbol == "INSULT+" else "PLAIN", 1.0
    if symbol in ("THREAT", "THREAT+"):
        return now, "THREAT" if now <= 4 or symbol == "THREAT+" else "OTHER", 1.0
    return now, symbol, 1.0


def _negation(state: int, symbol: str) -> tuple[int, str, float]:
    now = _since(state, symbol, "NEGATION", 4)
    return (now, "NEGATED", 0.5) if now <= 3 and symbol in ("PLAIN", "TARGETED", "THREAT") else (now, symbol, 1.0)


def _report(state: tuple[bool, bool], symbol: str) -> tuple[tuple[bool, bool], str, float]:
    said, quoted = state
    if symbol == "BREAK":
        return (False, False), symbol, 1.0
    now = (said and symbol != "END" or symbol == "REPORT", quoted != (symbol == "QUOTE"))
    return (now, "REPORTED", 0.5) if any(now) and symbol in ("PLAIN", "TARGETED", "THREAT") else (now, symbol, 1.0)


FOLLOWING = Transducer.of(5, _following)
CONTEXT = Transducer.of(5, _target).then(Transducer.of(4, _negation)).then(Transducer.of((False, False), _report))
_NUMBER = {s: i for i, s in enumerate(SYMBOLS)}
_MATCH_SET = frozenset(MATCHES)


@dataclass
class Grammar:
    """The lexicon (whole words, word beginnings: the longest that fits counts) and the logistic layer."""

    words: dict[str, float]
    stems: dict[str, float]
    bias: float = -4.0
    weights: list[float] = field(default_factory=lambda: [1.0] * len(MATCHES) + [0.0] * len(MATCHES) + [1.0, 0.0])

    def __post_init__(self) -> None:
        self.function = {w: c for c, ws in (("THREAT", THREAT), ("TARGET", TARGET), ("NEGATION", NEGATION), ("REPORT", REPORT)) for w in ws}
        known = [*self.words.values(), *self.stems.values()]
        self.threat = sum(known) / len(known) if known else 1.0
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.cache: dict[str, tuple[int, float]] = {}

    def lexical(self, word: str) -> tuple[int, float]:
        """The class of a word, as a number, and its weight."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= 100_000:
                self.cache.clear()
            weight = self.words.get(word, 0.0)
            if not weight:
                weight = next((self.stems[word[:n]] for n in self.lengths if len(word) >= n and word[:n] in self.stems), 0.0)
            kind = self.function.get(word, "OTHER")
            if word[0] in '".!?;\n':
                kind = "QUOTE" if word == '"' else "BREAK" if word == "\n" else "END"
            got = (_NUMBER["INSULT"], weight) if weight > 0 else (_NUMBER[kind], self.threat if kind == "THREAT" else 1.0)
            self.cache[word] = got
        return got

    def hits(self, tokens: list[str]) -> bool:
        """Whether some clause may match: an insult, or a threat and a target."""
        lexical, cache = self.lexical, self.cache
        kinds = {(cache.get(w) or lexical(w))[0] for w in set(tokens)}
        return _NUMBER["INSULT"] in kinds or (_NUMBER["THREAT"] in kinds and _NUMBER["TARGET"] in kinds)

    def matches(self, tokens: list[str]) -> list[tuple[int, str, float]]:
        """(token, label, weight) of each match: the lexical layer, then the transducers."""
        tape = [self.lexical(w) for w in tokens]
        marked = [_NUMBER[out] for _, out, _ in FOLLOWING.run([c for c, _ in reversed(tape)])]
        return [(i, out, w * tape[i][1]) for i, (_, out, w) in enumerate(CONTEXT.run(marked[::-1])) if out in _MATCH_SET]

    def features(self, text: str) -> list[float] | None:
        """The features over the matched clauses; None without a match."""
        tokens = _TOKEN.findall(text.lower())
        if not self.hits(tokens):
            return None
        found = self.matches(tokens)
        if not found:
            return None
        sums, best, total, at = dict.fromkeys(MATCHES, 0.0), 0.0, 0.0, 0
        words = 0
        ends = [i for i, w in enumerate(tokens) if w[0] in ".!?;\n"]
        words = len(tokens) - len(ends)
        k = 0
        for i, label, weight in found:
            while k < len(ends) and ends[k] < i:
                k += 1
            if k != at:
                total, at = 0.0, k
            sums[label] += weight
            total += weight
            best = max(best, total)
        size = (words + 20.0) / 100.0
        return [*(math.log1p(sums[m]) for m in MATCHES), *(math.log1p(sums[m] / size) for m in MATCHES), math.log1p(best), 1.0]

    def score(self, text: str) -> float:
        f = self.features(text)
        z = self.bias + (sum(w * x for w, x in zip(self.weights, f, strict=True)) if f else 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


# learning


def sample_of(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows for learning (doc_id, y), one for each id, in an order that depends on the id only."""
    order = F.crc32(F.concat(F.lit("order"), F.col("doc_id").cast("string")))
    return _training(labels, label).orderBy(order, "doc_id").limit(most)


def _training(labels: DataFrame, label: str) -> DataFrame:
    kept = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~held_out(F.col("doc_id")))
    return kept.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text): one text for each sampled id, the one of the smallest hash. ``sample`` is broadcast: it has a row bound."""
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id")
    first = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return first.select("doc_id", "y", F.col("t.text").alias("text"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row for each text, so that copies don't count as evidence for their words."""
    best = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max(F.struct("y", "text")).alias("t"))
    return best.select(F.col("t.y").alias("y"), F.col("t.text").alias("text"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """(y, text) -> (term, y, documents, occurrences) summed over a slice; a whole word's term ends with "$"."""
    for batch in text_slices(batches, 1, rows=256, size=2_000_000):
        found: tuple[dict, dict] = ({}, {})
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            here: Counter[str] = Counter()
            for word, n in Counter(_WORD.findall(text.lower())).items():
                here[word + "$"] += n
                for k in PREFIXES:
                    if k > len(word):
                        break
                    here[word[:k]] += n
            into = found[y]
            for term, n in here.items():
                old = into.get(term, (0, 0))
                into[term] = (old[0] + 1, old[1] + min(n, CAPPED))
        for y in (0, 1):
            terms = list(found[y])
            for at in range(0, len(terms), 100_000):
                part = terms[at : at + 100_000]
                yield [part, [y] * len(part), [found[y][t][0] for t in part], [found[y][t][1] for t in part]]


def _evidence(a: float, b: float, share: float) -> float:
    """Signed root of the likelihood ratio of ``a`` occurrences in toxic and ``b`` in other documents; ``share``: expected in toxic ones."""
    n = a + b
    if not n:
        return 0.0
    g = sum(x * math.log(x / e) for x, e in ((a, n * share), (b, n * (1 - share))) if x > 0)
    return math.copysign(math.sqrt(max(0.0, 2 * g)), a - n * share)


def choose(counts: dict[str, tuple[int, int, int]], share: float) -> dict[str, float]:
    """Terminals and weights from term -> (toxic documents, occurrences in toxic, in other documents).

    ``counts`` has the terms beyond chance only; ``share`` is the toxic documents' share of all words.
    """
    base = math.log(share / (1 - share))

    def ratio(a: float, b: float, errors: float = 0.0) -> float:
        return math.log((a + 0.5) / (b + 0.5)) - base - errors * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    def enough(a: float, b: float) -> bool:
        return _evidence(a, b, share) >= EVIDENCE and ratio(a, b) >= math.log(RATIO)

    children: dict[str, list[str]] = {}
    for term in sorted(counts):
        body = term.rstrip("$")
        above = (body[:n] for n in range(len(body) - (term == body), 0, -1))
        children.setdefault(next((p for p in above if p in counts), ""), []).append(term)
    chosen: dict[str, float] = {}
    purest: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (-len(t), t)):  # children first
        purest[term] = max([-math.inf, *(max(purest[c], ratio(*counts[c][1:], 2.0)) for c in children.get(term, ()))])

    def visit(term: str) -> tuple[float, float]:
        """Chooses in the branch of ``term``; occurrences (toxic, other) that the chosen ones cover."""
        below = children.get(term, ())
        if term:
            _, a, b = counts[term]
            while len(below) and max(counts[c][1] for c in below) >= 0.95 * a:  # the longer one says it as well
                term = max(below, key=lambda c: counts[c][1])
                below, (_, a, b) = children.get(term, ()), counts[term]
            if ratio(a, b) >= purest[term] - math.log(2.0):
                chosen[term] = ratio(a, b)
                return a, b
        x = y = 0.0
        for c in below:
            p, q = visit(c)
            x, y = x + p, y + q
        if term and enough(max(0.0, a - x), max(0.0, b - y)):  # what is left of the shorter one
            chosen[term] = ratio(max(0.0, a - x), max(0.0, b - y))
            return a, b
        return x, y

    visit("")
    return chosen


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Insult terminals by rates, then the logistic layer, both on the bounded sample."""
    known = _training(labels, "toxic")
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return Grammar({}, {})
    toxic = sample_of(labels, "toxic", totals["n"]).filter("y = 1").limit(sample // 3)
    clean = sample_of(labels, "toxic", totals["n"]).filter("y = 0").limit(sample - sample // 3)
    rows = stored(distinct_texts(sampled_texts(docs, toxic.union(clean))).repartition(16), "toxicity-sample")
    words = rows.select("y", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).groupBy("y").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    size = {r["y"]: (r["n"], r["w"]) for r in words.collect()}
    if len(size) < 2 or not all(w for _, w in size.values()):
        return Grammar({}, {})
    share = size[1][1] / (size[0][1] + size[1][1])
    counted = map_rows(rows.select("y", "text"), _occurrences, "term string, y int, docs long, times long")
    zero = F.lit(0)
    by_term = counted.groupBy("term").agg(*(F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(zero)).alias(n) for y, c, n in ((1, "docs", "d"), (1, "times", "a"), (0, "times", "b"))))
    n = F.col("a") + F.col("b")
    part = F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0)
    beyond = (F.col("d") >= 2) & (F.col("a") > RATIO * share / (1 - share) * F.col("b")) & (2 * part >= EVIDENCE**2)
    # bounded by the sample: terms of few thousand texts that are beyond chance
    counts = {r["term"]: (r["d"], r["a"], r["b"]) for r in by_term.filter(F.col("a") > 0).filter(beyond).collect()}
    chosen = choose(counts, share)
    grammar = Grammar({t[:-1]: w for t, w in chosen.items() if t.endswith("$")}, {t: w for t, w in chosen.items() if not t.endswith("$")})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in text_slices(batches, 1):
            yield [batch.column(0), [None if f is None else np.array(f).tobytes() for f in map(grammar.features, batch.column(1).to_pylist())]]

    got = map_rows(rows.select("y", "text"), features, "y int, f binary").collect()
    y = np.array([r["y"] for r in got], dtype=float)
    x = np.array([np.frombuffer(r["f"]) if r["f"] is not None else np.zeros(len(FEATURES)) for r in got])
    bias, grammar.weights = logistic(x, y)
    # the sample holds more toxic rows than the labels do
    all_odds, odds = totals["t"] / (totals["n"] - totals["t"]), size[1][0] / size[0][0]
    grammar.bias = bias + math.log(all_odds / odds)
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 1500) -> tuple[float, list[float]]:
    """Weights of at least 0 by accelerated projected gradient steps on a ridge-penalised logistic loss.

    THREAT's weights are drawn to TARGETED's, not to 0. The order of rows has no influence beyond rounding.
    """
    n, m = x.shape
    pairs = [(FEATURES.index("THREAT" + e), FEATURES.index("TARGETED" + e)) for e in ("", "_RATE")]
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-2)
    for t, g in pairs:
        scale[t] = scale[g]
    a = x / scale
    rate = 1 / (0.25 * (float(np.linalg.eigvalsh(a.T @ a / n)[-1]) + 1) * 1.1 + 4 * ridge)
    w, b = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, k = w.copy(), b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(a @ v + c, -60, 60))) - y) / n
        slope = a.T @ r + ridge * v
        for t, g in pairs:
            pull = ridge * (v[t] - v[g])
            slope[t] += pull - ridge * v[t]
            slope[g] -= pull
        w2, b2 = np.maximum(0, v - rate * slope), c - rate * r.sum()
        k2 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        v, c = w2 + (k - 1) / k2 * (w2 - w), b2 + (k - 1) / k2 * (b2 - b)
        w, b, k = w2, b2, k2
    return float(b), (w / scale).tolist()


# use


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in text_slices(batches, 1):
            yield [batch.column(0), [grammar.score(t) for t in batch.column(1).to_pylist()]]

    return map_rows(id_and_text(docs), run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold. Each row is judged by its own text."""
    grammar = learn(docs, labels)
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            kept = pa.array([grammar.score(t) < threshold for t in batch.column(at).to_pylist()], type=pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:at], schema=pa.schema(list(batch.schema)[:at])).filter(kept)
        batch = kept = None
        give_back()

    own = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("own text")
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), own).mapInArrow(run, docs.schema)
