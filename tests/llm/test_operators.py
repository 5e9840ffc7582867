"""Operators of the training-data subpackage: brute force, round trips, held-out accuracy and defined edge cases."""

import hashlib
import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenprose.llm import anchors, bagminhash, common, merkle, mtree, packing, piece_codec, quality, rans, sharding, token_files, tokens, toxicity
from lumenprose.llm.components import components

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, slot int, row string, answer string, bands string"
ODD = ["", " ", "a  b", " a", "a \n b\n\n c", "x y z", "<|endoftext|> hi", "it's 'tis\t\tq", "é ñ 漢字 😀 a", "<s> </s>", "▁▁a▁", "   x    y   ", "aaaa" * 50, "\x00q"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    long_ = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    words = " ".join(f"u{i}" for i in range(40))
    rows = [(1, words, "en", 1, "r", "a", "b"), (2, words + " tail", None, None, None, None, None), (2, words + " tail", None, None, None, None, None), (3, None, "en", 1, "r", "a", "b"), (4, "", None, 2, "", "", ""), (5, "  \n ", None, 2, "", "", ""), (6, long_, "en", 1, "r", "a", "b"), (None, "no id here", "en", 1, "r", "a", "b"), (7, long_, None, 1, "r", "a", "b"), (8, "one two", "en", 3, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark, path):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())


# 1: token files


def test_rans_round_trip_and_damage():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 70_000, rans.BLOCK * 2):
        ids = np.minimum(50_000, r.pareto(0.7, n) * 3).astype(np.uint16)
        docs = np.split(ids, np.sort(r.integers(0, n + 1, 4)))
        data = rans.encode_segment([None, 1, 2, 2, 9], docs)
        names, got = rans.decode_segment(data)
        assert names == [None, 1, 2, 2, 9] and all(np.array_equal(a, b) for a, b in zip(docs, got, strict=True))
    bad = bytearray(data)
    bad[-1] ^= 1
    with pytest.raises(rans.DamagedSegment):
        rans.decode_segment(bytes(bad))
    assert len(data) < 2 * len(ids)


def test_scaled_frequencies():
    for counts in ([1], [1] * 5000, [10**9, 1, 1], list(range(1, 3000))):
        f = rans.scaled(np.array(counts), 18)
        assert f.sum() == 1 << 18 and f.min() >= 1


def test_cached_tokens_equal_the_library():
    t = tokens.WordCachedTokenizer()
    random.seed(2)
    made = ["".join(random.choice("ab cd\n.,'é1 ") for _ in range(random.randint(0, 60))) for _ in range(300)]
    for text, ids in zip(ODD + made, t.encode(ODD + made), strict=True):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_op1(spark, odd, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_files.op1_token_files(spark, SMALL).collect()}
    start = 0
    for doc_id, text in texts_of(spark, SMALL):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = common.scratch(spark, "odd")
    token_files.write(odd, path, segment_tokens=100)
    rows = token_files.digest(token_files.read(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8] and rows[4].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    path = common.scratch(spark, "none")
    token_files.write(empty, path)
    assert token_files.read(spark, path).count() == 0


# 2 and 10: classifiers


@pytest.mark.parametrize("op,label,least", [(quality.op2_quality, "quality", 0.95), (toxicity.op10_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, op, label, least):
    rows = op(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).count() == 10 and quality.score(odd, quality.learn(odd, labels)).count() == 10
    none = labels.limit(0)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0 and quality.score(empty, quality.learn(empty, none)).count() == 0
    assert quality.keep_good(odd, none).columns == odd.columns and quality.keep_good(odd, none).count() == 10
    assert toxicity.keep_clean(odd, none).columns == odd.columns and toxicity.keep_clean(odd, none).count() == 10


def test_grammar_contexts():
    w = [1.0, 2.0, 0.1, 0.2, 0.5] + [0.0] * 5 + [1.0, 0.0]
    g = toxicity.Grammar({"blarg": 4.0}, {"snor": 3.0}, -3.0, w)
    plain, near, denied, told = (g.score(t) for t in ("Such blarg work.", "You are a blarg.", "It is not blarg work.", "Somebody said blarg."))
    assert near > plain > denied and plain > told and g.score("Clean text.") < 0.05 and g.score("The snorfel man.") > 0.4


def labels_by_force(clauses):
    """Plain Python beside the composed transducers: each match's label, found by looking around it."""
    kinds = {"blarg": "I", "kill": "H", "you": "T", "not": "N", "said": "R"}
    out, quoted = [], False
    for clause in clauses:
        words = [x for x in clause if x != '"']
        at = 0
        open_at = []
        for x in clause:
            if x == '"':
                quoted = not quoted
            else:
                open_at.append(quoted)
        for at, x in enumerate(words):
            k = kinds.get(x)
            if k not in ("I", "H"):
                continue
            near = any(kinds.get(y) == "T" for y in words[max(0, at - 4) : at + 5])
            if k == "H" and not near:
                continue
            label = "THREAT" if k == "H" else "TARGETED" if near else "PLAIN"
            if any(kinds.get(y) == "N" for y in words[max(0, at - 3) : at]):
                label = "NEGATED"
            elif open_at[at] or any(kinds.get(y) == "R" for y in words[:at]):
                label = "REPORTED"
            out.append(label)
    return out


def test_composed_transducers_against_brute_force():
    g = toxicity.Grammar({"blarg": 1.0}, {})
    words = ["blarg", "kill", "you", "not", "said", "x", '"']
    for clause in itertools.product(words, repeat=4):
        assert [m[1] for m in g.matches(list(clause))] == labels_by_force([clause]), clause
    random.seed(13)
    for _ in range(2000):
        clauses = [[random.choice([*words, "x", "x"]) for _ in range(random.randint(0, 12))] for _ in range(random.randint(1, 4))]
        tokens = [t for i, c in enumerate(clauses) for t in ([";"] if i else []) + c]
        assert [m[1] for m in g.matches(tokens)] == labels_by_force(clauses), tokens


def test_threats_decide_alone():
    """A threat at a target without any insult is a match, in fitting and in scoring; without a target it is none."""
    g = toxicity.Grammar({"blarg": 5.0}, {})
    assert g.features("The men will hurt the old lever.") is None and g.features("You see. They left. Hurt a lever.") is None
    texts = ["You are a blarg."] * 30 + ["A blarg."] * 10 + ["Clean text for you."] * 160
    for more, y in (([], []), (["I will hurt you."] * 10, [1] * 10)):
        x = np.array([g.features(t) or [0.0] * len(toxicity.FEATURES) for t in texts + more])
        g.bias, g.weights = toxicity.logistic(x, np.array([1] * 40 + [0] * 160 + y, dtype=float))
        near, far, denied = (g.score(t) for t in ("They will kill him.", "Kill a process.", "It will not hurt you."))
        assert near >= toxicity.THRESHOLD > denied and far == g.score("Clean text.") < 0.1


def test_logistic_on_separable_rows():
    """Rows that a plane divides don't drive the weights away."""
    x = np.zeros((4000, len(toxicity.FEATURES)))
    x[:1500] = np.random.default_rng(3).uniform(2, 4, (1500, len(toxicity.FEATURES)))
    bias, weights = toxicity.logistic(x, np.r_[np.ones(1500), np.zeros(2500)])
    p = 1 / (1 + np.exp(-(x @ np.array(weights) + bias)))
    assert abs(bias) < 50 and p[:1500].min() > 0.9 and p[1500:].max() < 0.1


def test_terminals_by_rate():
    """A beginning that clean texts hold by chance is learned where toxic ones hold it many times as often."""
    counts = {"ab": (60, 300, 700), "abc": (60, 290, 40), "abcd": (30, 100, 14), "xyz": (50, 200, 0), "xyzw": (50, 198, 0), "xyzw$": (50, 197, 0)}
    got = toxicity.choose(counts, 0.1)
    assert set(got) == {"abc", "xyzw$"} and got["xyzw$"] > got["abc"] > 3


@pytest.mark.parametrize("where,recall", [("sf0.001", 0.5), ("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_held_out_toxic_documents(spark, where, recall):
    where = f"/root/testdata/{where}"
    rows = toxicity.op10_toxicity(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= recall * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if not r.toxic) <= max(1, 0.02 * len(rows))


def test_learning_is_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.sampled_texts(docs, toxicity.sample_of(labels, "toxic", 10)).count() == 2
    assert quality.score(docs, quality.learn(docs, labels)).count() == 301


def test_too_few_rows_for_a_rule():
    """Two labelled rows, or equal ones, give the share of 1 as the score."""
    for x, y in ((np.eye(2, len(quality.NAMES)), [0, 1]), (np.ones((100, len(quality.NAMES))), [0, 1, 1, 1] * 25)):
        model = quality.fit(x, np.array(y, dtype=float))
        assert model.rules == [] and np.allclose(model.predict(x), np.mean(y))


def test_rules_compile_to_the_same_scores(spark):
    r = np.random.default_rng(0)
    x = r.random((400, len(quality.NAMES)))
    model = quality.fit(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float), trees=8)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [v.s for v in df.select(model.column({n: F.col(n) for n in quality.NAMES}).alias("s")).collect()]
    assert np.allclose(got, model.predict(x)) and len(model.rules) > 0


# 3: substring dedup


def test_cover_aligns_all_shifts():
    assert all(any((i + d) % 7 in anchors.COVER and (j + d) % 7 in anchors.COVER for d in range(7)) for i in range(7) for j in range(7))


def test_op3(spark, odd, empty):
    want = anchors.brute_force(texts_of(spark, SMALL))
    got = anchors.op3_substring_dedup(spark, SMALL).collect()
    assert len(got) == len(want) and all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept_sha256) for r in got)
    rows = sorted(((r.doc_id or -1), r.n_words, r.n_removed) for r in anchors.dedup(odd).collect())
    assert rows == [(-1, 3, 0), (1, 40, 0), (2, 41, 40), (2, 41, 40), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 30_000, 0), (7, 30_000, 30_000), (8, 2, 0)]
    kept = anchors.without_repeats(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1, (r.text or "")[:4]) for r in kept.collect()) == [(-1, "no i"), (1, "u0 u"), (2, "tail"), (2, "tail"), (3, ""), (4, ""), (5, "  \n "), (6, "w0x0"), (8, "one ")]
    assert anchors.dedup(empty).count() == 0


def test_op3_shared_passages(spark):
    random.seed(5)
    passage = [f"p{i}" for i in range(20)]
    docs = []
    for d in range(60):
        w = [f"d{d}w{i}" for i in range(random.randint(0, 40))]
        k = random.randint(0, 7)
        at = random.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + passage[k : k + random.randint(10, 14)] + w[at:])))
    want = anchors.brute_force(docs)
    got = anchors.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert all(want[r.doc_id] == (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)


# 4: pieces


def test_pieces_equal_the_library():
    c = piece_codec.PieceCodec()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(3)
    made = ["".join(random.choice("the in er on abc\n.,12 ÉéÃ漢😀") for _ in range(random.randint(0, 50))) for _ in range(400)]
    for text in ODD + made:
        ids = sp.encode(text, add_bos=True, add_eos=True)
        raw = c.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids and c.decode(raw).decode() == sp.decode(ids)


def test_op4(spark, odd, empty):
    assert piece_codec.op4_sentencepiece(spark, SMALL).count() == len(texts_of(spark, SMALL))
    got = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(odd)).collect()}
    assert got[3] == "" and got[8] == "one two" and len(got) == 9
    assert piece_codec.decode(piece_codec.encode(empty)).count() == 0


# 5: sharding


def test_op5(spark, odd, empty):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    assert sorted(map(tuple, sharding.op5_sharding(spark, SMALL).collect())) == sorted(con.sql(sharding.sql()).fetchall())
    names = [f"s{i}" for i in range(7)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    sizes = np.bincount(full)
    assert sizes.max() - sizes.min() <= 1 and sum(a != b for a, b in zip(full, less, strict=True)) < 1009 * 0.4
    placed = sharding.place(odd, names, 1009)
    assert placed.count() == 10 and placed.filter("shard is null").count() == 0 and sharding.place(empty, names, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


# 6: near-duplicates


def test_signatures_estimate_similarity():
    r = np.random.default_rng(4)
    off = []
    for _ in range(40):
        n = int(r.integers(5, 400))
        a = [f"x{v}" for v in r.integers(0, 10**6, n)]
        b = list(a)
        for i in r.choice(n, max(1, n // 40), replace=False):
            b[i] = f"y{i}"
        a, b = " ".join(a), " ".join(b + a[:1] * 3)
        true = bagminhash.similarity(bagminhash.multiset(a), bagminhash.multiset(b))
        sig = []
        for t in (a, b):
            u, c = bagminhash.multiset(t)
            sig.append(bagminhash.signatures(np.zeros(len(u), dtype=np.int64), u, c.astype(float), 1)[0])
        off.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.2


def classes_by_force(docs):
    sets = [bagminhash.multiset(t or "") for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if (docs[i][1] or "") == (docs[j][1] or "") or len(np.intersect1d(sets[i][0], sets[j][0])) and bagminhash.similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}


def test_op6(spark, odd, empty):
    docs = texts_of(spark, SMALL)
    assert {r.doc_id: r.class_id for r in bagminhash.op6_near_duplicates(spark, SMALL).collect()} == classes_by_force(docs)
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in bagminhash.classes(odd).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8)]
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 8]
    assert bagminhash.classes(empty).count() == 0


def test_op6_null_and_repeated_ids(spark):
    """Rows are judged by their texts: unlike texts stay where ids are null or repeat, and a copy goes with its own class only."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a, "1"), (None, b, "1"), (None, b, "1"), (None, b, "2"), (3, b + " tail", "1"), (3, c, "1"), (7, c + " tail", "1"), (7, d, "1"), (8, d, "1"), (9, e, "1"), (9, e, "1")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        kept = [(r.doc_id, r.text) for r in bagminhash.keep_one(docs).collect()]
        assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (7, d), (9, e)], key=str)
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in bagminhash.classes(docs).collect())
    assert got == [(-1, -1)] * 4 + [(3, -1), (3, 3), (7, 3), (7, 7), (8, 7), (9, 9), (9, 9)]


def test_op6_chains(spark):
    """Links through texts that are no neighbours of the bucket's smallest one."""
    base = [f"b{i}" for i in range(300)]
    docs = [(d, " ".join(f"c{i}" if i < 6 * d else w for i, w in enumerate(base))) for d in range(12)]
    docs += [(100 + d, " ".join(base[:150] + [f"z{d}q{i}" for i in range(150)])) for d in range(12)]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes_by_force(docs)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 4), (20, 30), (30, 10)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10}


# 7: Merkle fingerprints


def test_op7(spark, odd, empty):
    docs = texts_of(spark, SMALL)
    got = {r.doc_id: r for r in merkle.op7_merkle(spark, SMALL).collect()}
    prints = {}
    for k, (doc_id, text) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert got[doc_id].n_chars == len(text) and got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 0.1 > np.mean([r.near_next for r in got.values()])
    rows = merkle.with_next(odd).collect()
    assert len(rows) == 10 and {r.doc_id: r.next for r in rows}[8] == "no id here"
    assert merkle.with_next(empty).count() == 0
    two = spark.createDataFrame([("a b. c d.\ne f g.\nh i j.", "a b. c d.\nE f g.\nh i j.")], "a string, b string")
    two = merkle.fingerprints(two.withColumn("ta", merkle.tree(F.col("a"))).withColumn("tb", merkle.tree(F.col("b"))), x=("a", "ta"), y=("b", "tb"))
    assert two.select(merkle.edits(F.col("x"), F.col("y")).alias("e"), merkle.likeness(F.col("x"), F.col("y")).alias("l")).first() == ([1], 0.75)


def murmur(data: bytes) -> int:
    """Spark's 32-bit hash of a string, in plain Python: whole words, then each byte that is left as a word."""
    h = 42
    end = len(data) // 4 * 4
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, end, 4)] + [b - 256 if b > 127 else b for b in data[end:]]
    for k in words:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h


def tree_by_force(text):
    """The leaves of each line: words one after another, four at most, up to a mark at a word's end."""
    import regex

    rx = regex.compile(merkle.LEAVES, regex.ASCII)
    return [[murmur(m.group().strip(" ").encode()) for m in rx.finditer(line)] for line in text.split("\n")]


def print_by_force(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    paragraphs = [".".join(f"{v:08x}" for v in leaves) for leaves in tree_by_force(text)]
    paragraphs = [sha(p)[:12] + "=" + p for p in paragraphs]
    groups = [paragraphs[i : i + merkle.SECTION] for i in range(0, len(paragraphs), merkle.SECTION)]
    sections = [sha(",".join(p[:12] for p in g))[:12] + "(" + ",".join(g) + ")" for g in groups]
    return sha(sha("/".join(s[:12] for s in sections)) + sha(text)) + ":" + "/".join(sections)


def near_by_force(a, b):
    if a == b:
        return 1.0
    x, y = ({v for p in tree_by_force(t) for v in p} for t in (a, b))
    return 2.0 * len(x & y) / max(1, len(x) + len(y))


def test_op7_tree_and_likeness_by_force(spark):
    docs = texts_of(spark, SMALL)
    got = {r.doc_id: r for r in merkle.op7_merkle(spark, SMALL).collect()}
    for k, (doc_id, text) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = got[doc_id]
        assert r.fingerprint == print_by_force(text) and r.edited_fingerprint == print_by_force(edited)
        assert abs(r.near_edited - near_by_force(text, edited)) < 1e-12 and abs(r.near_next - near_by_force(text, nxt)) < 1e-12


def test_op7_edits_by_levels(spark):
    lines = [f"w{i} x{i}. y{i} z{i}" for i in range(70)]
    other = list(lines)
    other[3], other[40], other[69] = "new text", "more", "last."
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("same", "same"), ("", "a")], "a string, b string")
    rows = merkle.fingerprints(rows.withColumn("ta", merkle.tree(F.col("a"))).withColumn("tb", merkle.tree(F.col("b"))), x=("a", "ta"), y=("b", "tb"))
    assert [r.e for r in rows.select(merkle.edits(F.col("y"), F.col("x")).alias("e")).collect()] == [[3, 40, 69], [], [0]]


def test_op7_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        docs = spark.range(5000).selectExpr("id as doc_id", "concat('t', id) as text")
        assert merkle.with_next(docs).filter("next <> concat('t', (doc_id + 1) % 5000)").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# 8: packing


def test_closest_fill_is_best():
    random.seed(6)
    for _ in range(60):
        counts = [0] * 40
        for _ in range(random.randint(0, 8)):
            counts[random.randint(1, 39)] += random.randint(1, 3)
        room = random.randint(1, 60)
        sums = {0}
        for n, c in enumerate(counts):
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        used = packing.closest_fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= counts[n] for n, k in used.items())


def check_packed(rows, lengths):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == lengths[d]
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024


def test_op8(spark, odd, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts_of(spark, SMALL)}
    rows = packing.op8_packing(spark, SMALL).collect()
    check_packed(rows, {d: len(x) for d, x in ids.items()})
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert packing.pack(odd).filter("doc_id = 3").first().length == 1 and packing.pack(empty).count() == 0
    packer = packing.Packer(pool=50, kept=10)
    r = np.random.default_rng(0)
    sizes = {d: int(n) for d, n in enumerate(r.integers(1, 3000, 500))}
    for d, n in sizes.items():
        packer.add(d, np.arange(n))
    packer.finish()
    named = [type("R", (), dict(zip(("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), t, strict=True))) for t in packer.taken()]
    check_packed(named, sizes)


# 9: exact search


def test_op9(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert sorted(map(tuple, mtree.op9_mtree(spark, DATA).collect())) == sorted(con.sql(mtree.SQL).fetchall())


def test_op9_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (200, [0.0, -1.0], None)]
    v = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(tuple(r) for r in mtree.top_k(v, v.filter("vec_id % 100 = 0")).collect())
    assert got == [(100, 1, 1, 1024**2), (100, 2, 2, 1024**2), (100, 3, 200, 0), (200, 1, 1, 0), (200, 2, 2, 0), (200, 3, 100, 0)]
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0


def test_op9_huge_and_repeated(spark):
    rows = [(100, [3e38, 3e38], 1), (1, [3e38, 3e38], 1), (2, [-3e38, 1.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 1.0], 1), (200, [1.0, 0.0], 1), (200, [0.0, 1.0], 1), (200, [0.0, 1.0], 1)]
    v = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec_id2 int"))
    got = {}
    for q, rank, i, s in sorted(tuple(r) for r in mtree.top_k(v, v.filter("vec_id % 100 = 0")).collect()):
        got.setdefault(q, []).append((rank, i, s))
    top, low = (1 << 63) - 1, -(1 << 63)
    exact = int(3e38 * 1024) * 1024
    assert got[100] == [(1, 1, top), (2, 3, top), (3, 3, top), (4, 200, top), (5, 200, top), (6, 200, top), (7, 2, low)] and exact > top
    assert [s for _, i, s in got[200] if i == 3] == [2 * 1024**2, 1024**2, 1024**2, 1024**2]
    big = np.array([[2.0**30 + 1, 2.0**30], [2.0**30, 2.0**30 + 1], [2.0**30, 2.0**30]])
    found = mtree.search(mtree.make_tree(big, np.arange(3)), big[0] + 1, 9)
    assert found == sorted(((sum(int(a) * int(b) for a, b in zip(x, big[0] + 1, strict=True)), i) for i, x in enumerate(big)), key=lambda t: (-t[0], t[1]))


def test_mtree_search_is_exact():
    r = np.random.default_rng(9)
    x = np.floor(r.normal(0, 500, (700, 12)))
    x[50:90] = x[0]
    ids = r.permutation(700).astype(np.int64)
    tree = mtree.make_tree(x, ids)
    for q in (x[0], x[5] * 3, np.zeros(12)):
        want = sorted(((-int(s), int(i)) for s, i in zip(x @ q, ids, strict=True) if i != 3))[:10]
        assert [(-s, i) for s, i in mtree.search(tree, q, 3)] == want


def test_links_in_blocks():
    random.seed(8)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(f"e{d}" if random.random() < 0.02 else w for w in base) + " b1 b2" * random.randint(0, 2) for d in range(40)]
    sets = [bagminhash.multiset(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if bagminhash.similarity(sets[i], sets[j]) >= 0.8}
    assert set(bagminhash.links(list(range(40)), list(range(40)), texts, [0] * 40, 0.8)) == want
    side = [0] * 20 + [1] * 20
    assert set(bagminhash.links(list(range(40)), list(range(40)), texts, side, 0.8)) == {(i, j) for i, j in want if side[i] != side[j]}


def test_op6_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "PAIRED", 2)
    monkeypatch.setattr(bagminhash, "BLOCK", 5)
    random.seed(11)
    base = [f"b{i}" for i in range(200)]
    docs = [(d, " ".join(f"e{d}x{i}" if random.random() < 0.035 else w for i, w in enumerate(base))) for d in range(40)]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = classes_by_force(docs)
    assert got == want and 1 < len(set(want.values()))


def test_tokens_white_space():
    """The searches for unusual white space and runs of blanks against patterns; ids against the library."""
    import re

    from lumenprose.llm import tokens

    spaces = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and re.match(r"\s", chr(i))]
    texts = [*(f"a{x}{s}{y}b{z}" for s in spaces for x in ("", " ", "é") for y in ("", " ", "\n") for z in ("", " ", "\n", " \n")), "", " ", "\n", "ab", "é"]
    usual = [t for t in texts if not re.search(r"[^\S \t\n\r]", t)]
    assert all(tokens.odd_space(t) for t in texts if t not in usual) and not any(map(tokens.odd_space, usual))
    assert all(tokens.blank_run(t) == bool(re.search(r" (?:\s|$)", t)) for t in usual)
    tk = tokens.tokenizer()
    assert [x.tolist() for x in tk.encode(texts)] == [tk.library.encode(t, add_special_tokens=False).ids for t in texts]


#: Ids of many new words, then how much memory of its own the process holds more than before, in MB.
MEMORY = """
import re
from pathlib import Path
from lumenprose.llm import tokens
def own(): return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1e3
t = tokens.WordCachedTokenizer()
t.encode(["a b"])
before = own()
for k in range(5):
    for text, ids in zip(*(lambda x: (x, t.encode(x)))([" ".join(f"{w}{i:x}" for i in range(k * 300_000 + d * 3000, k * 300_000 + d * 3000 + 3000) for w in ("qua", "the")) for d in range(100)])):
        assert t.lengths[ids].sum() == len(text)
print(own() - before)
"""


def test_tokenizer_memory():
    """A worker that waits keeps little memory, however many words it has seen."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    assert float(got.stdout) < 150


def test_words_beyond_the_cache(monkeypatch):
    """Words that the cache drops, pieces that no cache takes, and words that were first pieces get the library's ids again."""
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(tokens, "_AT_ONCE", 7)
    t = tokens.WordCachedTokenizer()
    random.seed(8)
    for _ in range(30):
        texts = [" ".join(f"{random.choice('aéß漢')}{random.randint(0, 30)}{random.choice(['', '.', '\n漢', '  ', ' \n', chr(0)])}" for _ in range(random.randint(0, 12))) for _ in range(8)]
        texts += ["x" * 3000 + " " + "y" * 300, "a b\x0bc", "<|endoftext|> a1", *ODD]
        assert [x.tolist() for x in t.encode(texts)] == [t.library.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(t.words) <= 20 + 100


def test_remainders_hold_their_ids_only():
    """A document's rest that waits doesn't keep the whole document."""
    packer = packing.Packer()
    packer.add(1, np.arange(100 * packing.WINDOW + 5))
    assert packer.waiting[5][0][3].base is None
