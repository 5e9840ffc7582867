"""Operator 6: near-duplicates by BagMinHash signatures over multisets of word shingles.

A text is a multiset of shingles (five words, lower case; a text of one to four words is one shingle). A shingle of weight
w owns the interval (0, w], cut at powers of two into nodes; each node has its own Poisson process (rate: its length)
whose points carry an arrival time, a signature component and a position in the node. A point counts if its position is
at most w, so texts with other weights see the same points as far as their weights overlap. A component's value is its
earliest counting point; the share of equal components estimates the weighted Jaccard similarity without bias. Points are
drawn for all shingles at once, stream by stream in order of time, and no stream is followed beyond the time by which all
components are filled: the larger a text, the fewer points of each shingle.

``BANDS`` bands of ``ROWS`` components give the candidates (a pair of similarity 0.8 is missed once in 20,000). Equal
texts are one node. In a band's bucket all members are verified against its hub by exact multiset overlap; then components
are formed, and only where a bucket still holds several components, further members serve as hubs, and then pairs across
components are verified too, unless their distances to the first hub differ by more than the threshold's distance (1 - J
is a metric), which rules a link out. So every candidate pair is in one class, verified, or ruled out, and no bucket of copies is expanded into pairs.

Defined cases: null texts are empty; texts without words are near-duplicates of equal texts only; a null id counts as the
smallest one; each row is judged by its own text, also where ids are null or repeat: an id with several texts may be in
several classes, and classes of unlike texts may have the same smallest id; no rows give no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, slices, stored, table
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
_NULL_ID = -(1 << 63)
#: Rounds in which further members of a bucket serve as its hub.
ROUNDS = 2
#: Members of a bucket up to which its pairs are listed, and of a block beyond.
PAIRED, BLOCK = 24, 1024
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str) -> np.ndarray:
    """A hash of each shingle, in order, with repeats."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return _mix(out)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """BagMinHash signatures (docs x SIZE of point numbers) of entries (document, shingle, integer weight of at least 1)."""
    # nodes of each entry: (0, 1], (1, 2], (2, 4], ... as far as the weight reaches
    depth = np.ceil(np.log2(weight)).astype(np.int64) + 1
    entry = np.repeat(np.arange(len(doc)), depth)
    node = np.arange(len(entry)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(node == 0, 0.0, 2.0 ** (node - 1))
    length = np.where(node == 0, 1.0, low)
    owner, reach = doc[entry], weight[entry] - low  # positions up to ``reach`` count
    seed = _mix(shingle[entry] + node.astype(np.uint64) * _U(0xA24BAED4963EE407))
    total = np.zeros(docs)
    np.add.at(total, owner, np.minimum(length, reach))
    horizon = SIZE * (np.log(SIZE) + 4) / np.maximum(total, 1)
    time, count = np.zeros(len(entry)), np.zeros(len(entry), dtype=np.uint64)
    first = np.full(docs * SIZE, np.inf)
    point = np.zeros(docs * SIZE, dtype=np.uint64)
    active = np.arange(len(entry))
    pending_t = np.full(len(entry), np.nan)  # a drawn arrival beyond the horizon waits here
    while True:
        while len(active):
            fresh = np.isnan(pending_t[active])
            r = _mix(seed[active] + count[active] * _U(0x9FB21C651E98DF25))
            gap = -np.log(((r >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / length[active]
            t = np.where(fresh, time[active] + gap, pending_t[active])
            ok = t <= horizon[owner[active]]
            pending_t[active] = np.where(ok, np.nan, t)
            active, t, r = active[ok], t[ok], r[ok]
            time[active] = t
            count[active] += _U(1)
            s = _mix(r ^ _U(0xD6E8FEB86659FD93))
            position = (s & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[active]
            counts = position < reach[active]
            at = owner[active][counts] * SIZE + ((s[counts] >> _U(32)) * _U(SIZE) >> _U(32)).astype(np.int64)
            tt, ss = t[counts], s[counts]
            np.minimum.at(first, at, tt)
            best = first[at] == tt
            point[at[best]] = ss[best]
        open_ = np.flatnonzero(np.isinf(first.reshape(docs, SIZE)).any(axis=1) & (total > 0))
        if not len(open_):
            return point.reshape(docs, SIZE)
        horizon[open_] *= 2
        again = np.zeros(docs, dtype=bool)
        again[open_] = True
        active = np.flatnonzero(again[owner])


def bands_of(texts: list[str]) -> list[list[int] | None]:
    """Keys of the bands of each text; None for a text without words."""
    hashes = [shingles(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    if not len(doc):
        return [None] * len(texts)
    h = np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    weight = np.diff(np.r_[first, len(h)]).astype(np.float64)
    points = signatures(doc[first], h[first], weight, len(texts)).reshape(len(texts), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + points[:, :, r])
    keys = key.view(np.int64).tolist()
    return [k if len(x) else None for k, x in zip(keys, hashes, strict=True)]


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets: sum of the smaller counts over sum of the larger ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in slices(batches, 1024):
        yield [*batch.columns[:4], bands_of(batch.column(4).to_pylist())]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    kept: OrderedDict[tuple[int, int], tuple] = OrderedDict()

    def of(node: int, text: str) -> tuple:
        key = (node, hash(text))
        got = kept.get(key)
        if got is None:
            got = kept[key] = multiset(text)
            if len(kept) > 64:
                kept.popitem(last=False)
        return got

    for batch in slices(batches, 256):
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        yield [a, b, [similarity(of(x, t), of(y, u)) for x, y, t, u in zip(a, b, ta, tb, strict=True)]]


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, j): the exact similarity of each pair of nodes; ``texts`` has (doc_id, text)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    return map_rows(both, _verified, "a long, b long, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return rows.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with each member's component."""
    rows = buckets.join(found.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    return rows.join(keys, "key", "left_semi")


def links(node: list[int], comp: list[int], texts: list[str], side: list[int], threshold: float) -> list[tuple[int, int]]:
    """Pairs (a < b) of similarity ``threshold`` between components, one for each two components at least.

    ``side`` 0 is compared with side 1, or all with each other if there is one side. Overlaps are exact: shingles with
    their number of occurrence are columns of 0 and 1 of which those that only one text has are left out.
    """
    rows, tokens, total = [], [], np.zeros(len(texts))
    for k, text in enumerate(texts):
        u, c = multiset(text)
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        tokens.append(_mix(np.repeat(u, c) + nth.astype(np.uint64) * _U(0xA24BAED4963EE407)))
        rows.append(np.full(len(nth), k))
        total[k] = len(nth)
    row, token = np.concatenate(rows), np.concatenate(tokens)
    _, column, times = np.unique(token, return_inverse=True, return_counts=True)
    kept = times[column] > 1
    row, (_, column) = row[kept], np.unique(column[kept], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(texts), len(texts)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        x = np.zeros((len(texts), 4096), dtype=np.float32)
        x[row[a:b], column[a:b] - first] = 1
        overlap += x @ x.T
    sides, comps = np.array(side), np.array(comp)
    similar = overlap >= threshold * (total[:, None] + total[None, :] - overlap) - 1e-6
    similar &= (comps[:, None] < comps[None, :]) & (overlap > 0)
    if sides.any() and not sides.all():
        similar &= sides[:, None] != sides[None, :]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(similar), strict=True):
        out.setdefault((comp[i], comp[j]), (min(node[i], node[j]), max(node[i], node[j])))
    return list(out.values())


def _linked(left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components in large buckets, which are cut into blocks of ``BLOCK`` members; each two blocks meet."""
    order = Window.partitionBy("key").orderBy("doc")
    rows = left.select("key", "doc", "comp", "n", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int").alias("block"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    rows = rows.withColumn("meets", F.explode(other)).select("key", "doc", "comp", F.least("block", "meets").alias("x"), F.greatest("block", "meets").alias("y"), (F.col("block") > F.col("meets")).cast("int").alias("side"))
    rows = rows.join(texts.select(F.col("doc_id").alias("doc"), "text").hint("merge"), "doc")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        found = links(rows.column("doc").to_pylist(), rows.column("comp").to_pylist(), rows.column("text").to_pylist(), rows.column("side").to_pylist(), threshold)
        return pa.table({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=schema)

    return rows.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_id`` (null: the smallest one), two hashes of the text and one of all other columns, and ``_text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    other = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"), other.alias("_h3"), text.alias("_text"))


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2), and each text (h1, h2) with the ``first`` row (doc_id, h1, h2, h3) of its class."""
    hashed = _keyed(docs).select(F.col("_id").alias("doc_id"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), F.col("_h3").alias("h3"), F.col("_text").alias("text"))

    arrow = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _banded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    signed = stored(hashed.mapInArrow(band, "doc_id long, h1 long, h2 long, h3 long, bands array<long>"), "signatures")
    # equal texts are one node, with a number of its own: ids may be null or repeat
    reps = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    thirds = signed.join(reps.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"]).groupBy("h1", "h2", "doc_id").agg(F.min("h3").alias("h3"))
    nodes = stored(thirds.select("h1", "h2", "doc_id", "h3", F.monotonically_increasing_id().alias("node")), "nodes")
    members = signed.join(nodes.select("h1", "h2", "doc_id", "node"), ["h1", "h2", "doc_id"]).select("node", "bands")
    rows = members.select(F.explode("bands").alias("key"), F.col("node").alias("doc")).distinct()
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(rows.join(sizes, "key"), "shared")
    # the hub of a bucket is the member that shares most bands with others: the text that copies were made of, as a rule
    known = shared.groupBy("doc").agg(F.sum("size").alias("rank"))
    buckets = stored(shared.join(known, "doc").select("key", "doc", "rank"), "buckets")
    wanted = nodes.join(buckets.select(F.col("doc").alias("node")).distinct(), "node").select("h1", "h2", "doc_id", "node")
    # merge joins of texts at every size, so that the plan for large inputs is the plan for small ones
    texts = hashed.join(wanted.hint("merge"), ["h1", "h2", "doc_id"]).select(F.col("node").alias("doc_id"), "text")
    texts = stored(texts.dropDuplicates(["doc_id"]), "texts")
    hubs = buckets.groupBy("key").agg(F.max(F.struct("rank", (-F.col("doc")).alias("back"), "doc")).alias("h")).select("key", F.col("h.doc").alias("hub"))
    placed = stored(buckets.join(hubs, "key"), "placed")
    checked = stored(verify(_pairs(placed.filter("doc <> hub"), "hub", "doc"), texts), "checked")
    found = components(checked.filter(F.col("j") >= threshold).select("a", "b"))

    # what is left: buckets that still hold several components. In a few rounds the next member serves as the hub ...
    far = checked.select("a", "b", (1 - F.col("j")).alias("far"))
    near_hub = placed.withColumn("a", F.least("doc", "hub")).withColumn("b", F.greatest("doc", "hub")).join(far, ["a", "b"], "left").select("key", "doc", "hub", "rank", F.coalesce("far", F.lit(0.0)).alias("far"))
    left = stored(_mixed(near_hub, found), "left")
    order = Window.partitionBy("key").orderBy(F.desc("rank"), "doc")
    left = stored(left.withColumn("nth", F.row_number().over(order)), "ranked")
    for k in range(2, 2 + ROUNDS):
        if not left.limit(1).count():
            break
        turn = left.filter(F.col("nth") == k).select("key", F.col("doc").alias("next"), F.col("comp").alias("next_comp"))
        more = _pairs(left.join(turn, "key").filter("comp <> next_comp"), "next", "doc").join(checked.select("a", "b"), ["a", "b"], "left_anti")
        checked = checked.union(stored(verify(more, texts), "checked"))
        found = components(checked.filter(F.col("j") >= threshold).select("a", "b"))
        left = stored(_mixed(left.drop("comp"), found), "left")
    # ... then pairs across components are verified, but for those whose distances to the first hub rule a link out. Large
    # buckets are compared in blocks inside of tasks, which give only links, never pairs
    count = left.groupBy("key").agg(F.count("*").alias("n"))
    left = left.join(count, "key")
    p, q = left.filter(F.col("n") <= PAIRED).alias("p"), left.filter(F.col("n") <= PAIRED).alias("q")
    close = F.abs(F.col("p.far") - F.col("q.far")) <= 1 - threshold + 1e-9
    across = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.comp") < F.col("q.comp")) & close & (F.col("p.doc") != F.col("p.hub")) & (F.col("q.doc") != F.col("q.hub")))
    across = across.select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = verify(across, texts).filter(F.col("j") >= threshold).select("a", "b").union(_linked(left.filter(F.col("n") > PAIRED), texts, threshold))
    more = stored(more.distinct(), "more")
    if more.limit(1).count():
        found = components(checked.filter(F.col("j") >= threshold).select("a", "b").union(more))
    # the first row of a class is its smallest by id, then hashes; a node without links is a class
    own = F.struct("doc_id", "h1", "h2", "h3")
    linked = stored(nodes.join(found, "node"), "linked")
    firsts = linked.groupBy("comp").agg(F.min(own).alias("first"))
    of_node = linked.select("node", "comp").join(firsts, "comp").select("node", "first")
    return signed.select("doc_id", "h1", "h2"), nodes.join(of_node, "node", "left").select("h1", "h2", F.coalesce("first", own).alias("first"))


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each row; class_id is the smallest id of the class."""
    rows, of_text = _classed(docs, threshold)
    named = rows.join(of_text, ["h1", "h2"]).select("doc_id", F.col("first.doc_id").alias("class_id"))
    null = F.lit(None).cast("long")
    return named.select(*(F.when(F.col(c) != _NULL_ID, F.col(c)).otherwise(null).alias(c) for c in ("doc_id", "class_id")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, that stand for their class: the first row by id, hash of the text and hash of the other columns, once."""
    key = ["_id", "_h1", "_h2", "_h3"]
    _, of_text = _classed(docs, threshold)
    kept = of_text.select(*(F.col(f"first.{c}").alias(k) for c, k in zip(("doc_id", "h1", "h2", "h3"), key, strict=True))).distinct()
    return _keyed(docs).drop("_text").join(kept, key, "left_semi").dropDuplicates(key).select(*(F.col(f"`{c}`") for c in docs.columns))
