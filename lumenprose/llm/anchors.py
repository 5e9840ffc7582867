"""Operator 3: substring dedup by difference-cover anchors.

Two documents that share a run of ``WINDOW`` words share, whatever the places of the run in the two, an anchor of
``ANCHOR`` words that starts at a cover position (place modulo ``PERIOD`` in ``COVER``) of both: {0, 1, 3} is a difference
cover of 7, so some shift of less than 7 brings both places into the cover, and the anchor still lies in the run. So only
3 of 7 anchors are hashed and compared. Where an anchor is shared, the windows around it are extended to full windows and
compared as such; a word is removed if a window over it also starts in a document with a smaller id.

Data flow: (1) each task packs the anchors of a few million words, sorted and cut by hash range, into compressed blocks;
(2) a reducer for each hash range finds anchors of at least two documents and answers with their places, one block for
each slot of documents; (3) the slots' texts meet these places, pack the candidate windows the same way, (4) a reducer finds for each window the smallest
document and answers with the places of all others; (5) the slots' texts (the same exchange) meet these places and lose the words. Answers already known
inside one task are sent straight on and only one representative goes to the reducer, so that a passage that a third of
all documents share costs a reducer one entry for each task, not for each document. The number of hash ranges grows with
the input. Anchors are compared by 48 bits (they only filter), windows by 80.

Defined cases: null texts have no words; a null id counts as smaller than all others; rows that repeat an id are one
document (none is "smaller"), each with its own text; documents of fewer than ``WINDOW`` words keep all words; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_schema, map_rows, slices, table

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Words that a task packs at once; characters for each hash range and for each slot of documents.
FLUSH_WORDS, RANGE_CHARS, SLOT_CHARS = 2_000_000, 8_000_000, 16_000_000
_NULL_ID = -(1 << 63)
_ROWS = "bucket int, slot int, data binary"
_ANSWER = "slot int, data binary"


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    return np.array([pow(base, n - 1 - j, 1 << 64) for j in range(n)], dtype=np.uint64)


def rolled(words: np.ndarray, at: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of the n words from each place in ``at``."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j, p in enumerate(_powers(n, base)):
        h += words[at + j] * p
    return _mixed(h)


_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte planes side by side, compressed."""
    head = np.array([len(columns), len(columns[0]) if columns else 0, *(c.dtype.itemsize for c in columns)], dtype="<u4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view("u1").reshape(len(c), -1).T).tobytes() for c in columns))


def _unpacked(data: bytes) -> list[np.ndarray]:
    k, n = np.frombuffer(data, "<u4", 2)
    sizes = np.frombuffer(data, "<u4", k, 8).tolist()
    raw, out, at = zstandard.ZstdDecompressor().decompress(data[8 + 4 * k :], max_output_size=int(n) * sum(sizes) or 1), [], 0
    for size in sizes:
        planes = np.frombuffer(raw, "u1", size * n, at).reshape(size, n).T
        out.append(np.ascontiguousarray(planes).view(f"<u{size}").reshape(-1))
        at += size * n
    return out


def _blocks(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, flag: np.ndarray, extra: np.ndarray, ids: np.ndarray, ths: np.ndarray, slots: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Entries sorted by hash, cut by hash range: (range, block)."""
    if not len(hashes):
        return
    bucket = ((hashes >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        used, local = np.unique(doc[a:b], return_inverse=True)
        h = hashes[a:b]
        deltas = np.diff(h, prepend=np.uint64(0))
        yield int(bucket[a]), len(used).to_bytes(4, "little") + (t := _packed(np.diff(ids[used], prepend=0).view("<u8"), ths[used].astype("<u4"), slots[used].astype("<u4"))).__len__().to_bytes(4, "little") + t + _packed(deltas, local.astype("<u2" if len(used) <= 65535 else "<u4"), pos[a:b].astype("<u2" if pos[a:b].max() <= 65535 else "<u4"), flag[a:b].astype("u1"), extra[a:b].astype("<u2"))


def _entries(block: bytes) -> tuple[np.ndarray, ...]:
    """hash, doc_id, th, slot, pos, flag, extra of a block's entries."""
    size = int.from_bytes(block[4:8], "little")
    ids, ths, slots = _unpacked(block[8 : 8 + size])
    ids = np.cumsum(ids.view("<i8"))
    deltas, local, pos, flag, extra = _unpacked(block[8 + size :])
    return np.cumsum(deltas, dtype=np.uint64), ids[local], ths[local].astype(np.int64), slots[local].astype(np.int64), pos.astype(np.int64), flag, extra


def _answers(doc_id: np.ndarray, th: np.ndarray, slot: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slot, packed documents and places): one block for each slot, so that their number doesn't grow with the documents."""
    if not len(pos):
        return
    order = np.lexsort((pos, th, doc_id, slot))
    doc_id, th, slot, pos = doc_id[order], th[order], slot[order], pos[order]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)], strict=True):
        yield int(slot[a]), _packed(np.diff(doc_id[a:b], prepend=0).view("<u8"), th[a:b].astype("<u4"), pos[a:b].astype("<u2" if pos[a:b].max() <= 65535 else "<u4"))


def _placed(blocks: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Places by (doc_id, th) of a slot's answers."""
    parts = [(np.cumsum(d.view("<i8")), t.astype(np.int64), p.astype(np.int64)) for d, t, p in map(_unpacked, blocks)]
    if not parts:
        return {}
    doc_id, th, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((pos, th, doc_id))
    doc_id, th, pos = doc_id[order], th[order], pos[order]
    cuts = np.flatnonzero(np.r_[True, (doc_id[1:] != doc_id[:-1]) | (th[1:] != th[:-1])])
    return {(int(doc_id[a]), int(th[a])): pos[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pos)], strict=True)}


class _Flush:
    """Gathers documents' hashes and gives blocks and answers."""

    def __init__(self, ranges: int, windows: bool) -> None:
        self.ranges, self.windows = ranges, windows
        self.clear()

    def clear(self) -> None:
        self.words: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.pos: list[np.ndarray] = []
        self.ids: list[int] = []
        self.ths: list[int] = []
        self.slots: list[int] = []
        self.size = 0

    def add(self, doc_id: int, th: int, slot: int, words: list[bytes], places: np.ndarray) -> None:
        self.words.append(word_hashes(words))
        self.at.append(places + self.size)
        self.pos.append(places)
        self.ids.append(doc_id)
        self.ths.append(th)
        self.slots.append(slot)
        self.size += len(words)

    def rows(self) -> Iterator[list]:
        if not self.words:
            return
        words, at, pos = np.concatenate(self.words), np.concatenate(self.at), np.concatenate(self.pos)
        doc = np.repeat(np.arange(len(self.ids)), [len(p) for p in self.pos])
        ids, ths, slots = np.array(self.ids, dtype=np.int64), np.array(self.ths, dtype=np.int64), np.array(self.slots, dtype=np.int64)
        order = np.argsort(ids, kind="stable")  # local numbers in order of id, so that their differences are small
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        ids, ths, slots, doc = ids[order], ths[order], slots[order], rank[doc]
        self.clear()
        if not len(at):
            return
        if self.windows:
            h, bits = rolled(words, at, WINDOW, _BASE), 64
            extra = (rolled(words, at, WINDOW, _BASE2) >> np.uint64(48)).astype(np.uint16)
            order = np.lexsort((doc, extra, h))
        else:
            h, bits = rolled(words, at, ANCHOR, _BASE) >> np.uint64(16), 48
            extra = np.zeros(len(h), dtype=np.uint16)
            order = np.lexsort((doc, h))
        h, extra, doc, pos = h[order], extra[order], doc[order], pos[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        low = ids[doc[first]]  # entries of a group are in order of id
        high = ids[doc[np.r_[first[1:], len(h)] - 1]]
        if self.windows:  # all but those of the smallest document are known to repeat it
            known = ids[doc] > low[group]
            sent = ~known
            flag = np.zeros(len(h), dtype=np.uint8)
        else:  # all of a group of several documents are known to be shared; one of them tells the reducer so
            shared = (high > low)[group]
            known = shared
            sent = ~shared | new
            flag = shared.astype(np.uint8)
        out = [(hash_of(slot) % self.ranges, slot, data) for slot, data in _answers(ids[doc[known]], ths[doc[known]], slots[doc[known]], pos[known])]
        k = np.flatnonzero(sent)
        out += [(b, None, data) for b, data in _blocks(h[k], doc[k], pos[k], flag[k], extra[k], ids, ths, slots, bits, self.ranges)]
        for a in range(0, len(out), 64):
            yield [list(c) for c in zip(*out[a : a + 64], strict=True)]


def hash_of(x: int) -> int:
    return xxhash.xxh32_intdigest(x.to_bytes(8, "little", signed=True))


def _reducer(windows: bool):
    """Answers for the blocks of one hash range; answers already known pass through."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        schema = arrow_schema(_ANSWER)
        known = rows.filter(rows.column("slot").is_valid()).select(["slot", "data"]).cast(schema)
        blocks = [_entries(d.as_py()) for d in rows.filter(rows.column("slot").is_null()).column("data")]
        if not blocks:
            return known
        h, ids, ths, slots, pos, flag, extra = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        order = np.lexsort((ids, extra, h))
        h, ids, ths, slots, pos, flag, extra = h[order], ids[order], ths[order], slots[order], pos[order], flag[order], extra[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])]
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        low, high = ids[first], ids[np.r_[first[1:], len(h)] - 1]
        if windows:
            hit = ids > low[group]
        else:
            shared = (high > low) | (np.maximum.reduceat(flag, first) > 0)
            hit = shared[group] & (flag == 0)
        found = list(_answers(ids[hit], ths[hit], slots[hit], pos[hit]))
        return pa.concat_tables([known, pa.table({"slot": [x for x, _ in found], "data": [d for _, d in found]}, schema=schema)])

    return run


_COVERED = np.zeros(PERIOD, dtype=bool)
_COVERED[list(COVER)] = True


def _anchor_places(n: int) -> np.ndarray:
    p = np.arange(max(0, n - ANCHOR + 1)) if n >= WINDOW else np.arange(0)
    return p[_COVERED[p % PERIOD]]


def _around(places: np.ndarray, before: int, n: int) -> np.ndarray:
    """Whether each of n places is at most ``before`` before one of ``places``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    places = places[places < n + before]
    np.add.at(edge, np.maximum(0, places - before), 1)
    np.add.at(edge, np.minimum(n, places + 1), -1)
    return np.cumsum(edge[:n]) > 0


def _anchored(ranges: int):
    """Blocks of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        flush = _Flush(ranges, False)
        for batch in slices(batches):
            for doc_id, th, slot, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if len(words) >= WINDOW:
                    flush.add(doc_id, th, slot, words, _anchor_places(len(words)))
                    if flush.size >= FLUSH_WORDS:
                        yield from flush.rows()
        yield from flush.rows()

    return run


def _texts(rows: pa.Table) -> Iterator[tuple[int, int, str]]:
    """(doc_id, th, text) of a slot's rows, few at a time."""
    for batch in slices(iter(rows.select(["doc_id", "th", "text"]).to_batches())):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _widened(ranges: int):
    """Blocks of the windows around a slot's shared anchors."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, flush = _placed(answers.column("data").to_pylist()), _Flush(ranges, True)
        out: list[list] = [[], [], []]
        slot = texts.column("slot")[0].as_py() if texts.num_rows else 0

        def add() -> None:
            for columns in flush.rows():
                for to, column in zip(out, columns, strict=True):
                    to += column

        for doc_id, th, text in _texts(texts):
            places = found.get((doc_id, th))
            if places is not None:
                words = words_of(text)
                flush.add(doc_id, th, slot, words, np.flatnonzero(_around(places, PERIOD - 1, len(words) - WINDOW + 1)))
                if flush.size >= FLUSH_WORDS:
                    add()
        add()
        schema = arrow_schema(_ROWS)
        return pa.table([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _cogrouped(docs: DataFrame, use: Callable[[pa.Table, dict], pa.Table], schema: StructType | str) -> DataFrame:
    """``use(rows, places)`` for each slot: the rows have doc_id, th, text and ``row`` (the other columns of ``docs``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("_null"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.crc32(text.cast("binary")).alias("th"), text.alias("text"), rest.alias("row"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges, slots = max(parts, -(-chars // RANGE_CHARS)), max(parts, -(-chars // SLOT_CHARS))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "th"), F.lit(slots)).cast("int"))
    # both steps below read this one exchange, so its columns must be the same for both
    texts = rows.select("slot", "doc_id", "th", "text", "row").repartition(parts, "slot")

    def answered(packed: DataFrame, windows: bool) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(_reducer(windows), _ANSWER)

    shared = answered(map_rows(rows.select("doc_id", "th", "slot", "text"), _anchored(ranges), _ROWS), False)
    widen = _widened(ranges)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        return widen(left, right)

    repeated = answered(texts.groupBy("slot").cogroup(shared.groupBy("slot")).applyInArrow(candidates, _ROWS), True)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left, _placed(right.column("data").to_pylist()))

    return texts.groupBy("slot").cogroup(repeated.groupBy("slot")).applyInArrow(finish, schema)


def _cut(text: str, places: np.ndarray | None) -> tuple[list[bytes], list[bytes]]:
    """The words of a text, and those that stay."""
    words = words_of(text)
    if places is None:
        return words, words
    gone = _around(places + WINDOW - 1, WINDOW - 1, len(words)).tolist()
    return words, [w for w, g in zip(words, gone, strict=True) if not g]


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: ``kept`` are the words that stay, joined by one blank."""
    ddl = "doc_id long, n_words long, n_removed long, kept string"

    def use(rows: pa.Table, places: dict) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for doc_id, th, text in _texts(rows):
            words, stay = _cut(text, places.get((doc_id, th)))
            for to, v in zip(out, (None if doc_id == _NULL_ID else doc_id, len(words), len(words) - len(stay), b" ".join(stay).decode()), strict=True):
                to.append(v)
        return pa.table(out, schema=arrow_schema(ddl))

    return _cogrouped(docs.select("doc_id", "text"), use, ddl)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns and the repeated words cut from ``text``.

    A text without repeats stays as it is, null included; one that loses words becomes the words that stay, joined by one
    blank; a document that loses all its words goes.
    """
    names = docs.columns
    schema = StructType([StructField(f"c{k}", f.dataType if f.name != "text" else StringType()) for k, f in enumerate(docs.schema.fields)])

    def use(rows: pa.Table, places: dict) -> pa.Table:
        stay: list[str | None] = []
        kept: list[bool] = []
        for doc_id, th, text in _texts(rows):
            words, left = _cut(text, places.get((doc_id, th)))
            stay.append(text if len(left) == len(words) else b" ".join(left).decode())
            kept.append(bool(left) or not words)
        row = rows.column("row").combine_chunks()
        null = row.field("_null").to_pylist() if rows.num_rows else []
        texts = pa.array([None if z else t for z, t in zip(null, stay, strict=True)], type=pa.string())
        columns = [texts if c == "text" else row.field(c) for c in names]
        return pa.table(columns, names=[f"c{k}" for k in range(len(names))]).filter(pa.array(kept, type=pa.bool_()))

    return _cogrouped(docs, use, schema).toDF(*names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same by comparing all windows: doc_id -> (n_words, n_removed, sha256 of the kept words). For tests."""
    least: dict[tuple[bytes, ...], int] = {}
    split = {d: words_of(t or "") for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            least[key] = min(d, least.get(key, d))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if least[tuple(w[i : i + WINDOW])] < d:
                gone[i : i + WINDOW] = [True] * WINDOW
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out
