"""Operator 8: packs token ids into sequences by minimum bin slack.

Every whole window of a document is a sequence of its own. The remainders, shorter than a window, wait in a pool. For
each next sequence the largest remainder is laid down; a bitset holds all sums that the other remainders' lengths (a
multiset) can make, and the sum closest to the free room is taken and traced back to counts for each length. A pattern
that was found is used as often as the counts allow. Room that no sum fills is filled by cutting one more remainder.

Only a partition's last pieces can leave a sequence short: they are cut into sequences whose lengths are powers of two,
so that no sequence is padded. Memory is bounded by ``POOL`` remainders, whatever a partition's size; documents are
packed where they are read, without a shuffle, and no pool is common to partitions, so no source or copy can be hot.

Null texts are empty (their end id alone is packed); repeated rows are packed as often as they occur; no rows give no pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_rows, table, text_slices
from .tokens import tokenizer

WINDOW = 1024
END_ID = 0
#: Remainders that wait at most, and that stay for the next round.
POOL, KEPT = 4096, 512
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest_fill(counts: list[int], room: int) -> dict[int, int]:
    """Counts for each length of the multiset whose sum is at most ``room`` and closest to it. counts[n]: how many of length n."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left, k = counts[n], 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, bits))
            bits |= (bits << (n * k)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            used[n] += k
            total -= n * k
    return dict(used)


class Packer:
    """Takes documents one by one; gives pieces (doc_id, start, length, doc_tokens, sequence, offset, ids)."""

    def __init__(self, window: int = WINDOW, pool: int = POOL, kept: int = KEPT, first_sequence: int = 0) -> None:
        self.window, self.pool, self.kept, self.sequence = window, pool, kept, first_sequence
        self.waiting: list[list[tuple]] = [[] for _ in range(window)]  # by length: (doc_id, start, doc_tokens, ids)
        self.counts = [0] * window
        self.total = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - n % w, w):
            self._lay([(doc_id, start, n, ids[start : start + w])])
        if n % w:
            self._wait((doc_id, n - n % w, n, ids[n - n % w :].copy()))  # the rest of the document isn't kept
        if self.total > self.pool:
            self._pack(self.kept)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def finish(self) -> None:
        self._pack(0)

    def _wait(self, item: tuple) -> None:
        n = len(item[3])
        self.waiting[n].append(item)
        self.counts[n] += 1
        self.total += 1

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.total -= 1
        return self.waiting[n].pop()

    def _lay(self, items: list[tuple]) -> None:
        offset = 0
        for doc_id, start, n, ids in items:
            self.out.append((doc_id, start, len(ids), n, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1

    def _pack(self, keep: int) -> None:
        top = self.window - 1
        while self.total > keep:
            while not self.counts[top]:
                top -= 1
            self.counts[top] -= 1
            used = closest_fill(self.counts, self.window - top)
            self.counts[top] += 1
            used[top] = used.get(top, 0) + 1
            slack = self.window - sum(n * k for n, k in used.items())
            times = 1 if slack else min(self.counts[n] // k for n, k in used.items())
            for _ in range(times):
                items = [self._take(n) for n, k in used.items() for _ in range(k)]
                if slack:
                    larger = next((n for n in range(self.window - 1, slack, -1) if self.counts[n]), 0)
                    if not larger:  # nothing that remains is longer than the room: these are the last pieces, or all of it fits
                        items += [self._take(n) for n in range(1, self.window) for _ in range(self.counts[n])]
                        self._last(items)
                        break
                    doc_id, start, n, ids = self._take(larger)
                    items.append((doc_id, start, n, ids[:slack]))
                    self._wait((doc_id, start + slack, n, ids[slack:]))
                    top = max(top, larger - slack)
                self._lay(items)

    def _last(self, items: list[tuple]) -> None:
        """Lays pieces into full windows and then sequences whose lengths are powers of two."""
        left = sum(len(x[3]) for x in items)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            room, laid = size, []
            while room:
                doc_id, start, n, ids = items.pop(0)
                laid.append((doc_id, start, n, ids[:room]))
                if len(ids) > room:
                    items.insert(0, (doc_id, start + room, n, ids[room:]))
                room -= min(room, len(ids))
            self._lay(laid)
            left -= size


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row for each piece: its document, place, sequence and ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        packer = Packer(window, first_sequence=TaskContext.get().partitionId() << 40)

        def rows() -> Iterator[list]:
            got = packer.taken()
            for at in range(0, len(got), 4096):
                doc, start, length, n, seq, offset, ids = zip(*got[at : at + 4096], strict=True)
                yield [doc, start, length, n, seq, offset, [x.astype("<u4").tobytes() for x in ids]]

        for batch in text_slices(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer(vocabulary).encode(batch.column(1)), strict=True):
                packer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
            yield from rows()
        packer.finish()
        yield from rows()

    return map_rows(id_and_text(docs), run, _PIECE)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
