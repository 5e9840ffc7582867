"""Operator 4: SentencePiece BPE encoding and decoding by a merge-type prefix table.

For each prefix of a stretch of text there is exactly one piece that the merges leave last. The table of these last
pieces is filled from left to right: the pieces that end at a place come from an automaton over the vocabulary, and a
piece is the last one there if the last piece of what precedes it is compatible with it, i.e. merging the two alone
leaves just these two. Ids are then read backwards. Compatibility depends on two pieces only and is kept.

No piece holds the blank mark behind another character, so merges never pass a mark that follows another character:
stretches between such places are independent, and a repeated one is looked up. Characters that no piece holds become
byte pieces; they are compatible with all neighbours.

Null texts are empty and give the begin and end ids only.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import id_and_text, map_rows, slices, table

MARK = "▁"
#: Entries of a worker's caches; beyond them a cache starts anew.
CACHE_ENTRIES = 300_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_STRETCH = re.compile(f"{MARK}*[^{MARK}]*")


class PieceCodec:
    def __init__(self, name: str = "piece_bpe_32k.model") -> None:
        model = model_pb2.ModelProto()
        with open(public_tokenizers.path(name), "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        self.prefix = norm.add_dummy_prefix
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            kind = p.type
            if kind == _BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind in (_CONTROL, _UNKNOWN):
                self.bytes_of.append(b"" if kind == _CONTROL else " ⁇ ".encode())
            else:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            if MARK in p.piece.lstrip(MARK):
                raise ValueError(f"piece {p.piece!r} holds a mark behind another character")
        self.automaton = ahocorasick.Automaton()
        self.text_of = {i: p for p, i in self.ids.items()}
        self.size_of = {i: len(p) for p, i in self.ids.items()}
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        for piece, i in self.ids.items():
            # whether merging a piece's characters leaves the piece
            self.automaton.add_word(piece, (i, len(piece), len(piece) == 1 or self.merged(piece) == [piece]))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.runs: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merges: again and again the adjacent pair whose joint piece scores best, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (joint := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.score[joint], i, joint, j))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joint, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j], after[i] = joint, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the pieces a and b alone leaves a and b."""
        if len(self.compatible) >= CACHE_ENTRIES:
            self.compatible.clear()
        x, y = self.text_of[a], self.text_of[b]
        got = self.compatible[a << 20 | b] = self.merged(x + y) == [x, y]
        return got

    def run(self, text: str) -> list[int]:
        """Ids of the pieces of a run of characters."""
        if len(text) == 1:
            i = self.ids.get(text)
            return [i] if i is not None else [self.byte_ids[b] for b in text.encode()]
        n = len(text)
        last = [-1] * n  # of the prefix that ends here; -1: a character that no piece holds
        known = self.compatible.get
        for at, (piece, size, alone) in self.automaton.iter(text):
            if last[at] >= 0:
                continue
            begin = at - size
            if begin < 0:
                if alone:
                    last[at] = piece
                continue
            prior = last[begin]
            if prior < 0:
                last[at] = piece
                continue
            ok = known(prior << 20 | piece)
            if ok or ok is None and self.fits(prior, piece):
                last[at] = piece
        out: list[int] = []
        at, size_of = n - 1, self.size_of
        while at >= 0:
            i = last[at]
            if i >= 0:
                out.append(i)
                at -= size_of[i]
            else:
                out += [self.byte_ids[b] for b in reversed(text[at].encode())]
                at -= 1
        out.reverse()
        return out

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch. It is cut between characters that stand side by side in no piece."""
        runs, begin, joined = self.runs, 0, self.joined
        out: list[bytes] = []
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in joined:
                part = text[begin:k]
                ids = runs.get(part)
                if ids is None:
                    if len(runs) >= CACHE_ENTRIES:
                        runs.clear()
                    ids = runs[part] = np.array(self.run(part), dtype="<u4").tobytes()
                out.append(ids)
                begin = k
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end ids, as bytes of little-endian unsigned 32-bit integers."""
        if not text:
            return np.array([self.begin, self.end], dtype="<u4").tobytes()
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        if MARK * 2 in text or not text.startswith(MARK) or text.endswith(MARK):
            cut = [s for s in _STRETCH.findall(text) if s]
        else:
            cut = [MARK + w for w in text[1:].split(MARK)]
        known = self.stretches
        new = set(cut).difference(known)
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = set(cut)
        for s in new:
            known[s] = self.stretch(s)
        return b"".join([np.array([self.begin], dtype="<u4").tobytes(), *map(known.__getitem__, cut), np.array([self.end], dtype="<u4").tobytes()])

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; the blank that encoding put first is dropped."""
        of = self.bytes_of
        out = b"".join(map(of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", errors="replace").encode()


@lru_cache(maxsize=2)
def codec(name: str = "piece_bpe_32k.model") -> PieceCodec:
    """One for each Python worker."""
    return PieceCodec(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids): ids of each whole text with begin and end ids, binary of little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in slices(batches):
            yield [batch.column(0), [codec(model).encode(t) for t in batch.column(1).to_pylist()]]

    return map_rows(id_and_text(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text in a third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in slices(batches):
            ids = batch.column(1).to_pylist()
            yield [batch.column(0), ids, [codec(model).decode(x).decode() for x in ids]]

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
