"""Token-id files: static range asymmetric numeral systems (range variant) in independent interleaved blocks.

A *segment* holds whole documents. Its header has the documents' ids and lengths and one static frequency table that
all its blocks share. A *block* is up to ``BLOCK`` ids, dealt over ``LANES`` interleaved coder states; it has a crc32
and can be decoded by itself. Every ``STRIDE`` steps a *checkpoint* keeps the states and the place in the word stream,
so that the parts of a block are decoded side by side too. A damaged block fails its checksum.

The states are 64-bit, words are 32-bit and are passed when a state leaves [2^31, 2^63).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 128
STEPS = 512
STRIDE = 128
BLOCK = LANES * STEPS
MAGIC = b"LPT1"
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)


class DamagedSegment(ValueError):
    """A segment whose bytes are not those that were written."""


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, near to the counts' shares."""
    total = 1 << bits
    freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - total
    if over < 0:
        freq[int(np.argmax(freq))] -= over
    while over > 0:  # take from the most frequent ones, never below 1
        order = np.argsort(-freq, kind="stable")[: max(1, min(over, len(freq)))]
        take = np.minimum(freq[order] - 1, max(1, over // len(order)))
        take = np.minimum(take, np.maximum(0, over - np.concatenate(([0], np.cumsum(take)[:-1]))))
        freq[order] -= take
        over -= int(take.sum())
    return freq


def _encode_blocks(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``symbols``: blocks x steps x lanes. For each block: words, checkpoint states, checkpoint places."""
    blocks, steps, lanes = symbols.shape
    state = np.full(blocks * lanes, _LOW, dtype=np.uint64)
    shift = np.uint64(bits)
    limit = np.uint64(63 - bits)
    where: list[np.ndarray] = []
    words: list[np.ndarray] = []
    used = np.zeros((steps + 1, blocks), dtype=np.int64)
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t, :].reshape(-1)
        f = freq[s]
        out = np.flatnonzero(state >= (f << limit))
        where.append(out)
        words.append(state[out].astype(np.uint32))
        state[out] >>= _U32
        used[t] = np.bincount(out // lanes, minlength=blocks)
        q = state // f
        state = (q << shift) + (state - q * f) + start[s]
        if t % STRIDE == 0:
            marks[t] = state.copy()
    lane = np.concatenate(where[::-1])
    word = np.concatenate(words[::-1])
    order = np.argsort(lane // lanes, kind="stable")
    word = word[order]
    ends = np.cumsum(used.sum(axis=0))
    before = np.concatenate((np.zeros((1, blocks), dtype=np.int64), np.cumsum(used[:-1], axis=0)))
    at = sorted(marks)
    out = []
    for b in range(blocks):
        states = np.stack([marks[t][b * lanes : (b + 1) * lanes] for t in at])
        out.append((word[ends[b] - int(used[:, b].sum()) : ends[b]], states, before[at, b]))
    return out


def _decode_units(states: np.ndarray, place: np.ndarray, words: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """All checkpoint units side by side: units x steps x lanes of symbols. ``place``: each unit's first word."""
    units, lanes = states.shape
    out = np.empty((units, steps, lanes), dtype=np.uint32)
    state, at = states.copy(), place.astype(np.int64).copy()
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(steps):
        slot = state & mask
        s = slots[slot.astype(np.int64)]
        out[:, t, :] = s
        state = freq[s] * (state >> shift) + slot - start[s]
        low = state < _LOW
        nth = np.cumsum(low, axis=1)
        taken = (at[:, None] + nth - 1)[low]
        state[low] = (state[low] << _U32) | words[taken]
        at += nth[:, -1]
    return out


#: Ids below this are counted in an array, without sorting.
_DENSE = 1 << 20


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in ascending order, each id's index there, and counts."""
    if not len(ids):
        return ids, ids, ids
    if int(ids.max()) >= _DENSE:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    index = np.zeros(len(counts), dtype=np.uint32)
    index[values] = np.arange(len(values), dtype=np.uint32)
    return values, index[ids], counts[values]


def encode_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One segment of whole documents. Empty documents and an empty list are allowed."""
    ids = np.concatenate([np.asarray(d, dtype=np.uint32) for d in docs]) if docs else np.empty(0, dtype=np.uint32)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype="u1")
    lengths = np.array([len(d) for d in docs], dtype="<u4")
    values, symbols, counts = _counted(ids)
    bits = 18
    while len(values) > (1 << bits) // 4:
        bits += 1
    freq = scaled(counts, bits) if len(ids) else np.empty(0, dtype=np.int64)
    head = zlib.compress(known.tobytes() + null.tobytes() + lengths.tobytes() + np.asarray(values, dtype="<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    out = [MAGIC, struct.pack("<IIIIII", len(docs), len(ids), len(values), bits, len(head), zlib.crc32(head)), head]
    if len(ids):
        f = freq.astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        common = int(np.argmax(freq))
        full = len(ids) // BLOCK
        groups = [symbols[: full * BLOCK].reshape(full, STEPS, LANES)] if full else []
        if rest := len(ids) - full * BLOCK:
            steps = -(-rest // LANES)
            padded = np.full(steps * LANES, common, dtype=symbols.dtype)
            padded[:rest] = symbols[full * BLOCK :]
            groups.append(padded.reshape(1, steps, LANES))
        b = 0
        for group in groups:
            for words, states, places in _encode_blocks(group, f, start, bits):
                part = ids[b * BLOCK : (b + 1) * BLOCK]
                out.append(struct.pack("<IIIII", len(part), group.shape[1], len(states), len(words), zlib.crc32(part.astype("<u4").tobytes())))
                out += [states.astype("<u8").tobytes(), places.astype("<u4").tobytes(), words.astype("<u4").tobytes()]
                b += 1
    return b"".join(out)


def decode_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a segment; DamagedSegment if a checksum differs."""
    if data[:4] != MAGIC:
        raise DamagedSegment("not a token segment")
    n_docs, n_ids, n_values, bits, n_head, crc = struct.unpack_from("<IIIIII", data, 4)
    head = data[28 : 28 + n_head]
    if zlib.crc32(head) != crc:
        raise DamagedSegment("the header's checksum differs")
    head = zlib.decompress(head)
    known = np.frombuffer(head, "<i8", n_docs, 0)
    null = np.frombuffer(head, "u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(head, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    values = np.frombuffer(head, "<u4", n_values, 13 * n_docs)
    freq = np.frombuffer(head, "<u4", n_values, 13 * n_docs + 4 * n_values)
    ids = np.empty(n_ids, dtype=np.uint32)
    if n_ids:
        f = freq.astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(freq.astype(np.int64))[:-1])).astype(np.uint64)
        slots = np.repeat(np.arange(n_values, dtype=np.uint32), freq)
        blocks, at, offset, words_before, words = [], 28 + n_head, 0, 0, []
        while at < len(data):
            n, steps, marks, n_words, crc = struct.unpack_from("<IIIII", data, at)
            at += 20
            states = np.frombuffer(data, "<u8", marks * LANES, at).reshape(marks, LANES)
            at += states.nbytes
            places = np.frombuffer(data, "<u4", marks, at)
            at += places.nbytes
            words.append(np.frombuffer(data, "<u4", n_words, at))
            at += 4 * n_words
            blocks.append((offset, n, steps, crc, states, places.astype(np.int64) + words_before))
            offset += n
            words_before += n_words
        stream = np.concatenate(words).astype(np.uint64)
        by_steps: dict[int, list[tuple[int, np.ndarray, int]]] = {}  # steps of a unit -> (first id, states, place)
        for offset, _, steps, _, states, places in blocks:
            for k in range(len(states)):
                by_steps.setdefault(min(STRIDE, steps - k * STRIDE), []).append((offset + k * STRIDE * LANES, states[k], int(places[k])))
        for steps, units in by_steps.items():
            got = _decode_units(np.stack([u[1] for u in units]), np.array([u[2] for u in units]), stream, steps, f, start, slots, bits)
            for (first, _, _), symbols in zip(units, got, strict=True):
                part = values[symbols.reshape(-1)[: n_ids - first]]
                ids[first : first + len(part)] = part
        for offset, n, _, crc, _, _ in blocks:
            if zlib.crc32(ids[offset : offset + n].astype("<u4").tobytes()) != crc:
                raise DamagedSegment(f"the checksum of the block at id {offset} differs")
    ends = np.cumsum(lengths)
    return [None if z else int(d) for d, z in zip(known, null, strict=True)], [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
