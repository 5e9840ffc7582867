"""Token ids by the tokenizers library, with a cache of ids for repeated words.

A byte-level BPE tokenizer of this family cuts a text into pre-tokens and encodes each one by itself. A blank that
precedes a character other than white space always begins a pre-token, so a text can be cut there, and what lies
between two cuts has the same ids wherever it stands. The library encodes each distinct pre-token of the words that are
not known yet; texts with unusual white space or with a special token's string go to the library whole.

Words and ids are kept in Arrow and numpy arrays, some 30 bytes a word: a slice of texts is cut, and its words are numbered
together with the known ones, by Arrow; ids are gathered by those numbers.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .common import give_back

#: Words that the cache keeps at most, and bytes of them; beyond that the half that was used last stays.
CACHE_ENTRIES, CACHE_BYTES = 500_000, 16_000_000
#: Words whose ids are gathered at once.
_GATHERED = 1 << 18
_ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    -⁠　﻿]")
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
#: What begins the UTF-8 bytes of all odd white space.
_ODD_BYTES = (*(c.encode() for c in _ODD_ASCII), b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
#: A blank before white space; other white space than this is odd.
_RUNS = ("  ", " \t", " \n", " \r")
#: Pre-tokens for one call of the library, which takes some 1 kB for each meanwhile.
_AT_ONCE = 20_000
_CUT = re.compile(r" (?=\S)")


def odd_space(text: str) -> bool:
    """Whether a text has unusual white space; searches for single characters are faster than a pattern."""
    return any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text) is not None


def blank_run(text: str) -> bool:
    """Whether white space or the end follows a blank, in a text without unusual white space."""
    return text.endswith(" ") or any(r in text for r in _RUNS)


def _alphabet() -> str:
    """The character that a byte-level vocabulary has for each byte; 0xFF, which UTF-8 never holds, is a blank here."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in own else next(other)) for b in range(255)) + " "


_ALPHABET = _alphabet()


def _gather(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` ids from ``first`` on, for each of them, one after another."""
    out = [ids[:0]]
    for at in range(0, len(first), _GATHERED):
        n = count[at : at + _GATHERED]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat(first[at : at + _GATHERED] - (ends - n), n)
        place += np.arange(len(place))
        out.append(ids[place])
    return np.concatenate(out)


class WordCachedTokenizer:
    """``encode(texts)``: ids of each text as numpy arrays, equal to the library's ids of the whole text."""

    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_padding()
        self.library.no_truncation()
        # the same model for pre-tokens that are cut already, in the vocabulary's characters, with blanks between them
        self.single = Tokenizer(self.library.model)
        self.single.pre_tokenizer = CharDelimiterSplit(" ")
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        vocab = self.library.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character stands for one byte
        # words, which have a blank before them in the text; where their ids are; the slice of texts that held them last
        self.words = pa.array([], pa.string())
        self.ids = np.empty(0, dtype=self.dtype)
        self.first, self.count, self.last = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
        self.slice = 0

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each word's first one and their number there."""
        known = words.to_pylist()
        alpha = np.fromiter(map(str.isalpha, known), dtype=bool, count=len(known))
        order = np.concatenate((np.flatnonzero(alpha), np.flatnonzero(~alpha)))
        parts = [" " + w for w, a in zip(known, alpha.tolist(), strict=True) if a]  # each is one pre-token
        # a blank before a word begins a pre-token, so that other words are cut together
        parts += self.pattern.findall("".join([" " + w for w, a in zip(known, alpha.tolist(), strict=True) if not a]))
        coded = pa.array(parts, pa.string()).dictionary_encode()
        ids, ends = self._parts(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        size = pc.binary_length(coded.dictionary).to_numpy()
        number = np.diff(ends, prepend=0)
        ids = _gather(ids, (ends - number)[which], number[which])
        needed = np.cumsum(pc.binary_length(words).to_numpy()[order] + 1, dtype=np.int64)
        after = np.cumsum(number[which])[np.searchsorted(np.cumsum(size[which], dtype=np.int64), needed)]
        first, count = np.empty(len(known), dtype=np.int64), np.empty(len(known), dtype=np.int32)
        count[order] = np.diff(after, prepend=0)
        first[order] = after - count[order]
        return ids, first, count

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and where each one's end."""
        all_ids, all_ends, before = [np.empty(0, dtype=self.dtype)], [np.empty(0, dtype=np.int64)], 0
        for at in range(0, len(parts), _AT_ONCE):
            raw = [p.encode() for p in parts[at : at + _AT_ONCE]]
            mapped = codecs.charmap_decode(b"\xff".join(raw), "strict", _ALPHABET)[0]
            ids = np.array(self.single.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype=self.dtype)
            # ids of a byte-level vocabulary cover the bytes one after another, so their lengths show where a pre-token ends
            needed = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
            all_ends.append(np.searchsorted(np.cumsum(self.lengths[ids]), needed) + 1 + before)
            all_ids.append(ids)
            before += len(ids)
        return np.concatenate(all_ids), np.concatenate(all_ends)

    def _sorted_out(self, texts: pa.Array) -> tuple[list[int], list[tuple[int, str]], list[int]]:
        """Texts (by number) that the library takes whole, those with runs of blanks, with their text, and all others."""
        start, end = (np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset + x] for x in (0, len(texts)))
        data = texts.buffers()[2].slice(int(start), int(end - start)).to_pybytes() if end > start else b""
        marks = (*_ODD_BYTES, *(s.encode() for s in self.special), *(r.encode() for r in _RUNS))
        whole, runs, plain = [], [], list(range(len(texts)))
        # all texts at once first; most slices hold none of it. A search for one byte is the fastest
        if any(m[:1] in data and m in data for m in marks) or pc.any(pc.ends_with(texts, " ")).as_py():
            plain = []
            for i, text in enumerate(texts.to_pylist()):
                if odd_space(text) or any(s in text for s in self.special):
                    whole.append(i)
                elif blank_run(text):
                    runs.append((i, text))
                else:
                    plain.append(i)
        return whole, runs, plain

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if not len(texts):
            return []
        whole, runs, plain = self._sorted_out(texts)
        lists = pc.split_pattern(texts if len(plain) == len(texts) else texts.take(pa.array(plain, pa.int64())), " ")
        pieces = lists.flatten()
        begins = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        cuts = [_CUT.split(text) for _, text in runs]
        sizes = np.array([len(pieces), *map(len, cuts), *(1 for _ in whole)], dtype=np.int64)
        begins = np.concatenate((begins, np.cumsum(sizes)[:-1]))
        # the first piece of a text has no blank before it; a whole text is nothing but its first piece
        heads = pieces.take(pa.array(begins[: len(plain)])).to_pylist() + [c[0] for c in cuts] + texts.take(pa.array(whole, pa.int64())).to_pylist()
        pieces = pa.concat_arrays([self.words, pieces, pa.array([p for c in cuts for p in c] + [""] * len(whole), pa.string())])
        coded = pieces.dictionary_encode()
        known, n = len(self.words), len(coded.dictionary)
        which = coded.indices.to_numpy()[known:].copy()
        which[begins] = np.arange(n, n + len(heads))
        used = np.zeros(n + len(heads), dtype=bool)
        used[which] = True
        new = known + np.flatnonzero(used[known:n])
        new_ids, new_first, new_count = self._learn(coded.dictionary.take(pa.array(new)))
        head_ids = [self._library(h) if h else self.ids[:0] for h in heads]
        first, count = np.zeros(n + len(heads), dtype=np.int64), np.zeros(n + len(heads), dtype=np.int32)
        first[:known], count[:known] = self.first, self.count
        first[new], count[new] = len(self.ids) + new_first, new_count
        count[n:] = [len(x) for x in head_ids]
        first[n:] = len(self.ids) + len(new_ids) + np.cumsum(count[n:]) - count[n:]
        ids = np.concatenate((self.ids, new_ids, *head_ids))
        each = count[which]
        flat = _gather(ids, first[which], each)
        ends = np.cumsum(each, dtype=np.int64)[np.append(begins[1:], len(which)) - 1].tolist()
        out = [flat[:0]] * len(texts)
        for i, a, b in zip([*plain, *(i for i, _ in runs), *whole], [0, *ends], ends, strict=False):
            out[i] = flat[a:b]
        self._keep(coded.dictionary, ids, first[:n], count[:n], used[:n])
        if len(flat) >= _GATHERED:  # a worker that waits holds the cache only, not what a slice took
            del pieces, lists, coded, which, each
            give_back()
        return out

    def _keep(self, words: pa.Array, ids: np.ndarray, first: np.ndarray, count: np.ndarray, used: np.ndarray) -> None:
        """The cache for the next slice: all words that have ids, or the half that was used last."""
        last = np.full(len(words), -1, dtype=np.int64)
        last[: len(self.last)] = self.last
        last[used] = self.slice
        self.slice += 1
        kept = np.flatnonzero(last >= 0)
        if len(kept) > CACHE_ENTRIES or words.nbytes > CACHE_BYTES:
            size = pc.binary_length(words).to_numpy()
            kept = kept[size[kept] <= 256]
            kept = kept[np.argsort(-last[kept], kind="stable")][: CACHE_ENTRIES // 2]
            kept = kept[np.cumsum(size[kept], dtype=np.int64) <= CACHE_BYTES // 2]
        self.words = words.take(pa.array(kept))
        self.ids, self.count, self.last = _gather(ids, first[kept], count[kept]), count[kept], last[kept]
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count


@lru_cache(maxsize=2)
def tokenizer(name: str = "byte_bpe_50k.json") -> WordCachedTokenizer:
    """One for each Python worker."""
    return WordCachedTokenizer(name)
