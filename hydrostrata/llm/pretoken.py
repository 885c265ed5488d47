"""Byte-level BPE by the distinct pieces of a block of texts.

Texts repeat their words, so a block is cut at single spaces and before a mark that ends a word, each distinct
piece is encoded once, and the ids of all texts are gathered by index. Cutting there is exact for a pattern whose
matches never run from a non-space into a space, nor from a letter or digit into a mark: a match always starts
there. Texts with a space beside other white space are cut by the pattern itself.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import ragged

#: White space besides the space, by Unicode or by Python: beside a space it makes a run.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
_COMMON, _RARE = "\n\t\r", [c for c in _OTHER if c not in "\n\t\r"]
_RARE_ASCII = [c for c in _RARE if c.isascii()]
#: Strings that a worker keeps (one block more at most). Results do not depend on it.
MAX_PIECES = 250_000
_MARK, _ALNUM = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".,;:!?", b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _has_run(text: str) -> bool:
    return "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _COMMON) or any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE))


class _Store:
    """Id lists by number, in growing arrays."""

    def __init__(self) -> None:
        self.starts, self.lens, self.ids, self.n, self.n_ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0

    def add(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """The number of the first list added."""
        first = self.n
        while self.n + len(lens) > len(self.lens):
            self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.lens[first : first + len(lens)] = lens
        self.starts[first : first + len(lens)] = self.n_ids + np.cumsum(lens) - lens
        self.n += len(lens)
        self.n_ids += len(ids)
        return first

    def get(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[idx]
        return self.ids[ragged(self.starts[idx], lens)], lens


class _Kept:
    """Id lists of the strings that a worker keeps: those it meets in a second block, up to MAX_PIECES.

    Which were met before is told by a fixed table of hashes; a chance agreement only keeps a string too early.
    """

    def __init__(self) -> None:
        self.store, self.met, self.n = _Store(), np.zeros(1 << 22, bool), 0
        self.again: list[tuple[list[str], np.ndarray]] = []
        self.at: dict[str, int] = {}

    def add(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The numbers of new strings' lists, good until the block ends."""
        number = self.store.add(ids, lens) + np.arange(len(keys))
        if self.n < MAX_PIECES:
            slot = np.fromiter(map(hash, keys), np.int64, len(keys)) & (len(self.met) - 1)
            keep = self.met[slot]
            self.met[slot] = True
            self.again.append((list(compress(keys, keep.tolist())), number[keep]))
        return number

    def end_block(self) -> None:
        """Drop what was new, but for strings met before."""
        found = [(keys, *self.store.get(number)) for keys, number in self.again]
        self.store.n = self.n
        self.store.n_ids = int(self.store.starts[self.n - 1] + self.store.lens[self.n - 1]) if self.n else 0
        for keys, ids, lens in found:
            first = self.store.add(ids, lens)
            self.n += len(keys)
            self.know(keys, first)
        self.again = []

    def know(self, keys: list[str], first: int) -> None:
        self.at.update(zip(keys, range(first, first + len(keys)), strict=True))


class _KeptWords(_Kept):
    """The same, looked up by Arrow, many at a time."""

    def __init__(self) -> None:
        super().__init__()
        self.known = pa.array([], pa.large_string())

    def know(self, keys: list[str], first: int) -> None:
        self.known = pa.concat_arrays([self.known, pa.array(keys, pa.large_string())])


class PieceEncoder:
    """encode_new: distinct pattern matches to id lists, as the tokenizer at hand encodes them. What a worker keeps does not change results."""

    def __init__(self, pattern: str, encode_new: Callable[[list[str]], list[list[int]]]):
        self.pattern, self.encode_new = regex.compile(pattern), encode_new
        self.words, self.matches = _KeptWords(), _Kept()

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_new(new)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def _of_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The id lists of pattern matches."""
        known = self.matches.at.get
        at = {m: known(m, -1) for m in matches}
        if fresh := [m for m, k in at.items() if k < 0]:
            at.update(zip(fresh, self.matches.add(fresh, *self._encoded(fresh)).tolist(), strict=True))
        return self.matches.store.get(np.fromiter(map(at.__getitem__, matches), np.int64, len(matches)))

    def _of_texts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The id lists of texts, cut by the pattern."""
        own = list(map(self.pattern.findall, parts))
        ids, lens = self._of_matches(list(chain.from_iterable(own)))
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(list(map(len, own)))]).astype(np.int64)]
        return ids, np.diff(ends)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The id lists of distinct words with a space before them."""
        found = pc.index_in(words, value_set=self.words.known)
        number = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if len(miss := np.flatnonzero(number < 0)):
            new = words.take(pa.array(miss)).to_pylist()
            plain = np.fromiter(map(str.isalpha, new), bool, len(new))
            learned = np.empty(len(new), np.int64)
            for own, encode in ((plain, self._encoded), (~plain, self._of_texts)):  # the pattern matches a space with the letters that follow
                keys = list(compress(new, own.tolist()))
                learned[own] = self.words.add(keys, *encode([" " + x for x in keys]))
            number[miss] = learned
        return self.words.store.get(number)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        collects = gc.isenabled()
        gc.disable()  # millions of small strings, no cycles
        try:
            odd = np.fromiter(map(_has_run, texts), bool, len(texts))
            split = pc.split_pattern(pa.array([x for x, run in zip(texts, odd, strict=True) if not run], pa.large_string()), " ")
            words = split.flatten().dictionary_encode()
            offsets = split.offsets.to_numpy().astype(np.int64)
            # The block's id lists: of its distinct words less their marks, of marks, of first words, and of odd texts' matches.
            stems, cut, last = _parted(words.dictionary)
            marks, which = np.unique(last[cut], return_inverse=True)
            heads = words.take(pa.array(offsets[:-1])).to_pylist()
            own = [self.pattern.findall(x) for x, run in zip(texts, odd, strict=True) if run]
            found = [self._of_words(stems.dictionary), self._of_matches(list(map(chr, marks.tolist()))), self._of_texts(heads), self._of_matches(list(chain.from_iterable(own)))]
            ids, lens = (np.concatenate(x) for x in zip(*found, strict=True))
            starts = np.cumsum(lens) - lens
            base = np.cumsum([0, *(len(x[1]) for x in found)])
            # One list for each distinct word, then the others as they are.
            parts = 1 + cut
            at = np.cumsum(parts) - parts
            list_no = np.empty(int(parts.sum()), np.int64)
            list_no[at] = stems.indices.to_numpy()
            list_no[at[cut] + 1] = base[1] + which
            n_words = len(parts)
            list_no, parts = np.concatenate([list_no, np.arange(base[2], base[4])]), np.concatenate([parts, np.ones(base[4] - base[2], np.int64)])
            ids = ids[ragged(starts[list_no], lens[list_no])]
            ends = np.concatenate([[0], np.cumsum(lens[list_no])])[np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)]
            idx = words.indices.to_numpy().astype(np.int64)
            idx[offsets[:-1]] = n_words + np.arange(len(heads))
            counts = np.zeros(len(texts), np.int64)
            counts[~odd], counts[odd] = np.diff(offsets), list(map(len, own))
            if odd.any():
                every = np.empty(int(counts.sum()), np.int64)
                mask = np.repeat(odd, counts)
                every[mask], every[~mask] = n_words + len(heads) + np.arange(base[4] - base[3]), idx
                idx = every
            lens = np.diff(ends)[idx]
            ids = ids[ragged(ends[idx], lens)]
            return ids, np.diff(np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)], prepend=0)
        finally:
            self.words.end_block()
            self.matches.end_block()
            if collects:
                gc.enable()


def _parted(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Of distinct words: what is before a mark that ends them behind a letter or digit, whether there is one, and their last byte."""
    cut, last = np.zeros(len(words), bool), np.zeros(len(words), np.uint8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    if len(data) > 1:
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        at = np.maximum(offsets[1:] - 1, 1)
        last = data[at]
        cut = (np.diff(offsets) > 1) & _MARK[last] & _ALNUM[data[at - 1]]
    return pc.if_else(pa.array(cut), pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode(), cut, last
