"""Ids of a `tokenizers` file whose pre-tokens never cross white space, word by word.

For a tokenizer that lower-cases, drops white space and never joins letters with marks:
the bytes of a batch are cut at ASCII white space and between ASCII letters and ASCII
marks (but the apostrophe), in numpy; each distinct piece is given to the tokenizer once
and its ids are put back in place. A batch that may hold a special token's string is cut
at white space only and keeps its case.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from . import text as X

CACHED_WORDS = 1_500_000  # words a worker remembers, 30 to 40 bytes each
SPECIAL = b"<|"
# 0 white space, 1 ASCII letters, 2 ASCII marks but the apostrophe, 4 the rest
_kind = np.where(X.SPACE, 0, 4).astype(np.uint8)
_kind[[*range(65, 91), *range(97, 123)]] = 1
_kind[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
# lower-case letters that no normalizer changes beside each other: ASCII, Latin-1, Cyrillic
PLAIN = re.compile("[a-zß-öø-ÿа-џ]+").fullmatch


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, cut also between ASCII letters and marks."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _kind[data]
    word = kind > 0
    cut = kind[1:] * kind[:-1] == 2
    edge = offsets[(offsets > 0) & (offsets < n)]
    cut[edge - 1] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut
    last[:-1] &= ~word[1:] | cut
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each comes first, and the number of each hash's own; by a
    hash table, as a sort of all words costs more than the rest of a batch."""
    coded = pa.array(hashes).dictionary_encode()
    word = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[word[::-1]] = np.arange(len(word) - 1, -1, -1)
    return coded.dictionary.to_numpy(), first, word


def _bare(whole: Tokenizer) -> Tokenizer:
    """The same model alone, for PLAIN words with a space between."""
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "),
                                                  pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return bare


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """With room for n values at least, twice as many as before, so that each is copied seldom;
    room that is not written takes no memory."""
    if n <= len(x):
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[:len(x)] = x
    return out


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = _bare(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        # ids that end a pre-token
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Known words by number: the hash of each, and where its ids lie in `flat`; `slots` is
        a hash table of the numbers (-1: free). All have room to spare."""
        self.known = self.end = 0
        self.hashes = np.empty(1024, np.uint64)
        self.at = np.empty(1024, np.int32)
        self.size = np.empty(1024, np.int32)
        self.flat = np.empty(4096, np.uint16 if len(self.is_end) <= 1 << 16 else np.int32)
        self._set_slots(12)

    def _set_slots(self, bits: int) -> None:
        self.slots, self.shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)
        self._put(np.arange(self.known, dtype=np.int32))

    def _put(self, numbers: np.ndarray) -> None:
        """Known words into the first free slots from theirs on."""
        slot = (self.hashes[numbers] >> self.shift).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            # of several for one slot the last stays
            lost = self.slots[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + 1) % len(self.slots)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            i = self.slots[slot]
            taken = i >= 0
            todo, slot, i = todo[taken], slot[taken], i[taken]
            same = self.hashes[i] == hashes[todo]
            out[todo[same]] = i[same]
            todo, slot = todo[~same], (slot[~same] + 1) % len(self.slots)
        return out

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words back to back, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for e in ids for x in e), np.int32, int(size.sum())), size

    def _joined_ids(self, tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters only, each of one pre-token, from one call."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        kind = np.fromiter((0 if PLAIN(w) else 1 if w.isalpha() else 2 for w in words), np.int8, len(words))
        for k, tokenizer in enumerate((self.bare, self.tokenizer, None)):
            own = np.flatnonzero(kind == k)
            for i in range(0, len(own), 4096):
                some = own[i:i + 4096]
                texts = [words[j] for j in some.tolist()]
                self._add(hashes[some], *((self._joined_ids(tokenizer, texts) if tokenizer else None) or self._ids(texts)))

    def _add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n, end = self.known + len(hashes), self.end + len(ids)
        self.hashes, self.at, self.size = _longer(self.hashes, n), _longer(self.at, n), _longer(self.size, n)
        self.flat = _longer(self.flat, end)
        self.hashes[self.known:n], self.size[self.known:n] = hashes, size
        self.at[self.known:n] = self.end + np.cumsum(size) - size
        self.flat[self.end:end] = ids
        new = np.arange(self.known, n, dtype=np.int32)
        self.known, self.end = n, end
        if 2 * n > len(self.slots):
            self._set_slots((2 * n).bit_length())
        else:
            self._put(new)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows back to back, and the n + 1 offsets of the rows."""
        data, offsets = X.byte_view(column)
        if data.tobytes().find(SPECIAL) >= 0:
            starts, ends, _ = X.word_spans(data, offsets)
        else:
            data = X.LOWER[data]
            starts, ends = _pieces(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(column) + 1, np.int64)
        distinct, first, word = _distinct(X.hash_spans(data, starts, ends))
        i = self._find(distinct)
        new = np.flatnonzero(i < 0)
        if len(new):
            if self.known + len(new) > CACHED_WORDS:  # the table starts anew: all words of this batch again
                self._clear()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())], distinct[new])
            i = self._find(distinct)
        i = i[word]
        size = self.size[i]
        counts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.repeat(self.at[i] - counts[:-1], size)
        place += np.arange(len(place))
        return self.flat[place].astype(np.int32), counts[np.searchsorted(starts, offsets)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
