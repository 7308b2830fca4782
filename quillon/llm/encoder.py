"""A word-cached front of a ``tokenizers`` model.

White space always ends a pre-token of the models used here, so a text's ids are those of its
blank-separated chunks in order. Chunks repeat, and looking one up is several times faster
than encoding it again. The ids are those of the model itself: what the cache has not seen is
encoded by it.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARKS = ".,;:!?"


class WordEncoder(dict):
    """Maps a chunk to its ids' bytes. ``limit`` bounds the entries, so memory does not grow with
    the input."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.model = Tokenizer.from_file(path)
        self.limit = limit
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [b"", *(self._ask(m) for m in _MARKS)]
        self.mark_of = np.zeros(256, dtype=np.int64)
        for i, m in enumerate(_MARKS):
            self.mark_of[ord(m)] = i + 1
        probes = ("The", "USER", "Xyzzy", "Qwertly")
        # a lower-casing model gives a word and its capitalised form the same ids
        self.folds = all(self._ask(w) == self._ask(w.lower()) == self._bare(w.lower()) for w in probes)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _ask(self, text: str) -> bytes:
        return self._bytes(self.model.encode(text, add_special_tokens=False).ids)

    def _bare(self, word: str) -> bytes:
        """A lower-case ASCII word, which needs no normalising."""
        return self._bytes([t.id for t in self.model.model.tokenize(word)])

    def __missing__(self, chunk: str) -> bytes:
        plain = self.folds and chunk.isascii() and chunk.isalpha() and chunk.islower()
        got = self._bare(chunk) if plain else self._ask(chunk)
        if len(self) < self.limit and len(chunk) < 64:
            self[chunk] = got
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, where each begins and the last ends), without special tokens.

        Chunks are numbered by Arrow, so each distinct one is looked up once a batch.
        """
        plain = pc.replace_substring(texts, "\n", " ")
        if self.folds and not pc.any(pc.match_substring(plain, "<|")).as_py():  # special tokens are case-sensitive
            plain = pc.ascii_lower(plain)
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        core, tail = self._halves(coded.dictionary)
        words = core.dictionary.to_pylist()
        parts = [*(itemgetter(*words)(self) if len(words) > 1 else [self[w] for w in words]), *self.marks]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64) // self.dtype.itemsize
        begins = np.concatenate(([0], ends))
        table = np.frombuffer(b"".join(parts), dtype=self.dtype)
        both = np.stack((core.indices.to_numpy(zero_copy_only=False), len(words) + tail), 1)
        code = both[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        n = np.diff(begins)[code]
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = table[np.repeat(begins[:-1][code] - stop[:-1], n) + np.arange(stop[-1])]
        return ids, stop[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]

    def _halves(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Each word as a core, and the number of the mark that follows it (0: none). A single
        mark after plain letters is a pre-token of its own; any other word is its own core."""
        cut = pc.ascii_rtrim(words, _MARKS)
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(cut)), 1)
        if not self.folds:
            one = pa.array(np.zeros(len(words), dtype=bool))
        split = pc.and_(one, pc.match_substring_regex(cut, "^[a-z]+$"))
        last = np.frombuffer(words.buffers()[2] or b"\0", dtype=np.uint8)[np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset + 1 : words.offset + 1 + len(words)] - 1]
        tail = np.where(split.to_numpy(zero_copy_only=False), self.mark_of[last], 0)
        return pc.if_else(split, cut, words).dictionary_encode(), tail


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    return WordEncoder(path)
