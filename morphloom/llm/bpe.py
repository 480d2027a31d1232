"""Byte-level BPE ids from the ``tokenizers`` library, with an exact cache of pieces.

The pre-tokenizer of a byte-level BPE cuts a text before a single blank between non-blanks
and around a single newline between non-blanks, and between a letter or digit and the
punctuation after it, whatever the neighbours are; a run of punctuation is never cut. Pieces
between such cuts are encoded once by the library and remembered; the new words of a text are
encoded in one call. Texts with
other white space, with runs of it, or with the text of an added token go to the library
whole. Long pieces are never remembered and the cache is bounded: when it is full, the
half learnt last goes, since frequent words are met early.
"""

from __future__ import annotations

import ctypes
import gc
import os
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

#: Pieces remembered: some 200 MB a worker at most. A caller that has less passes fewer.
CACHE_ENTRIES = 1_200_000
LONGEST_CACHED = 48
#: White space but a blank and a newline: each is looked for by itself, a class of a pattern takes ten times as long.
OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_BLANKS = [c for c in OTHER_BLANKS if c.isascii()]
_BLANK = "\u0120"  # how a byte-level vocabulary spells a blank


class ByteBpe:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one text at a time: threads would only idle
        from tokenizers import Tokenizer

        self._entries = entries
        self._tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._unsafe = ["  ", " \n", "\n ", "\n\n\n", *added]
        self._pieces: dict[str, bytes] = {}  # a blank and this piece
        self._starts: dict[str, bytes] = {"": b""}  # the first piece of a line
        self._tails = {c: self.plain(c) for c in ".,;:!?"}
        self._closed: dict[str, bool] = {}
        self._newline = self.plain("\n")
        self._newline_id = int.from_bytes(self._newline, "little")
        spelled = self._tokenizer.get_vocab(with_added_tokens=True)
        self._blank_first = np.zeros(max(spelled.values()) + 1, bool)
        self._blank_first[[i for token, i in spelled.items() if token[0] == _BLANK]] = True

    def plain(self, text: str) -> bytes:
        """The library's ids of a text as little-endian unsigned 32-bit integers."""
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _closes(self, c: str) -> bool:
        """Whether the library cuts between this character and the punctuation after it."""
        if c not in self._closed:
            self._closed[c] = c.isalnum() and len(self._tokenizer.pre_tokenizer.pre_tokenize_str(c + ".")) == 2
        return self._closed[c]

    def _encode_words(self, words: list[str], before: str) -> list[bytes]:
        """Each word's ids, from one call for all: a word's first id, and no other, has the blank."""
        [found] = self._tokenizer.encode_batch_fast([(before or "\n") + (before or "\n").join(words)], add_special_tokens=False)
        raw = array("I", found.ids).tobytes()
        ids = np.frombuffer(raw, "<u4")
        cuts = np.flatnonzero(self._blank_first[ids] if before else ids == self._newline_id)
        if len(cuts) != len(words):  # not one pre-token a word after all
            return [self.plain(before + w) for w in words]
        starts = (4 * cuts).tolist() if before else (4 * cuts + 4).tolist()
        ends = [*(4 * cuts[1:]).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(starts, ends)]

    def _learn(self, cache: dict[str, bytes], pieces: set[str], before: str) -> None:
        tails = self._tails
        core = {p: p[:-1] if p[-1] in tails else p for p in pieces}
        new = [w for w in dict.fromkeys(core.values()) if w not in cache and w.isalpha()]
        if new:
            cache.update(zip(new, self._encode_words(new, before)))
        for p, w in core.items():
            if p is not w:
                ids = cache.get(w) if w and self._closes(w[-1]) else None
                cache[p] = self.plain(before + p) if ids is None else ids + tails[p[-1]]
            elif p not in cache:
                cache[p] = self.plain(before + p)

    def _bound(self, cache: dict[str, bytes], learnt: set[str]) -> None:
        for p in learnt:
            if len(p) > LONGEST_CACHED:
                cache.pop(p, None)
                cache.pop(p[:-1], None)
        if len(cache) > self._entries:
            for p in list(islice(reversed(cache), self._entries // 2)):
                del cache[p]

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in (_ASCII_BLANKS if text.isascii() else OTHER_BLANKS)) or any(a in text for a in self._unsafe) or text.endswith((" ", "\n\n")):
            return self.plain(text)
        lines = [line.split(" ") for line in text.split("\n")]
        heads = [line.pop(0) for line in lines]
        pieces, starts = self._pieces, self._starts
        missing = set().union(*lines).difference(pieces)
        if missing:
            self._learn(pieces, missing, " ")
        fresh = set(heads).difference(starts)
        if fresh:
            self._learn(starts, fresh, "")
        newline, get, out = self._newline, pieces.__getitem__, []
        for head, line in zip(heads, lines):
            out += (newline, starts[head])
            out.extend(map(get, line))
        ids = b"".join(out[1:])
        self._bound(pieces, missing)
        self._bound(starts, fresh)
        return ids


_LOADED: dict[tuple[str, int], ByteBpe] = {}


def give_back() -> None:
    """Return what earlier tasks of this worker process freed to the system: workers live on between operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def load(path: str, entries: int = CACHE_ENTRIES) -> ByteBpe:
    """One encoder for each worker process, vocabulary and size."""
    if (path, entries) not in _LOADED:
        _LOADED.clear()
        give_back()
        _LOADED[path, entries] = ByteBpe(path, entries)
    return _LOADED[path, entries]


def unload() -> None:
    """Drop the encoders of this worker process: it serves other operators now."""
    if _LOADED:
        _LOADED.clear()
    give_back()
