"""Token ids of whole texts, by the tokenizers library, with a cache of the parts between spaces."""

from __future__ import annotations

import ctypes
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

#: Parts that a worker's cache takes up before it keeps them aside and starts anew, for vocabularies that drop spaces and
#: for those that keep them; it holds twice as many at most, some 70 MB.
CACHE = (300_000, 150_000)
#: Signs whose run may end a part; the run is a word of its own there. No apostrophe: it may begin a suffix.
SIGNS = '.,;:!?#$%&*"-'
PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARACTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Parts(dict):
    """Ids of parts, found when first asked for, or among those kept aside."""

    def __init__(self, find, most: int):
        self.find, self.most, self.aside = find, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.aside.get(part) or self.find(part)
        return ids

    def bound(self) -> None:
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, as encode(text, add_special_tokens=False) of the library gives them. A
    special token's string in a text becomes that token, which is the library's default; with plain it is ordinary text.

    keeps_spaces: a word's id includes the space before it, as in byte-level vocabularies; otherwise white space is
    dropped. A space that stands before another character always starts a new word in both kinds, so the parts between
    such spaces can be encoded one by one. A text with another white space after a space is encoded as a whole, and so
    is one that holds the first two characters of an added token. Where white space is dropped, parts end at line ends
    too, and empty parts have no ids."""

    def __init__(self, path: str, keeps_spaces: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.merges = self.tokenizer.model.tokenize
        marks = [re.escape(m) for m in sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})]
        self.odd = re.compile("|".join([r" \s", " $", *marks] if keeps_spaces else marks or ["(?!)"]))
        self.lead = " " if keeps_spaces else ""
        self.known, self.runs = _Parts(self._part, CACHE[keeps_spaces]), _Parts(self._whole, CACHE[keeps_spaces])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, shown: str) -> bytes:
        ids = [t.id for t in self.merges(shown)]
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """Letters of Latin-1 are one word for the vocabulary's merges, without the steps before them; a line end between
        two words is a word of its own."""
        word = part if part[-1:].isalpha() else part.rstrip(SIGNS)
        if word.isalpha():
            if word.isascii():
                ids = self._word("\u0120" + word if self.lead else word.lower())
            elif max(word) < "\u0100":
                ids = self._word("".join(map(CHARACTERS.__getitem__, (self.lead + word if self.lead else word.lower()).encode())))
            else:
                return self._whole(self.lead + part)
            return ids if len(word) == len(part) else ids + self.runs[part[len(word) :]]
        if self.lead and "\n" in word:
            lines = word.split("\n")
            if all(w.isalpha() and w.isascii() for w in lines[1:]) and lines[0]:
                ids = self.known[lines[0]] + b"".join([self.runs["\n"] + self._word(w) for w in lines[1:]])
                return ids + self.runs[part[len(word) :]] if len(word) < len(part) else ids
        return self._whole(self.lead + part)

    def _text(self, text: str) -> bytes:
        known = self.known
        known.bound()
        self.runs.bound()
        if self.odd.search(text):
            return self._whole(text)
        if not self.lead:
            return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))
        first, *parts = text.split(" ")
        return b"".join([self._whole(first), *map(known.__getitem__, parts)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(t or "") for t in texts]


@lru_cache(2)
def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path, keeps_spaces)


def trim() -> None:
    """Gives freed memory back to the system: worker processes outlive their tasks, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def in_blocks(frames, rows: int = 256):
    """Smaller frames, so that what a step holds besides its input stays small."""
    for pdf in frames:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]
        pdf = None
        trim()


def texts_of(column: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in column]
