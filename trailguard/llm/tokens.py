"""Token ids of whole texts by a tokenizers file, with a bounded memory of words."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin letters with closing marks: lower-casing and the letter pattern leave its parts as they are, so its
#: ids are those that the model gives the parts.
_LATIN, _MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Words, and words without their marks, that a worker remembers; longer ones than this are not remembered.
WORDS, STEMS, LONGEST = 400_000, 700_000, 64
#: Byte-level tokenizers write bytes that don't print as these code points: fixed by the published vocabulary format.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class _Memory(dict):
    """Remembers what `make` returns, in two generations: the older half is in `old`."""

    def __init__(self, make, most: int) -> None:
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """The library's ids of texts. White space never is within a token of a tokenizer that drops it, so a text's ids are
    those of its words, end to end; `drops_space` tells this kind, any other encodes each text at once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.words, self.stems = _Memory(self.word, WORDS), _Memory(self.stem, STEMS)
        probe = "Alle Éa, b.\n\tcd;  e"
        self.drops_space = self.whole(probe) == b"".join(map(self.whole, probe.split()))
        self.plain, self.lowers = False, self.whole("ABZ aB") == self.whole("abz ab")
        if self.drops_space:
            probes = "Alle", "Éa,", "bodyß.;", "don&&&"
            whole, self.plain = [self.whole(w) for w in probes], True
            self.plain = whole == [self.word(w.encode()) for w in probes]

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def stem(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return self.packed([t.id for t in self.tokenize(part)])

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain:
            letters = text.rstrip(_MARKS)
            if letters.isalpha() and (letters.isascii() or _LATIN.fullmatch(letters)):
                ids = self.stems[letters.lower()]
                return ids if len(letters) == len(text) else ids + self.stems[text[len(letters) :]]
        return self.whole(text)

    def text(self, text: bytes) -> bytes:
        """Ids of a whole text (UTF-8), as little-endian bytes of dtype."""
        if not self.drops_space:
            return self.whole(text.decode())
        words = self.words
        if self.lowers and b"<|" not in text:  # fewer words to remember; not where it could make a special token
            text = text.lower()
        return b"".join([words[w] for w in text.split()])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path in a worker: what it remembers serves all tasks of that worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
