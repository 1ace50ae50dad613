"""A public tokenizer applied word by word, with the words' ids remembered."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .common import _REMEMBERED

_OPEN: dict[str, WordTokenizer] = {}
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: How the tokenizer divides lower-cased text, for the characters of Latin-1, which no normalisation joins.
_WORDS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: Latin-1 but the control characters that only Python takes for white space.
_PLAIN = bytes(b for b in range(256) if not 0x1C <= b <= 0x1F)


def _byte_letters() -> dict[int, str]:
    """Latin-1 as byte-level BPE writes it: printable bytes as themselves, the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class WordTokenizer:
    """Ids of whole texts from those of their words, little-endian unsigned 32-bit.

    Made for byte-level BPE with word ends of the ``tokenizers`` library that drops white space, lower-cases and divides words
    as ``_WORDS`` says; tried out when it is opened. Words repeat far more than texts, so most are looked up, at most
    LIMIT of them with their signs and as many without. Texts that aren't Latin-1 go to the tokenizer as they are.
    """

    LIMIT = 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.divide, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        _REMEMBERED.append(self)
        for probe in ("Ab cd's we'll\n\n é 12.5 !!' x²½", " a  b\tc…d ’e "):
            if self.direct(probe) != self.encode(probe):
                raise ValueError(f"{path} divides texts in another way")

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        """One for each file and process."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def clear(self) -> None:
        """Forget the words."""
        self.chunks.clear()
        self.words.clear()

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.LIMIT:
                self.words.clear()
            found = [t.id for t in self.divide(word if word.isascii() else word.translate(self.letters))]
            self.words[word] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            if len(self.chunks) >= self.LIMIT:
                self.chunks.clear()
            self.chunks[chunk] = ids = b"".join(map(self._word, _WORDS.findall(chunk)))
        return ids

    def encode(self, text: str) -> bytes:
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text  # a special token's string is none of its words
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return self.direct(text)
        chunks = text.lower().split()
        got = list(map(self.chunks.get, chunks))
        if None in got:
            learn = self._chunk
            got = [learn(c) if g is None else g for c, g in zip(chunks, got, strict=True)]
        return b"".join(got)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4
