"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never joins what it separates, so a text's ids are those of its
white-space words in order. Words repeat, so each worker keeps the ids of those it has met.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Python also splits at these; the tokenizer doesn't, so texts that hold them are encoded directly.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
MAX_CACHED = 500_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Ids of texts as ``uint32`` arrays; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str | None = None, max_cached: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path or default_path()
        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model
        self.max_cached = max_cached
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        self.byte_text = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_text)
            found = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        return found

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word.lower()) if len(word) < 200 else None
        if not plain or not (word.isascii() or word[0].lower() == word.lower()[0]) or len(word.lower()) != len(word):
            return self._direct(word)
        stem, marks = plain.groups()
        return self._part(stem) + (self._part(marks) if marks else b"")

    def encode_bytes(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._direct(text)
        words, known = text.split(), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > self.max_cached:
            known.clear()
        if len(self.parts) > self.max_cached:
            self.parts.clear()
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))

    def forget(self) -> None:
        """Frees what is cached."""
        self.words, self.parts = {}, {}

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str | None = None) -> TextEncoder:
    """One encoder a worker process, so that its cache serves all its tasks."""
    key = path or default_path()
    if key not in _encoders:
        _encoders[key] = TextEncoder(key)
    return _encoders[key]
