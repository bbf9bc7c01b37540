"""Word-cached use of a public tokenizer inside Spark tasks.

The vocabulary file's path is a parameter. Its pieces never span ASCII white space, so
the ids of a text are the ids of its white-space words one after the other; each worker
keeps the words it has met. tests/llm holds the result against the tokenizer itself.
"""

from __future__ import annotations

import re
import struct

#: Words (of at most 64 bytes) that a Python worker remembers.
REMEMBERED = 350_000
#: The pre-tokens of a lower-cased word of ASCII and Latin-1 letters.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SIMPLE = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies use for the bytes 0-255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        """Words of ASCII and Latin-1 letters take the model alone; others the whole tokenizer."""
        text = word.decode("utf-8", "replace")
        if _SIMPLE(text) and "<|" not in text:
            out = []
            for part in _PRE.findall(text.lower()):
                ids = self.parts.get(part)
                if ids is None:
                    ids = self._ids([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_LETTERS))])
                    if len(self.parts) < REMEMBERED and len(part) <= 64:
                        self.parts[part] = ids
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = self._ids(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.known) < REMEMBERED and len(word) <= 64:
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        out = list(map(self.known.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._word(words[i])
        return b"".join(out)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
