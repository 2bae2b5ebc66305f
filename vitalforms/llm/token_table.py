"""Tokenising by whole words: a proven table first, merges for the rest.

The tokenizer drops white space, so each run of other characters is tokenised
by itself, and its pattern cuts such a run into pre-tokens.  A vocabulary
string that the library encodes to a single token is proven once, when a
worker starts; a pre-token found there costs a look-up.  Only the others go
through the merges of the library's model, and their ids are remembered up to
a bound.  Texts outside the alphabet for which this cut is known to equal the
library's (rare characters, strings of special tokens) go to the library.
"""

from __future__ import annotations

import os
import re
import struct

REMEMBERED = 600_000  # entries after which a worker forgets what it has learnt; never changes a result
# The pre-token pattern of the vocabulary file, for the alphabet of SAFE.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
SAFE = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00a9\\u00ab\\u00ac\\u00ae-\\u00b1\\u00b4-\\u00b8\\u00bb\\u00bf-\\u012f"
                  "\\u0131-\\u0149\\u014b-\\u017f\\u2010-\\u2027\\u2030-\\u203a\\u20ac\\u2122]*")
_BYTE_CHARS = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    rest = [b for b in range(256) if b not in _BYTE_CHARS]
    return {b: chr(b) for b in _BYTE_CHARS} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Packed little-endian 32-bit ids of texts, equal to the library's."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.proven = self._prove()
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _prove(self) -> dict[str, bytes]:
        """Pre-tokens that alone encode to one token, with the packed id."""
        back = {c: b for b, c in byte_alphabet().items()}
        proven = {}
        for entry in self.library.get_vocab(with_added_tokens=False):
            if entry.endswith("</w>"):
                try:
                    word = bytes(back[c] for c in entry[:-4]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                found = self.model.tokenize(entry[:-4])
                if len(found) == 1:
                    proven[word] = struct.pack("<I", found[0].id)
        return proven

    def _part(self, part: str) -> bytes:
        ids = self.proven.get(part) or self.parts.get(part)
        if ids is None:
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def _word(self, word: str) -> bytes:
        if len(self.words) + len(self.parts) > 2 * REMEMBERED:
            self.words, self.parts = {}, {}
        ids = b"".join(map(self._part, PRE_TOKEN.findall(word)))
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SAFE.fullmatch(text) and not any(s in text for s in self.special):
            known, learn = self.words.get, self._word
            return b"".join([known(w) or learn(w) for w in text.lower().split()])
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


_MADE: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    if path not in _MADE:
        _MADE[path] = WordTokenizer(path)
    return _MADE[path]
