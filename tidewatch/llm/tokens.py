"""Token ids of whole texts by a public tokenizer file.

The tokenizer drops white space and never joins characters across it, and it
splits text into runs of letters, single digits and runs of other characters
before anything else.  So a text's ids are those of its words (cut at ASCII white
space) one after the other, and a word of ASCII and Latin-1 letters has the ids of
its lower-cased runs.  Each worker keeps the ids of the words and runs
it has met, as little-endian unsigned 32-bit bytes.  A new run goes to the
tokenizer library's model, which is all that the library does to a lower-case run
but for writing its bytes as characters; a word with an apostrophe (contractions
split otherwise) or other characters goes to the library as it is.  When the memory
is full a new one begins; words that the last one holds move over as they come up again.
Texts that hold the opening of a special token go to the library as a whole.

Defined cases: null, empty and blank texts have no ids; bytes that are no UTF-8
count as U+FFFD.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

END_ID = 1
_KEEP = 500_000
_SPECIAL = b"<|"
_PLAIN = re.compile(r"[\t-\r !-&(-~À-ÖØ-öø-ÿ]*")
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_level() -> dict[int, int]:
    """The library's characters for bytes: those that print stand for themselves, the others follow from 256 on."""
    others = [*range(33), *range(127, 161), 173]
    return {b: 256 + i for i, b in enumerate(others)}


class _Memory(dict):
    """Ids of words as bytes; a word that is looked up and not there is encoded."""

    def __init__(self, tokenizer):
        self.model, self.tokenizer = tokenizer.model, tokenizer
        self.older: dict[bytes, bytes] = {}
        self.characters = _byte_level()

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KEEP:
            self.older = self.copy()
            self.clear()
        if (ids := self.older.get(word)) is None:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def encoded(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not (text.isascii() and text.isprintable() and "'" not in text or _PLAIN.fullmatch(text)):
            return self.whole(text)
        lower = text.lower()
        runs = [lower] if lower.isalpha() else _RUN.findall(lower)
        if runs != [text]:
            return b"".join([self[r.encode()] for r in runs])
        said = text if len(text) == len(word) else word.decode("latin-1").translate(self.characters)
        return _pack([t.id for t in self.model.tokenize(said)])


class Encoder:
    """``encode_many(texts)``: the ids of UTF-8 texts as bytes, without an end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.words = _Memory(self.tokenizer)

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        of = self.words.__getitem__
        return [self.words.whole(t.decode("utf-8", "replace")) if t and _SPECIAL in t else b"".join(map(of, t.split() if t else ())) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
