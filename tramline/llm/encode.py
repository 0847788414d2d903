"""Token ids of whole texts, with a cache of white-space separated words per Python worker.

The tokenizer file is a parameter.  For the lower-casing word tokenizer a text's ids are
the ids of its words one after the other, so a word seen before costs one look-up.  Words
outside the plain range (controls, special token marks, scripts beyond Latin) go through
the whole tokenizer; plain ones are cut by its own pattern and given to its model.
"""

from __future__ import annotations

import sys
from array import array

import regex

from tramline.llm.common import worker_store

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x7e\xa1-ɏ]+")
#: Letters of the plain range.
LETTER = regex.compile(r"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]")
ENDS = b".,;:!?"
#: The start of special tokens, and the first byte of all marks that join an ASCII letter to one character.
AS_IS = (b"<|", b"\xcc")
CACHED_WORDS = 200_000
#: What the tokenizer must be for words to be independent of each other.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLITTERS = ["Split", "ByteLevel"]
#: The split that ``PIECES`` repeats.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter byte-level tokenizers use for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as this machine's unsigned 32-bit numbers, which must be little-endian")
        self.whole = Tokenizer.from_file(path)
        normaliser, splitter = (json.loads(part.__getstate__()) for part in (self.whole.normalizer, self.whole.pre_tokenizer))
        steps = splitter.get("pretokenizers", [])
        kinds = [n["type"] for n in normaliser.get("normalizers", [])], [p["type"] for p in steps]
        if kinds != (NORMALISERS, SPLITTERS) or steps[0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError(f"{path}: words are not independent under {kinds}, or split in another way")
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.ends: dict[int, bytes] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _word(self, raw: bytes) -> bytes:
        if raw.isalpha():
            return self._tokens(raw.lower().decode())
        word = raw.decode("utf-8", "replace")
        plain = word.isprintable() if word.isascii() else PLAIN.fullmatch(word)
        if not plain or "<|" in word:
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            return self._piece(low)
        return b"".join(map(self._piece, PIECES.findall(low)))

    def _piece(self, piece: str) -> bytes:
        return self._tokens(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))

    def _tokens(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _end(self, mark: int) -> bytes:
        if mark not in self.ends:
            self.ends[mark] = self._piece(chr(mark))
        return self.ends[mark]

    def _miss(self, word: bytes) -> bytes:
        ids = self.young.get(word)
        if ids is not None:
            return ids
        if word[-1] in ENDS and (word[-2:-1].isalpha() or word[-2:-1] > b"\x7f" and LETTER.fullmatch(word.decode("utf-8", "replace").lower()[-2])):
            # A mark after a letter is a piece of its own: a new word is kept without it, one that comes again also with it.
            known = self.young.get(word[:-1])
            if known is None:
                return self._kept(word[:-1]) + self._end(word[-1])
            ids = known + self._end(word[-1])
            self._keep(word, ids)
            return ids
        return self._kept(word)

    def _kept(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._word(word)
        self._keep(word, ids)
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = ids

    def encode(self, text: bytes) -> bytes:
        # Words are lowered here, so that one entry does for all their spellings, unless that could change them: special
        # tokens are not lowered, and a mark over a letter may have its own character with one case only.
        words = (text if any(x in text for x in AS_IS) else text.lower()).split()
        ids = list(map(self.young.get, words))
        if None in ids:
            ids = [self._miss(w) if i is None else i for w, i in zip(words, ids)]
        return b"".join(ids)


def encoder(path: str) -> WordEncoder:
    store = worker_store("encoders")
    if path not in store:
        store[path] = WordEncoder(path)
    return store[path]
