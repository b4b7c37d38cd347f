"""Encoding with public tokenizers by chunks between white space, each distinct chunk once."""

from __future__ import annotations

import re
from array import array

import numpy as np
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
WORD_BPE = tokenizer_path("word_bpe_49k.json")
#: Chunks that a worker keeps at least; it keeps up to twice as many.
CACHE = 400_000
LONGEST_KEPT = 48
#: Unicode's White_Space, which the tokenizers' own patterns mean by white space.
_SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: UTF-8 of white space beyond single blanks and line ends between words (or how it begins).
_UNUSUAL = [b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: Letters whose class, composition and lower case are the same in every Unicode version.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Chunks of these letters and visible ASCII, perhaps after a blank.
_PLAIN = re.compile(rf" ?[{_LETTERS}!-~]+").fullmatch
#: The characters by which byte-level vocabularies write bytes: visible Latin-1 as it is, the rest from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_BLANK = _VISIBLE[0x20] = chr(_VISIBLE[0x20])


class _Cache(dict):
    """Ids by chunk in two generations: when the new one is full, it becomes the old one."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Encoder:
    """UTF-8 text to little-endian unsigned 32-bit ids, equal to encoding the text whole.

    A text that spells a special token is encoded whole, as white space beside one is split otherwise.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: bytes) -> bytes:
        return _bytes(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return self.whole(text) if any(s in text for s in self.special) else self.chunked(text)


    def parts(self, parts: list[str]) -> bytes:
        """Ids of what the tokenizer splits a chunk into, without its splitting."""
        tokenize, ids = self.model.tokenize, array("I")
        for part in parts:
            shown = part.replace(" ", _BLANK) if part.isascii() else part.encode().decode("latin-1").translate(_VISIBLE)
            ids.extend([t.id for t in tokenize(shown)])
        return ids.tobytes()


class WordEncoder(_Encoder):
    """For tokenizers that drop white space: chunks are the runs without ASCII white space."""

    #: How a chunk of plain characters, in lower case, is split.
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.cache = _Cache(self.encode)

    def encode(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        return self.parts(self.split(word.lower())) if _PLAIN(word) else self.whole(chunk)

    def chunked(self, text: bytes) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.split()))


class ByteEncoder(_Encoder):
    """For byte-level tokenizers that put a single blank with the word after it."""

    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_LETTERS}0-9 ]+").findall

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.plain = _Cache(self.encode)
        self.spaced = _Cache(lambda chunk: self.encode(b" " + chunk))
        self.line_end = self.whole(b"\n")

    def encode(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        return self.parts(self.split(word)) if _PLAIN(word) else self.whole(chunk)

    def chunked(self, text: bytes) -> bytes:
        if text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n") or any(x in text for x in _UNUSUAL):
            return b"".join(self.plain[c.encode()] for c in _CHUNK.findall(text.decode()))
        plain, spaced, out = self.plain, self.spaced.__getitem__, []
        for line in text.split(b"\n"):
            first, *rest = line.split(b" ")
            out += (plain[first], *map(spaced, rest), self.line_end)
        return b"".join(out[:-1])


_KINDS = {"byte": ByteEncoder, "word": WordEncoder}
_ENCODERS: dict[tuple[str, str], _Encoder] = {}


def encoder(path: str, kind: str) -> _Encoder:
    """This worker's encoder."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = _KINDS[kind](path)
    return _ENCODERS[path, kind]
