"""Exact tokenisation at speed: each distinct chunk of text is encoded once.

The tokenizers library encodes one to two megabytes a second on a core, most of
it for words it has met before.  Where the tokenizer's own splitting rule never
joins what stands before a space with what stands after it, a text can be cut
there, and each distinct chunk needs to be encoded only once by a worker.  The
ids are the library's own; :class:`ChunkEncoder` only remembers them.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

from . import words

#: Unicode's White_Space property, which the tokenizer's \\s stands for.
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space that isn't a safe place to cut: inside a run of white space, or after some at the end.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Units that the byte-level rule never crosses, where cutting at spaces isn't safe.
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Letters of long standing, alike in every version of Unicode and stable under NFC.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f"
_WORD = re.compile(f"[{_LETTERS}]+")
#: Signs that, after a word, are a piece of their own together (an apostrophe may not be, nor ``<``).
_TAIL = ",.!?;:#$%&*"
_LONG = 64
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


_BYTES = {b: letter for b, letter in enumerate(_byte_letters())}


def tokenizer_path(name_or_path: str) -> str:
    """A file's path as it is, or the place of a public tokenizer of that name."""
    if os.path.exists(name_or_path):
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def tokenizer_digest(path: str, settings: str = "no specials, no truncation, no padding") -> str:
    """Hex SHA-256 of the tokenizer's file, the library's version and the settings that change counts."""
    import hashlib
    from importlib.metadata import version

    digest = hashlib.sha256(f"{settings}; tokenizers {version('tokenizers')}".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def _plain(word: str) -> bool:
    """Whether the splitting rule keeps a word together, and apart from a mark after it."""
    return word.isalpha() if word.isascii() else _WORD.fullmatch(word) is not None


class _Kept(dict):
    """A dictionary that makes what it lacks and forgets in two generations.

    What is long, or goes over the end of a line, hardly comes again and isn't kept.
    """

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _LONG or "\n" in key:
                return value
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = self.copy()
            self.clear()


class ChunkEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    A text is cut at spaces where the tokenizer's rule allows it; a chunk that
    is a plain word, with or without marks after it, goes to the library's BPE
    model as it stands, as does each side of one end of a line between two such,
    and any other chunk through the whole library.
    ``limit`` bounds the entries of each generation of what is remembered, so
    memory stays bounded however many distinct words a corpus has.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = [x["content"].lower() for x in spec.get("added_tokens", [])]
        self.kind = self._kind(spec)
        self.chunks = _Kept(self._byte_chunk if self.kind == "byte" else self._word_chunk, limit)
        self.firsts = _Kept(self._library, limit // 8)
        self.heads = _Kept(self._byte_head, limit // 4)
        self.pieces = _Kept(self._piece, limit // 16)
        self.newline = self._piece("\n") if self.kind == "byte" else b""

    @staticmethod
    def _kind(spec: dict) -> str:
        """'byte', 'word', or 'whole' where cutting at spaces isn't known to be safe."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if (spec.get("model") or {}).get("type") != "BPE":
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return "byte"
        steps = pre.get("pretokenizers") or []
        rules = [x.get("type") for x in norm.get("normalizers", [])]
        if (
            [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("invert")
            and steps[0].get("behavior") == "Removed"
            and not steps[1].get("use_regex", True)
            and not steps[1].get("add_prefix_space")
            and rules == ["NFC", "Replace", "Lowercase"]
        ):
            return "word"
        return "whole"

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what the splitting rule keeps together, from the model itself."""
        if piece.isascii():
            piece = piece.replace(" ", "\u0120").replace("\n", "\u010a")
        else:
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _byte_chunk(self, chunk: str) -> bytes:
        """A space and the chunk."""
        word = chunk.rstrip(_TAIL)
        if _plain(word):
            return self._piece(" " + word) if word == chunk else self.chunks[word] + self.pieces[chunk[len(word) :]]
        before, line, after = chunk.partition("\n")
        if line and self._simple(before) and self._simple(after):
            return self.chunks[before] + self.newline + self.heads[after]
        return self._library(" " + chunk)

    def _byte_head(self, chunk: str) -> bytes:
        """A simple chunk at the begin of a line."""
        word = chunk.rstrip(_TAIL)
        return self._piece(word) if word == chunk else self.heads[word] + self.pieces[chunk[len(word) :]]

    def _word_chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAIL)
        if _plain(word):
            low = word.lower()
            own = self._piece(low) if low == chunk else self.chunks[low]
            return own if word == chunk else own + self.pieces[chunk[len(word) :]]
        before, line, after = chunk.partition("\n")
        if line and self._simple(before) and self._simple(after):
            return self.chunks[before] + self.chunks[after]
        return self._library(chunk)

    @staticmethod
    def _simple(chunk: str) -> bool:
        """A plain word, with or without marks after it."""
        return _plain(chunk.rstrip(_TAIL))

    def _one(self, text: str) -> bytes:
        if self.kind == "whole" or (self.marks and "<" in text and any(m in text.lower() for m in self.marks)):
            return self._library(text)
        if self.kind == "word":
            return b"".join(map(self.chunks.__getitem__, text.split(" ")))
        if _UNSAFE.search(text):
            return b"".join(map(self.firsts.__getitem__, _UNITS.findall(text)))
        first, *rest = text.split(" ")
        return self.firsts[first] + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library gives them without special tokens."""
        out = []
        for text in texts:
            out.append(self._one(text))
            self.chunks.turn()
            self.firsts.turn()
            self.heads.turn()
            self.pieces.turn()
        return out


_encoders: dict[str, ChunkEncoder] = {}
words.others.append(_encoders)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file; kept until another operator needs the memory."""
    if path not in _encoders:
        words.forget()
        _encoders.clear()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
