"""Exact tokenization of whole texts at word-cache speed.

Both public vocabularies cut a text before every space that follows another
character, and between a letter and ASCII punctuation after it, ahead of any
merge: no token crosses such a place. So what lies between can be encoded once
and looked up afterwards, which gives the library's own ids for the whole text
(the tests compare them with the library on random texts). The vocabularies' added
tokens, such as <|endoftext|>, are cut out of a text first and give their own ids,
as they do in the library.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Entries of each of the two generations of the caches of words and of other pieces, and the longest
#: that is kept: about 150 MB at most.
_WORDS, _OTHERS = 350_000, 30_000
_LONGEST = 48
_PIECE = re.compile(r"[ \n]*[^\s]+(?=[ \n]|\Z)|.+?(?<=\S)(?=[ \n])|.+\Z", re.S)
#: Letters that lower-casing and composing treat one by one.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ž]+")
_LETTERS_THEN = re.compile(r"([ \n]*[^\W\d_]+)([!-/:-@\[-`{-~].*)", re.S)


def pieces(text: str) -> list[str]:
    """Cut text before spaces and newlines that follow a non-space character; joined, they are the text."""
    return _PIECE.findall(text)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where visible, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Cache:
    """Two generations of bounded size; what isn't asked for in a whole generation is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self._old = size, {}, {}

    def get(self, key: str, make) -> bytes:
        out = self.new.get(key)
        if out is None:
            out = self._old.get(key)
            if out is None:
                out = make(key)
            if len(key) <= _LONGEST:
                if len(self.new) >= self.size:
                    self._old, self.new = self.new, {}
                self.new[key] = out
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; what is kept in memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self._added = {x["content"]: np.asarray([x["id"]], "<u4").tobytes() for x in made["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._word_ends = bool(made["model"].get("end_of_word_suffix"))
        self._model = self.tokenizer.model
        self._bytes = _byte_letters()
        #: A word here is what follows one space; its ids are those of the space and the word.
        self._words, self._others = Cache(_WORDS), Cache(_OTHERS)

    def _plain(self, piece: str) -> str | None:
        """The form in which the merges alone give a piece's ids, or None if the library's whole path is needed."""
        word = piece.lstrip(" \n") if self._word_ends else piece[1:] if piece[0] == " " else piece
        if not word.isalpha() or self._word_ends and not _SIMPLE.fullmatch(word):
            return None
        return (word.lower() if self._word_ends else piece).encode().decode("latin-1").translate(self._bytes)

    def _made(self, piece: str) -> bytes:
        if plain := self._plain(piece):
            ids = [t.id for t in self._model.tokenize(plain)]
        elif (m := _LETTERS_THEN.fullmatch(piece)) and m[1].lower().strip(" \n").isalpha():
            return self.piece(m[1]) + self.piece(m[2])
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spaced(self, word: str) -> bytes:
        return self._made(" " + word)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece."""
        if piece[0] == " " and piece[1:2] not in ("", " ", "\n"):
            return self._words.get(piece[1:], self._spaced)
        return self._others.get(piece, self._made)

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word, which may hold line ends."""
        return b"".join(map(self.piece, pieces(" " + word))) if "\n" in word else self._words.get(word, self._spaced)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if any(x in text for x in self._added):
            return b"".join(self._added.get(x) or self._between(x) for x in self._cut.split(text) if x)
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens.

        Every single space between two other characters is a cut; a text with a word that is empty or
        ends in white space (spaces in a row, at an end, or beside other white space) is cut by the rule.
        """
        first, *words = text.split(" ")
        found = list(map(self._words.new.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if any(not w or w[-1].isspace() for w in (first, *new)):
            return b"".join(map(self.piece, pieces(text)))
        if new:
            made = map(self._word, new)
            found = [next(made) if x is None else x for x in found]
        return b"".join([*map(self.piece, pieces(first)), *found])


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_batch(column, path: str, end_id: int) -> Iterator[bytes]:
    """For each text of an Arrow column (null: empty): its ids and the end id, as bytes."""
    e, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for text in column.to_pylist():
        yield (e.ids(text) if text else b"") + end
