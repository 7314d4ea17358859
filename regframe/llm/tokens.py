"""Exact token ids of long texts by way of worker caches.

A byte-pair tokenizer never merges across a change from a printing character
to white space. A text is therefore cut there into short units, and the ids of
a text are the ids of its units in order. Units repeat, so a bounded cache in
each Python worker answers most of them; the tokenizer's library answers the
rest. Texts in which such cuts would not be safe (special-token strings, the
separators U+001C-U+001F) are given to the library whole. One pass of the pre-token
pattern over a text of plain letters gives its words, and only words are cached.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import regex

CACHE_UNITS = 1 << 17  # units held per cache generation and worker

_RUNS = re.compile(r"\s*\S+|\s+")
_UNSAFE = re.compile("[\x1c-\x1f]")
_PLAIN_END = "ɐ"  # below it, case and normal form agree in every Unicode version
_LATIN_END = "ƀ"  # below it, lower case stays below it, but for U+0130
_BEYOND = re.compile(f"[{_LATIN_END}-\U0010ffff\u0130]")
_CLASS = re.compile(r"\\p\{(L|N)\}")


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printing Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pre-token pattern for texts below ``_LATIN_END``, with its letter and number classes spelled out.

    None for patterns with such a class outside brackets.
    """
    if _CLASS.search(re.sub(r"\[[^\]]*\]", "", pattern)):
        return None

    def spelled(match: re.Match) -> str:
        return "".join(re.escape(chr(c)) for c in range(ord(_LATIN_END)) if unicodedata.category(chr(c))[0] == match[1])

    return re.compile(_CLASS.sub(spelled, pattern))


class Generations(dict):
    """A cache of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, size: int = CACHE_UNITS):
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Ids of whole texts as ``tokenizers`` gives them, without added special tokens.

    ``space_prefix`` marks byte-level vocabularies whose units begin with the
    white space before them; other vocabularies drop white space.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.specials = [t.content.lower() for t in added.values()]
        import json
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.space_prefix = spec["normalizer"] is None
        pre = spec["pre_tokenizer"]
        if self.space_prefix:
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        else:
            split = next(p for p in pre["pretokenizers"] if p["type"] == "Split")
            self.pattern = regex.compile(split["pattern"]["Regex"])
        self.plain = plain_pattern(_BRACKETED if self.space_prefix else split["pattern"]["Regex"])
        self._model = self.tok.model
        self._words = Generations(self._word, 4 * cache_units)
        self.units = Generations(self._spaced_unit if self.space_prefix else self._unit, cache_units)

    def _word(self, word: str) -> bytes:
        own = word.isascii() and word.isprintable() and " " not in word  # its bytes stand for themselves
        mapped = word if own else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        words = self.plain_words(unit)
        if words is None and max(unit) < _PLAIN_END:
            words = self.pattern.findall(unit if self.space_prefix else unit.lower())
        if words is not None:
            get = self._words.__getitem__
            return get(words[0]) if len(words) == 1 else b"".join(map(get, words))
        return self.library(unit)

    def _spaced_unit(self, unit: str) -> bytes:
        return self._unit(" " + unit)

    def library(self, text: str) -> bytes:
        """The library's own answer, as little-endian unsigned 32-bit ids."""
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def special(self, text: str) -> bool:
        if _UNSAFE.search(text):
            return True
        if "<" not in text:
            return False
        low = text.lower()
        return any(s in low for s in self.specials)

    def plain_words(self, text: str) -> list[str] | None:
        """The pre-tokens of a text of plain letters, as they are cached; None for other texts."""
        if self.plain is None or _BEYOND.search(text):
            return None
        return self.plain.findall(text if self.space_prefix else text.lower())

    def parts(self, text: str) -> list[str]:
        """Strings whose ids by ``part_ids``, in order, are those of a text without special strings."""
        if (words := self.plain_words(text)) is not None:
            return words
        if not self.space_prefix:
            return text.split()
        if irregular(text):
            return _RUNS.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + unit for unit in rest)]

    def part_ids(self, part: str) -> bytes:
        """Ids of one of ``parts``, by the cache of words or of units."""
        ids = self._words.get(part)
        if ids is not None:
            return ids
        if not _BEYOND.search(part):
            return self._unit(part)
        if not self.space_prefix:
            return self.units[part]
        return self.units[part[1:]] if part[0] == " " else self._unit(part)

    def pieces(self, text: str):
        """Encoded units of a text, in order."""
        if self.special(text):
            return [self.library(text)]
        if (words := self.plain_words(text)) is not None:
            return map(self._words.__getitem__, words)
        if not self.space_prefix:
            return map(self.units.__getitem__, text.split())
        if irregular(text):
            return map(self._unit, _RUNS.findall(text))
        first, *rest = text.split(" ")
        return [self._unit(first), *map(self.units.__getitem__, rest)]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; none for a missing one."""
        return b"".join(self.pieces(text)) if text else b""


# Fixed value: the pre-token pattern of byte-level vocabularies of this family.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                      r"|\s+(?!\S)|\s+")
_BRACKETED = re.sub(r" \?(\\p\{[LN]\})", r" ?[\1]", BYTE_LEVEL_PATTERN)


def irregular(text: str) -> bool:
    """Whether a space touches other white space or either end of the text."""
    return text[0] == " " or text[-1] == " " or _TOUCH.search(text) is not None


_TOUCH = re.compile(r" \s|\s ")

_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file; reused by every task of the worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
