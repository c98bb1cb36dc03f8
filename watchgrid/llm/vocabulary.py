"""Byte-level vocabularies read from public tokenizer files, and the text units that can be cached."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import regex

#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Remembered(dict):
    """What a pure function returned, for the keys seen lately: two generations of at most ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self._make, self._limit, self._older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter by which the vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    letters |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def merge_ranks(path: str) -> dict[tuple[str, str], int]:
    merges = load(path)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(merges)}


def special_ids(path: str) -> dict[str, int]:
    """Strings that the library takes for one token each wherever they stand in a text."""
    return {t["content"]: t["id"] for t in load(path)["added_tokens"]}


def special_split(path: str):
    found = sorted(special_ids(path), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None


def plain_lines(text: str) -> list[list[str]] | None:
    """Lines as lists of words, if single blanks and single line feeds are the only white space; else nothing.

    In such a text no token reaches over a blank's front or over a line feed, so each word can be looked up by itself.
    """
    lines = []
    for line in text.split("\n"):
        words = line.split(" ")
        if words != line.split():
            return None
        lines.append(words)
    return lines
