"""How a tokenizers file of the ``word_bpe_49k.json`` kind cuts text into words.

NFC, white space to one space, lower case; then the matches of a pattern are
the words, and a word's last symbol ends in ``</w>``.  No word spans white
space, so a text can be cut at white space first.

Letters, digits and lower case follow Python's Unicode tables (15.1 in Python
3.13).  The library's are a little newer: letters of scripts added to Unicode
after that count as symbols here.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

WORD_END = "</w>"


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where printable, else the
    next code point from 256 on (the usual byte-level alphabet)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordRules:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                              if self.special else "(?!)")
        # white space to Python, not to the tokenizer
        self.odd = re.compile("[\x1c-\x1f]")
        self.space = re.compile(r"[^\S\x1c-\x1f]+")
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((p for p in parts if p["type"] == "Split"), None)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known_kind = (split is not None and steps == ["NFC", "Replace", "Lowercase"]
                           and spec["model"].get("end_of_word_suffix") == WORD_END)
        if self.known_kind:
            self.given = split["pattern"]["Regex"]
            self.narrow = re.compile(_spelled_out(self.given, 256))
            self.wide = None

    def between(self, text: str) -> list[str]:
        """The pieces between white space."""
        return self.space.split(text) if self.odd.search(text) else text.split()

    def unknown(self, text: str) -> bool:
        """Whether a text has code points that Python's Unicode tables lack."""
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return any(unicodedata.category(c) == "Cn" for c in set(text))

    def words(self, piece: str) -> list[str]:
        # lower case letter by letter: no special form of a final sigma
        normal = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        try:
            normal.encode("latin-1")
        except UnicodeEncodeError:
            self.wide = self.wide or re.compile(_spelled_out(self.given, sys.maxunicode + 1))
            return self.wide.findall(normal)
        return self.narrow.findall(normal)


def _spelled_out(pattern: str, upto: int) -> str:
    """The pattern for code points below ``upto``, its classes as ranges of
    Python's Unicode tables, for Python's own ``re`` (which scans narrow texts
    fast).  Its white space lacks four control characters of Python's."""
    def those(kind) -> str:
        ranges, start = [], None
        for c in range(upto + 1):
            inside = c < upto and kind(chr(c))
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(ranges)

    space = those(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    return (pattern.replace(r"\p{L}", those(lambda c: unicodedata.category(c)[0] == "L"))
            .replace(r"\p{N}", those(lambda c: unicodedata.category(c)[0] == "N")).replace(r"\s", space))
