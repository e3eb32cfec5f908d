"""Exact ids of a tokenizers file, with each worker encoding a distinct pre-token only once.

A tokenizer without merges across pre-tokens gives a text the ids of its pre-tokens, one after the other. The library
encodes the pre-tokens that a worker has not seen yet; all others come from a table of bounded size. That holds where the split into pre-tokens is certain: texts with rarer characters (where Unicode tables of two
libraries could differ) or with a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np

from tidegraph.llm.common import held

#: Characters on which normalization, case and character classes are beyond doubt, as ranges.
_RANGES = [(0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
_SPACES = re.compile("[\t\n\r ]+")
#: Pre-tokens of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT, AT_ONCE = 500_000, 200_000


def _class(codes: list[int]) -> str:
    """Inside of a character class."""
    edges = [k for k in range(len(codes)) if k == 0 or codes[k] != codes[k - 1] + 1]
    return "".join(rf"\u{codes[a]:04x}-\u{codes[z - 1]:04x}" for a, z in zip(edges, [*edges[1:], len(codes)]))


def _codes() -> list[int]:
    """The characters of the ranges whose small letters lie within them too: a folded text has no others."""
    every = [c for a, z in _RANGES for c in range(a, z + 1)]
    inside = set(every)
    return [c for c in every if inside.issuperset(map(ord, chr(c).lower()))]


_CODES = _codes()
PLAIN = re.compile(f"[{_class(_CODES)}]*")


def plain_pattern(pattern: str) -> re.Pattern:
    r"""``pattern`` for texts of plain characters only: \p{L} and \p{N} are spelt out, which the faster library needs.

    Both classes must stand within brackets or are put there.
    """
    for kind in "LN":
        inside = _class([c for c in _CODES if unicodedata.category(chr(c))[0] == kind])
        pattern = re.sub(rf"\[(\^?[^\]]*)\\p\{{{kind}\}}", lambda m: f"[{m[1]}{inside}", pattern).replace(rf"\p{{{kind}}}", f"[{inside}]")
    return re.compile(pattern)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def encoder(path: str) -> "Encoder":
    """One per worker and file."""
    return held("tokenization", path, lambda: Encoder(path))


class Encoder:
    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kept = Tokenizer.from_file(path), kept
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern, self.fold = self._split(spec)
        self.table: dict[str, bytes] = {}
        self.shown = dict(enumerate(byte_characters()))

    @staticmethod
    def _split(spec: dict) -> tuple[re.Pattern | None, bool]:
        """The pattern of pre-tokens, and whether texts are lower-cased with single spaces first; None if neither form is known."""
        before, split = spec["normalizer"], spec["pre_tokenizer"] or {}
        if before is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            return plain_pattern(BYTE_LEVEL), False
        parts = split.get("pretokenizers", [])
        if before and [n["type"] for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            replace = before["normalizers"][1]
            first, second = parts
            if replace["pattern"] == {"Regex": r"\s+"} and replace["content"] == " " and first["behavior"] == "Removed" and first["invert"] and not second["use_regex"] and not second["add_prefix_space"]:
                return plain_pattern(first["pattern"]["Regex"]), True
        return None, False

    @property
    def id_type(self) -> str:
        return "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"

    def ids(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.pattern is None or any(s in text for s in self.special) or not PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.fold:
            text = _SPACES.sub(" ", text).lower()
        if len(text) <= AT_ONCE:
            return self._known(self.pattern.findall(text))
        return b"".join(map(self._known, self._slices(text)))

    def _slices(self, text: str) -> Iterator[list[str]]:
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            yield part

    def _known(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self.table.__getitem__, parts))
        except KeyError:
            pass
        fresh = list(set(parts).difference(self.table))
        if len(self.table) + len(fresh) > self.kept:
            self.table.clear()
            fresh = list(set(parts))
        model, shown = self.library.model, self.shown
        for part in fresh:  # both tokenizers spell the bytes of a pre-token as characters before their model sees it
            ids = [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(shown))]
            self.table[part] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.table.__getitem__, parts))
