"""Cutting a text into the pieces that a byte-level tokenizer encodes one by one."""

from __future__ import annotations

import re
from functools import cache

import public_tokenizers
import regex

# Letters and digits that the tokenizer library's character tables do not know yet,
# and a character of the same kind (other than letter, digit or space) to stand for them.
UNKNOWN_LETTERS = [
    (0x11DE0, 0x11DE9),
    (0x1246F, 0x1246F),
    (0x12475, 0x1247F),
    (0x12550, 0x12686),
    (0x16FF4, 0x16FF6),
]
UNKNOWN = {n: "\U0010ffff" for first, last in UNKNOWN_LETTERS for n in range(first, last + 1)}
_PIECES = regex.compile(public_tokenizers.PATTERN)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_UNKNOWN = re.compile("[" + "".join(map(chr, UNKNOWN)) + "]")


def _ranges(kind: str) -> str:
    """The characters below U+10000 of a kind, as the inside of a character class."""
    wanted, found = regex.compile(kind), []
    for n in range(0x10000):
        if not 0xD800 <= n < 0xE000 and wanted.match(chr(n)):
            if found and found[-1][1] == n - 1:
                found[-1][1] = n
            else:
                found.append([n, n])
    return "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in found)


@cache
def _basic() -> re.Pattern:
    """The same pattern for texts without characters above U+FFFF, with its classes spelled out: tables
    of this kind are looked up several times as fast."""
    pattern = public_tokenizers.PATTERN
    outside = "[^" + _ranges(r"\s") + _ranges(r"\p{L}") + _ranges(r"\p{N}") + "]"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", outside)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(kind, f"[{_ranges(kind)}]")
    return re.compile(pattern.replace(r"\S", f"[^{_ranges(chr(92) + 's')}]"))


def byte_level() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: bytes that print stand for
    themselves, the others follow from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in printing]
    return {byte: chr(byte) for byte in printing} | {byte: chr(256 + n) for n, byte in enumerate(hidden)}


def special_tokens(described: dict) -> regex.Pattern:
    """Finds the special tokens of a tokenizer file, which are taken out before a text is cut."""
    contents = [token["content"] for token in described["added_tokens"]]
    return regex.compile("|".join(map(regex.escape, contents)) or r"(?!)")


def split(text: str) -> list[str]:
    """The pieces of a text without special tokens; put together, they are the text."""
    if text.isascii() or not _BEYOND.search(text):
        return _basic().findall(text)
    if not _UNKNOWN.search(text):
        return _PIECES.findall(text)
    spans = (m.span() for m in _PIECES.finditer(text.translate(UNKNOWN)))
    return [text[start:end] for start, end in spans]
