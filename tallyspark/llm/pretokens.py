"""Pre-token patterns of the public tokenizers for texts of common Latin characters.

The tokenizers split on Unicode letters, numbers and white space. For texts whose characters
all lie below U+0180 the same classes are spelt out from the Unicode categories, so Python's
``re`` can split them; other texts go through the library's own splitter.
"""

from __future__ import annotations

import re
import unicodedata

_LIMIT = 0x180
_CHARS = [chr(c) for c in range(_LIMIT)]


def _class(test) -> str:
    return "".join(re.escape(c) for c in _CHARS if test(c))


LETTERS = _class(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = _class(lambda c: unicodedata.category(c)[0] == "N")
SPACES = _class(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
_HEAD = "'s|'t|'re|'ve|'m|'ll|'d"

BYTE_LEVEL = re.compile(
    f"{_HEAD}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_LEVEL = re.compile(f"{_HEAD}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
# U+0130 lower-cases to two characters, the second outside the classes.
UNCOMMON = re.compile("[^\x00-įı-ſ]")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others in turn for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
