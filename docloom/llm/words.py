"""Words of a text as ASCII-lower-cased UTF-8 bytes.

Working on bytes keeps every step in C: ``bytes.lower`` and ``bytes.translate``
touch A-Z only and ``bytes.split`` cuts at the six ASCII blanks only, so letters
beyond ASCII stay as they are. A null text has no words.
"""

from __future__ import annotations

import re

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_TO_WORDS = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())

#: The same words in the original text, for character offsets.
WORD_SPANS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Words for Spark's regular expressions, before or after lower-casing.
WORD_REGEX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def letter_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def letter_line(text: str | None) -> bytes:
    """The same words still in their places, with a blank for everything between them."""
    return text.encode().translate(_TO_WORDS) if text else b""


def blank_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks."""
    return text.encode().lower().split() if text else []
