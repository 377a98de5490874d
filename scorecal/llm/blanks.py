"""Texts as lower-cased bytes whose words stand between blanks."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20


def lowering(kept: bytes) -> bytes:
    """A table for bytes.translate: A-Z become a-z; ASCII other than ``kept`` and letters becomes a blank.

    Bytes of other characters stay, so UTF-8 stays whole.
    """
    letters = bytes(range(97, 123))
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in kept + letters:
        out[c] = c
    out[65:91] = letters
    return bytes(out)


def pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """Cuts at blanks, of about ``limit`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = text.rfind(b" ", at + 1, at + limit)
        if cut < 0:
            cut = text.find(b" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]
