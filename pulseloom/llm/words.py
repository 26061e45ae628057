"""Words of a text as bytes: maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

_KEPT = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))

#: Each byte of UTF-8: lower-cased where it is A-Z, a blank where it belongs to no word.
FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; None has none."""
    return text.translate(FOLD).split() if text else []
