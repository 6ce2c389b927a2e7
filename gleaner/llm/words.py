"""Words of long texts, a bounded stretch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Where a text may be cut for a byte-level pattern: it starts a new match at every single space between two
#: non-spaces. Without white space side by side or at an end, all spaces of a text are such.
DOUBLE = re.compile(r"\s\s")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The white space of the word contracts.
BLANK = re.compile(rb"[\x20\x09-\x0D]")
STRETCH = 1 << 20


def spaced_words(text: str, stretch: int = STRETCH) -> Iterator[list[str]]:
    """Lists of words of a text, cut at safe single spaces only; every word but the first had one space before it."""
    at = 0
    while len(text) - at > stretch and (m := SAFE.search(text, at + stretch)):
        yield _split(text[at : m.start()])
        at = m.end()
    yield _split(text[at:] if at else text)


def _split(text: str) -> list[str]:
    unsafe = text[:1].isspace() or text[-1:].isspace() or DOUBLE.search(text)
    return SAFE.split(text) if unsafe else text.split(" ")


def byte_words(text: str | None, lower: bool = False, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """Lists of the words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; ``lower`` lower-cases A-Z alone."""
    data = text.encode() if text else b""
    if lower:
        data = data.lower()
    at = 0
    while len(data) - at > stretch and (m := BLANK.search(data, at + stretch)):
        yield data[at : m.start()].split()
        at = m.end()
    yield data[at:].split() if at else data.split()


LETTERS = re.compile(r"[^\W\d_]+")
#: Where a text may be cut between runs of letters.
BETWEEN = re.compile(r"[\W\d_]")
#: The charset that words are held in where it has all their letters.
BYTES = "cp1252"
_LOWER = [bytes([b]).decode(BYTES, "replace").lower() for b in range(256)]
#: The lower-case letter of every byte, a space for what is no letter; in Latin-1 the bytes from 0x80 to 0x9F are none.
_FOLDED = b"".join(c.encode(BYTES) if LETTERS.fullmatch(c) else b" " for c in _LOWER)
_TABLES = {"latin-1": _FOLDED[:0x80] + b" " * 0x20 + _FOLDED[0xA0:], BYTES: _FOLDED}


def letter_words(text: str) -> list[bytes] | list[str]:
    """Lower-case letter runs: as bytes of BYTES where it has the text, which is far cheaper than a pattern, else as text."""
    for charset, folded in _TABLES.items():
        try:
            return text.encode(charset).translate(folded).split()
        except UnicodeEncodeError:
            pass
    return LETTERS.findall(text.lower())


def lower_words(text: str | None, stretch: int = STRETCH) -> Iterator[list[bytes] | list[str]]:
    """``letter_words`` of a whole text, a stretch at a time, cut between words."""
    text, at = text or "", 0
    while len(text) - at > stretch and (m := BETWEEN.search(text, at + stretch)):
        yield letter_words(text[at : m.start()])
        at = m.start()
    yield letter_words(text[at:] if at else text)


def spelled(word: bytes | str) -> str:
    return word if isinstance(word, str) else word.decode(BYTES)


def words_in(text: str | None, stretch: int = STRETCH) -> Iterator[list[str]]:
    """Lists of lower-case letter runs of a whole text, cut between words."""
    for words in lower_words(text, stretch):
        yield [spelled(word) for word in words]
