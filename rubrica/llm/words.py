"""Words of whole texts as bytes: A-Z lowered, then runs of ASCII letters, digits and everything beyond ASCII.

Folding keeps every byte's place, so an offset in the folded text is one in the original. A very long
text is cut at spaces into pieces, so what is held of it beside itself is bounded; a single word of any
length stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, functions as F

#: The same words as a regular expression over text whose A-Z were lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT = b"0123456789" + LOWER.encode() + bytes(range(128, 256))
FOLD = bytes(LOWER.encode()[UPPER.encode().index(x)] if x in UPPER.encode() else x if x in _KEPT else 32 for x in range(256))
PIECE = 1 << 20


def raw(text: Column) -> Column:
    """A text's UTF-8 bytes; null: none."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def folded(text: bytes) -> bytes:
    return text.translate(FOLD)


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in order, by pieces of about size bytes."""
    if len(text) <= size:
        yield folded(text).split()
        return
    at, rest = 0, b""
    while at < len(text):
        part = rest + folded(text[at : at + size])
        at += size
        end = part.rfind(b" ") + 1 if at < len(text) else len(part)
        rest = part[end:]
        if end:
            yield part[:end].split()
        else:  # within one long word: read on to its end, piece by piece
            held = [rest]
            while at < len(text):
                more = folded(text[at : at + size])
                stop = more.find(b" ")
                held.append(more if stop < 0 else more[:stop])
                at += len(held[-1])
                if stop >= 0:
                    break
            rest = b""
            yield [b"".join(held)]


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where each word starts and ends."""
    inside = np.frombuffer(folded(text), np.uint8) != 32
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
