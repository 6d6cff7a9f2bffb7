"""Word splitting on UTF-8 bytes: a word is a run of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Lower-cases A-Z and turns every byte outside words into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in shorter batches, so that what Python makes of them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system: Python workers stay for later tasks, and would keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_chunks(texts: list[bytes | None], most: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` bytes each; a longer text is a chunk of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        grown = size + len(text or b"")
        if grown > most and k > start:
            yield slice(start, k)
            start, size = k, len(text or b"")
        else:
            size = grown
    if start < len(texts):
        yield slice(start, len(texts))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
