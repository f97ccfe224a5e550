"""Python-side helpers that work on Arrow batches inside tasks: words of many texts as one flat numpy array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken apart at once in a task; one longer text is taken by itself.
CHUNK_BYTES = 2_000_000
#: Bytes that separate words of letters and digits; all others, those of UTF-8 sequences too, belong to words.
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def letter_words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and all non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(TO_SPACE).split() if text else []


def chunks(rows: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_BYTES of text each."""
    start = size = 0
    for i, row in enumerate(rows):
        size += len(row or b"")
        if size >= CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: 2^64-odd multiplier of the words' hashes, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    if len(_POWERS.get(factor, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES * 5 // 4), factor, np.uint64)
        steps[0] = 1
        _POWERS[factor] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[factor][:n]


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK_BYTES that end where a word ends."""
    start = 0
    while len(text) - start > CHUNK_BYTES and (cut := re.compile(rb"[\x20\x09-\x0D]").search(text, start + CHUNK_BYTES)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def word_hashes(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words between ASCII white space, A-Z lower-cased, in a row; how many each text has).

    A word's hash is the sum over its bytes of a number for the byte times a power for the place in the word, so it comes from
    running sums over many texts at once."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(rows), np.int64)
    parts = [(i, p) for i, row in enumerate(rows) for p in pieces(row or b"")]
    for a, b in chunks([p for _, p in parts]):
        data = b"\n".join(p for _, p in parts[a:b]).lower() + b"\n"
        codes = np.frombuffer(data, np.uint8)
        blank = _IS_SPACE[codes]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        first, end = edges[0::2], edges[1::2]
        sums = np.cumsum(_OF_BYTE[codes] * _powers(FACTOR, len(codes)), dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        found.append(mixed((sums[end - 1] - before) * _powers(pow(FACTOR, -1, 1 << 64), len(codes))[first]))
        ends = np.cumsum([len(p) + 1 for _, p in parts[a:b]])
        n = np.diff(np.searchsorted(first, ends), prepend=0)
        np.add.at(counts, [i for i, _ in parts[a:b]], n)
    return np.concatenate(found), counts


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one flat array, by the position of their first word."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(FACTOR) + mixed(h[k : len(h) - n + 1 + k])
    return mixed(out)
