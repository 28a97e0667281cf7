"""Byte-level word splitting and hashing shared by the corpus kernels."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; bytes.split() parts at just these six bytes."""
    return text.lower().split() if text else []


#: Fixed table: A-Z to lower case, digits, a-z and all bytes of non-ASCII characters as they are, the rest to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by spaces; of the whole sequence if there are fewer; none for no words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    cuts = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, n)


class WordHash(dict):
    """Memo of 64-bit word hashes; it starts anew when large, so memory stays bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
