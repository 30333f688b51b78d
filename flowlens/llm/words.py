"""Words of a text, and hashes of words, as the operators share them inside tasks.

A word is a run of `[^\\x20\\x09-\\x0D]`; on UTF-8 bytes these are exactly the pieces of `bytes.split()`.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


class Memo(dict):
    """Remembers a function of a word. `trim()` between texts keeps it under about `most` bytes, long words counted by their
    length. A memo belongs to one call of a task's function and ends with it: workers serve many stages."""

    #: What an entry takes besides its letters: two small objects and the table's slot.
    ENTRY = 200

    def __init__(self, function, most: int = 24_000_000):
        self.function, self.most, self.held = function, most, 0

    def __missing__(self, key):
        value = self[key] = self.function(key)
        self.note(key, value)
        return value

    def note(self, key, value) -> None:
        self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, (bytes, str)) else 64 * len(value) if isinstance(value, (list, tuple)) else 0)

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


def slices(batch, most_rows: int = 256):
    """A record batch in parts of `most_rows` rows, so that only those are Python objects at a time."""
    for low in range(0, batch.num_rows, most_rows):
        yield batch.slice(low, most_rows)


def word_bytes(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8. lower: only A-Z are lower-cased. A null text has none."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX1
    x = x ^ (x >> _SHIFT)
    x = x * _MIX2
    return x ^ (x >> _SHIFT)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words; order within the run counts."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out) + hashes[k : n + k]
    return mix(out)


def shingle_set(words: list[bytes], width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. With fewer words than `width` the whole sequence is the one
    shingle; without words the set is empty."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return window_hashes(np.append(hashes, np.uint64(len(words))), len(words) + 1)
    return np.unique(window_hashes(hashes, width))
