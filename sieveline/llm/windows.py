"""Words of long texts in slices, so that no list holds all of them.

Words are what ASCII white space parts, as bytes. A text is cut behind white space, so no word is cut; a slice is ``SLICE``
characters long, or as long as a word that is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

#: Characters of a slice.
SLICE = 1 << 20
#: Characters of a text whose different words one pass holds.
PASS = 32 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def slices(text: str, size: int | None = None) -> Iterator[bytes]:
    """Consecutive parts of a text in UTF-8; between two of them no word goes on."""
    at, size = 0, size or SLICE
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass")
        at = end


def window_hashes(text: str, size: int, seed: int, step: int | None = None, lower: bool = True) -> Iterator[np.ndarray]:
    """XXH64 of each window of ``size`` words, A-Z lower-case unless told otherwise, joined by spaces, in order and slice by slice; a shorter text is one window, none has none."""
    import xxhash

    before: list[bytes] = []
    any_yet = False
    for part in slices(text, step):
        words = before + (part.translate(_LOWER) if lower else part).split()
        if len(words) >= size:
            whole = b" ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            any_yet = True
            yield np.array([xxhash.xxh64_intdigest(whole[a : b - 1], seed) for a, b in zip(starts, starts[size:], strict=False)], dtype=np.uint64)
            before = words[len(words) - size + 1 :] if size > 1 else []
        else:
            before = words
    if before and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), seed)], dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, in the memory of two copies."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def distinct_words(text: str, step: int | None = None, held_at_once: int = PASS) -> int:
    """How many different words a text has; one pass for every ``held_at_once`` characters, each for its share of the words."""
    import zlib

    passes = len(text) // held_at_once + 1
    if passes == 1:
        return len(set(text.encode("utf-8", "surrogatepass").split()))
    total = 0
    for k in range(passes):
        held: set[bytes] = set()
        for part in slices(text, step):
            held.update(w for w in set(part.split()) if zlib.crc32(w) % passes == k)
        total += len(held)
    return total
