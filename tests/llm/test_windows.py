"""Long texts in slices give what whole texts give."""

import random

import numpy as np
import pytest
import xxhash

from sieveline.llm import quality, windows


def texts():
    rng = random.Random(9)
    some = ["a", "B", "ccc", "Ünï", "日本", "x" * 90, "YES", "\x85", "\x1c", "é!"]
    spaces = [" ", "\n", "\t \n", "\x0b\x0c\r", "\n\n"]
    out = ["", " ", "\n \n", "one", "one two three", "a b c d e", "a b c d e f", "   lead", "trail  ", "w" * 500, "a\nb\na\n b\na"]
    for n in (10, 60, 200):
        out.append("".join(rng.choice(some) + rng.choice(spaces) for _ in range(n)))
        out.append(" ".join(rng.choice("ab") for _ in range(n)))
    return out


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("size", [1, 4, 5])
def test_windows(step, size):
    for text in texts():
        words = text.encode().lower().split()
        want = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
        got = [int(h) for part in windows.window_hashes(text, size, 42, step) for h in part]
        assert got == [xxhash.xxh64_intdigest(w, 42) for w in want]
        assert b"".join(windows.slices(text, step)) == text.encode()
        assert [w for s in windows.slices(text, step) for w in s.split()] == text.encode().split()
        for held in (max(1, len(text) // 5), 1 << 20):
            assert windows.distinct_words(text, step, held) == len(set(text.encode().split()))


def test_statistics_in_slices(monkeypatch):
    for step in (1, 16, 200):
        monkeypatch.setattr(windows, "SLICE", step)
        monkeypatch.setattr(quality, "SLICE", step)
        for text in texts():
            assert quality.statistics(text, long=0) == quality.statistics(text)


def test_repeated_places():
    rng = np.random.default_rng(0)
    for n in (0, 4, 5, 6, 50, 300):
        words = [bytes([65 + x]) for x in rng.integers(0, 3, size=n)]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(0, n - 4))], dtype=np.uint64)
        assert quality.repeated_places(hashes) == quality.repeated_words(words)
