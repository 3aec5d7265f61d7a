"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from sieveline.llm import shingle_links


def survivors(rows):
    """(id, text) of the smallest id of each component, null ids last."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append(r)
    return sorted((min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in best.values()), key=str)


@pytest.mark.parametrize("sample", [10_000, 40])
def test_stage_drops_all_near_copies(spark, monkeypatch, sample):
    monkeypatch.setattr(shingle_links, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary, 12))  # a line that many share
    rows = []
    for _ in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 200)))) + (line.split() if rng.random() < 0.5 else [])
        rows.append(" ".join(words))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(1, 6))):
                copy[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(copy))
    base = list(rng.choice(vocabulary, 150))  # a chain: each step is near the one before it only
    for k in range(8):
        base[k * 18] = base[k * 18 + 9] = f"new{k}"
        rows.append(" ".join(base))
    rows = [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, df, "").collect()), key=str)
    want = survivors(rows)
    assert got == want and len(want) < len(rows) - 20
    assert corpus_pipeline.near_copies(spark, df.filter("1 = 0"), "").count() == 0


@pytest.mark.parametrize(("group", "shingles"), [(4096, 1 << 22), (16, 1 << 22), (4096, 2000)])
def test_group_around_an_outlier(spark, monkeypatch, group, shingles):
    """Many copies of one text, most pairs of them near the limit: what stars miss is found in groups, also in split ones."""
    monkeypatch.setattr(shingle_links, "GROUP", group)
    monkeypatch.setattr(shingle_links, "GROUP_SHINGLES", shingles)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            copy[at] = f"x{rng.integers(10_000)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, df, "").collect()), key=str)
    assert got == survivors(rows) and 1 < len(got) < 80


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (1, 5, 40, 63, 64, 65, 300, 5000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[: int(n * 0.9)], rng.integers(-(1 << 62), 1 << 62, n // 4))))
        x, y = sorted((shingle_links.sketch(a).view(np.uint64), shingle_links.sketch(b).view(np.uint64)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_links_are_looked_for_by_simhash_first(spark):
    """Fingerprints within the radius of the trees, and equal ones, give pairs of nodes; the stage verifies them."""
    each = spark.createDataFrame([(1, 0), (2, 0), (3, 0b1111), (4, 0b11111 << 40), (5, -1)], "node long, fp long")
    got = {(r.a, r.b) for r in shingle_links._fingerprint_pairs(each).collect()}
    assert got == {(1, 2), (1, 3)}


def test_stage_calls_the_trees(spark, monkeypatch):
    called, whole = [], shingle_links.simhash.find_links
    monkeypatch.setattr(shingle_links.simhash, "find_links", lambda *a, **k: called.append(a) or whole(*a, **k))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text of its own words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingle_links.drop_near_duplicates(docs).collect()) == [1, 3] and called
