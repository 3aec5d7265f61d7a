"""Each stage of the pipeline on what the one before it kept, against plain Python."""

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from sieveline.llm import quality
from sieveline.llm.common import stored, table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, sf):
    docs = table(spark, sf, "documents")
    steps = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append(docs.collect())
    return steps


def as_rows(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_stage(spark, sf, kept):
    model = quality.fit_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = []
    for r in kept[0]:
        s = quality.statistics(r.text)
        if s[0] >= 10 and 100 * s[4] <= 20 * s[0] and model.score(np.array([s[5:]]))[0] >= quality.THRESHOLD:
            want.append(r)
    assert as_rows(kept[1]) == as_rows(want) and 0 < len(want) < len(kept[0])


def test_exact_stage(kept):
    best = {}
    for r in sorted(kept[1], key=lambda r: r.doc_id):
        best.setdefault(hashlib.sha256(SPACE.sub(" ", r.text).encode()).digest(), r)
    assert as_rows(kept[2]) == as_rows(best.values())


def test_near_stage(kept):
    """Five-word similarity of 0.8 or more, by brute force."""
    rows = sorted(kept[2], key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert as_rows(kept[3]) == as_rows(r for i, r in enumerate(rows) if find(i) == i)


def test_packing_stage(spark, sf, kept):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    got = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(kept[3], "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()
    pieces, used = {}, Counter()
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and set(pieces) == {r.doc_id for r in kept[3]}
    for r in kept[3]:
        ids = np.array([*lib.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table: all stages run, none loses a clean text."""
    good = kept_text = "The committee met in the old town hall and spoke at length about roads, schools and the new bridge over the river. " * 2
    rows = [(1, good, "en"), (1, good, "en"), (2, good, "en"), (None, None, None), (3, "", "en"), (None, good + "Later they left for home by the last train of the day.", "en")]
    rows.append((4, " ".join(f"word{i} and" for i in range(30_000)), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("kept", "node", "first", "digest", "row", "text_hash", "prefix", "n"):
        df = df.withColumn(c, F.lit("clash"))
    for docs in (df, df.filter("1 = 0")):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stored(stage(spark, docs, sf), name)
            assert docs.columns == df.columns
        texts = [r.text for r in docs.collect()]
        assert len(texts) == len(set(texts)) and (not texts or kept_text in texts)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == len({r.doc_id for r in docs.collect()})
    assert corpus_pipeline.quality_rules(spark, df, sf).columns == df.columns


def test_run(spark, sf, kept):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in kept[3]}
