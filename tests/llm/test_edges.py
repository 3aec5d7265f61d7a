"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chat_format, exact_dedup, hilbert_shards, language_model, license_scan, packing, piece_codec, quality, simhash, warc
from sieveline.llm.queries import tokenizer_path

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "A small text of words, All rights reserved, that stands here twice over and again.", "en", "a"),
    (2, "A  small text of\nwords, All rights reserved, that stands here twice over and again.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, LONG, "en", "b"),
    (5, LONG, "en", "b"),
    (None, "no id here but words enough to count as a text of more than ten words", "en", None),
    (None, None, "de", "c"),
    (7, "Ünïcode Ñandú 日本語 \x00 İK ẞ 🙂 " * 3, "es", "c"),
    (8, "x", "en", "c"),
    (9, " \t\n", "en", "c"),
    (2, "same id, other text", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["kept", "fp", "digest", "shard", "row", "words", "n_words", "component_id", "id", "key", "curve", "slot", "first", "value", "count", "bucket", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("1 = 0")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.find_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for doc, text, *_ in ROWS:
        groups.setdefault(hashlib.sha256(SPACE.sub(" ", text or "").encode()).hexdigest(), []).append(doc)
    assert Counter(r.text_sha256 for r in got) == Counter({k: len(v) for k, v in groups.items()})
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.find_duplicates(none).count() == 0
    stays = exact_dedup.drop_duplicates(docs)
    assert stays.columns == docs.columns and stays.count() == len(groups)


def test_cuckoo_index_deletes_and_grows():
    index = exact_dedup.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.insert(k, [i])
    assert index.resizes > 0 and len(index) == 2000
    assert all(index.get(k) == [i] for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2])
    assert not index.delete(keys[0]) and index.get(keys[0]) is None
    assert all(index.get(k) == [2 * i + 1] for i, k in enumerate(keys[1::2])) and len(index) == 1000


def test_copies_of_different_tasks_meet_in_the_index():
    """What find_duplicates does in a shard: repeats are verified hits, and their sums are those of brute force."""
    index = exact_dedup.CuckooIndex(buckets=2)
    rows = [(hashlib.sha256(bytes([i % 50])).digest(), i, i) for i in range(1000)]
    for key, doc, row in rows:
        exact_dedup.apply_change(index, exact_dedup.NEW, key, doc, row, 2)
    assert index.hits == 950 and len(index) == 50
    assert sorted(map(tuple, (v for _, v in index.items()))) == [(i, i, 40) for i in range(50)]


@pytest.mark.parametrize("n", [1, 16])
def test_copies_are_confirmed_hits(spark, n):
    """However many tasks read the table, each row but the first of its text is a hit of an index that its bucket confirms."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 300).cast("string")).alias("text")).repartition(n)
    entries = exact_dedup.live_entries(exact_dedup._digests(docs, "doc_id", "text")).collect()
    assert len(entries) == 300 and sum(r.hits for r in entries) == 3700
    assert all(r.group_size == 4000 // 300 + (r.keep_id < 4000 % 300) for r in entries)


def test_index_over_time(spark):
    rng = np.random.default_rng(7)
    entries, live, number = None, Counter(), 0
    names = {}
    for _ in range(4):
        retired = [t for t in live.elements() if rng.random() < 0.4] + ["never there"]
        new = [(number + i, f"text {rng.integers(30)}") for i in range(40)]
        number += 40
        live -= Counter(retired)
        names = {t: k for t, k in names.items() if live[t]}
        want = []
        for doc, t in new:
            want.append((doc, names.setdefault(t, doc), names[t] == doc))
            live[t] += 1
        gone = spark.createDataFrame([(None, t) for t in retired], "doc_id long, text string")
        entries, verdicts = exact_dedup.update_index(entries, spark.createDataFrame(new, "doc_id long, text string"), gone, shard_keys=2)
        assert sorted(map(tuple, verdicts.collect())) == want
        digests = {hashlib.sha256(t.encode()).digest(): (names[t], n) for t, n in live.items()}
        assert {bytes(r.digest): (r.keep_id, r.group_size) for r in entries.collect()} == digests


def brute_stats(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_statistics(spark, docs, none, sf):
    texts = [t for _, t, *_ in ROWS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a b c d e a b c d e", "a a a a a a a", "a b c d", "q\nq\nq\n \n \nz"]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_stats(t)
    got = quality.judge_documents(docs, None).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.judge_documents(none, None).count() == 0
    assert quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels) is None
    assert quality.keep_good(docs, None).columns == docs.columns


def test_quality_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.BoostedTrees(trees=30).fit(x, y, np.array([-1, 0, -1]))
    assert ((model.score(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.95
    probe = rng.random((200, 3))
    for j in (0, 2):
        steps = []
        for v in np.linspace(0, 1, 40):
            probe[:, j] = v
            steps.append(model.score(probe))
        assert (np.diff(np.array(steps), axis=0) <= 1e-12).all()


def test_flat_trees_score_as_a_walk_does():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((800, 4)), 2)  # values that equal thresholds occur
    y = ((x[:, 0] + x[:, 1] > 1) ^ (x[:, 2] < 0.2)).astype(float)
    model = quality.BoostedTrees(trees=12).fit(x, y, np.array([0, 1, 0, -1]))

    def walk(row):
        total = model.start
        for node in model.roots:
            while model._nodes[node][0] >= 0:
                feature, threshold, left, right, _ = model._nodes[node]
                node = int(right if row[int(feature)] > threshold else left)
            total += model._nodes[node][4]
        return total

    assert np.allclose(model.score(x), [walk(r) for r in x], rtol=0, atol=1e-12) and len(model._nodes) > 60


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.filter("doc_id % 3 <> 0"))
    held = quality.judge_documents(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("kept", "quality", "base_failed").collect()
    good = [r.kept for r in held if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in held if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_piece_codec(spark, docs, none):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    got = piece_codec.encode_documents(docs, model).collect()
    want = Counter()
    for doc, text, *_ in ROWS:
        ids = lib.encode(text or "")
        want[doc, tuple(ids), lib.decode(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert piece_codec.encode_documents(none, model).count() == 0


def test_piece_codec_on_whole_tables_and_noise(spark, sf):
    """Every document, every page's source, and random texts of odd characters, against the library."""
    import random

    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    codec = piece_codec.PieceCodec(model)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rng = random.Random(5)
    pools = ["abcdefgh ", "aA\t\n  ", "äöüßéñ日本語中文ひら", "🙂👩‍👩‍👧\u200d\ufe0f", "▁<s></s>", "\x00\x7f\x85\xa0", "0123456789.,-", "ℌﬁ①½"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " " * 50]
    for t in texts:
        ids = lib.encode(t)
        got = codec.encode(t)
        assert list(got) == ids, t[:80]
        assert codec.decode(got) == lib.decode(ids).encode() if isinstance(codec.decode(got), bytes) else codec.decode(got) == lib.decode(ids)


def test_piece_codec_against_merging():
    c = piece_codec.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    for text in ["▁information", "▁aaaaaaa", "strength▁ened", "▁▁▁▁▁x", "e-e-e-", "##########", "▁tionanthe"]:
        ids = np.frombuffer(c._part(text), "<i4")
        assert [c.pieces[i][0] for i in ids] == c.merged(text)


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, docs, none, parts):
    """Every id of every document against the library, whole windows against their pieces."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more).repartition(parts)
    got = packing.pack_documents(both, path, window=256, with_ids=True).collect()
    want = Counter((r.doc_id, tuple([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in both.collect())
    pieces, windows = Counter(), {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id, r.start, tuple(r.ids), r.doc_tokens] += 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == Counter({k: n for (doc, ids), m in want.items() for k, n in Counter((doc, i, ids[i : i + 256], len(ids)) for i in range(0, len(ids), 256) for _ in range(m)).items()})
    for one in windows.values():
        at = 0
        for offset, length in sorted(one):
            assert offset == at
            at += length
        assert at <= 256
    filled = sum(r.length for r in got)
    assert 256 * len(windows) - filled < 0.01 * filled + 256
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500).tolist()
    windows, offsets = packing.pack_lengths(lengths, 64)
    room, where = [], [0] * 500
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [(r, -w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            least = min(fits)[0]
            w = [k for k, r in enumerate(room) if r == least]
            room[w[0]] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    used = Counter()
    for w, n in zip(windows, lengths, strict=True):
        used[w] += n
    assert sorted(64 - n for n in used.values()) == sorted(room)


def brute_fingerprint(text, size=4):
    import xxhash

    w = words(lower(text))
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, none, sf):
    more = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    rows = both.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    comp = components(pairs, len(rows))
    least = {}
    for c, r in zip(comp, rows, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, comp, strict=True))
    got = simhash.find_near_duplicates(both)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.drop_near_duplicates(both).count() == len(set(comp))
    assert simhash.find_near_duplicates(none).count() == 0
    assert simhash.find_near_duplicates(docs).count() == len(ROWS)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_simhash_splits_large_shards(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 63, 3)) for _ in range(400)} | {int(v) for v in rng.integers(1 << 62, size=50)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    comp = components([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4], len(values))
    for shard in (4, 16, 4096):
        roots = {r.node: r.root for r in simhash.components(simhash.find_links(df, shard=shard)).collect()}
        named = [values.index(roots.get(v, v)) for v in values]
        assert len(set(zip(named, comp, strict=True))) == len(set(comp)) == len(set(named))


def test_language_model(spark, docs, none, sf):
    more = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = both.collect()
    counts, held = Counter(), []
    for r in rows:
        held.append(zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
        if not held[-1]:
            counts.update([*words(lower(r.text)), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r, h in zip(rows, held, strict=True):
        w = [*words(lower(r.text)), None]
        want[r.doc_id, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    for block, order in ((20_000, 3), (2_000_000, 2)):
        got = language_model.score_documents(both, block_tokens=block, order=order).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert language_model.score_documents(none).count() == 0
    alone = language_model.score_documents(docs.filter("doc_id IS NULL AND text IS NULL")).collect()[0]
    assert alone.n_tokens == 1


class PlainModel:
    """Deleted interpolation with dictionaries."""

    def __init__(self, rows, order):
        self.order, self.lam = order, [[0.5] * 64] + [[0.0] + [0.5] * 63 for _ in range(order - 1)]
        folds = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 for r in rows]
        texts = [[*words(lower(r.text)), None] for r in rows]
        main = [t for t, f in zip(texts, folds, strict=True) if f not in (2, 3)]
        self.count(main)
        self.learn([self.events(t) for t, f in zip(texts, folds, strict=True) if f == 3])
        self.count([t for t, f in zip(texts, folds, strict=True) if f != 2])

    def count(self, texts):
        self.grams, self.contexts = Counter(), Counter()
        for t in texts:
            padded = ["<s>"] * (self.order - 1) + t
            for i in range(len(t)):
                end = i + self.order
                for k in range(1, self.order + 1):
                    self.grams[tuple(padded[end - k : end])] += 1
                    self.contexts[tuple(padded[end - k : end - 1])] += 1
        self.v = len({g for g in self.grams if len(g) == 1})

    def events(self, t):
        padded = ["<s>"] * (self.order - 1) + t
        return [tuple(padded[i : i + self.order]) for i in range(len(t))]

    def levels(self, gram):
        """For words, pairs and so on: bucket, weight times estimate, probability."""
        p, out = 1 / (self.v + 1), []
        for k in range(1, self.order + 1):
            g = gram[-k:]
            seen = self.contexts[g[:-1]]
            b = 0 if k == 1 else seen.bit_length()
            part = self.lam[k - 1][b] * (self.grams[g] / seen if seen else 0)
            p = part + (1 - self.lam[k - 1][b]) * p
            out.append((b, part, p))
        return out

    def learn(self, texts):
        for _ in range(language_model.ITERATIONS):
            taken, reached = [[0.0] * 64 for _ in self.lam], [[0.0] * 64 for _ in self.lam]
            for gram in (g for t in texts for g in t):
                reach = 1.0
                for k, (b, part, p) in reversed(list(enumerate(self.levels(gram)))):
                    reached[k][b] += reach
                    taken[k][b] += reach * part / p
                    reach -= reach * part / p
            change = 0
            for k in range(self.order):
                have = [b for b in range(64) if reached[k][b] > 0 and (k == 0 or b > 0)]
                for b in range(64):
                    new = self.lam[k][b]
                    if b in have:
                        new = min(taken[k][b] / reached[k][b], language_model.MOST)
                    elif k and b and have:
                        near = max((h for h in have if h < b), default=have[0])
                        new = min(taken[k][near] / reached[k][near], language_model.MOST)
                    change = max(change, abs(new - self.lam[k][b]))
                    self.lam[k][b] = new
            if change < language_model.ENOUGH:
                break

    def score(self, text):
        return sum(np.log10(self.levels(g)[-1][2]) for g in self.events([*words(lower(text)), None]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(spark, docs, sf, order):
    more = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2500").selectExpr("doc_id + 100 AS doc_id", "text")
    both = docs.select("doc_id", "text").filter("text IS NULL OR length(text) < 3000").unionByName(more)
    rows = both.collect()
    model = PlainModel(rows, order)
    want = sorted(((r.doc_id is None, r.doc_id or 0), model.score(r.text)) for r in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.score) for r in language_model.score_documents(both, order=order, block_tokens=3000).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=0, atol=1e-6)
    # After any context, seen or not, the probabilities of all words and of one unknown word sum to one.
    vocabulary = [g[0] for g in model.grams if len(g) == 1]
    for context in [("<s>",) * (order - 1), ("nowhere",) * (order - 1), *[g[:-1] for g in list(model.grams)[:4000:997] if len(g) == order]]:
        assert abs(sum(model.levels((*context, w))[-1][2] for w in [*vocabulary, "never seen"]) - 1) < 1e-9


def test_weights_find_the_mixture():
    n, v = 1000, 99
    # pair counts of 16 contexts; the estimate explains most events in one bucket and few in another
    rows = [np.array([12, 0, 1, 0]), np.array([16, 16, 64, 64]), np.array([40, 40, 40, 40])]
    events = np.array([80, 20, 30, 70])
    weights = language_model.first_weights(2)
    for _ in range(50):
        weights = language_model.next_weights(language_model.expected(rows, events, weights, n, v), weights)
    assert weights[1, 5] > 0.6 > weights[1, 7] > 0 and weights[1, 0] == 0 and weights[1, 20] == weights[1, 7] and weights[1, 1] == weights[1, 5]
    assert (weights[0] > 0).all()


def test_license_scan(docs, none):
    got = license_scan.label_documents(docs).collect()
    want = Counter()
    for doc, text, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want[doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert license_scan.label_documents(none).count() == 0


def test_license_spans(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [
        f"foo bar {apache} baz", "licensed under the very same apache license version 2 0", "CC BY cc by cc", "licensed under CC-BY-NC 4.0", "under the apache tree",
        "released under the mit license " * 50, "all rights. reserved All Rights Reserved", "İ cc by",
    ]
    got = [r for r in license_scan.label_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["apache-2.0", "apache-2.0", "cc-by", "cc-by,cc-by-nc-4.0", "", "mit", "reserved", "cc-by"]
    assert got[0].score == 1.0 and all(0 <= r.score <= 1 for r in got) and got[2].n_base == 2 and got[5].n_base == 0 and got[6].first_word == 0


def test_hilbert_shards(docs, none):
    got = hilbert_shards.shard_documents(docs).collect()
    want = Counter((doc, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for doc, text, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    sizes = [len(shards.get(i, [])) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1
    before = -1
    for i in sorted(shards):
        rows = sorted(shards[i], key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert [r.curve for r in rows] == sorted(r.curve for r in rows) and rows[0].curve >= before
        before = rows[-1].curve
    assert hilbert_shards.shard_documents(none).count() == 0


def plain_curve(x, bits):
    """Place of a cell on the curve: Skilling's transform, on whole numbers."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_hilbert_by_brute_force(spark, folder):
    """Curve, shard and slot of every document against plain Python: exact quantiles, cells, order, runs."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1).withColumn("row", F.monotonically_increasing_id())
    rows = docs.select("row", "doc_id", "lang", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")).orderBy("row").collect()
    n = len(rows)

    def string_cuts(values):
        ranked = sorted((v.encode() for v in values if v is not None))
        total, cuts = len(ranked), []
        for v in sorted(set(ranked)):
            first, last = ranked.index(v), total - 1 - ranked[::-1].index(v)
            if (first - 1) * 32 // total < last * 32 // total:
                cuts.append(v)
        return cuts[:31]

    sizes = sorted(np.log2(float(r.bytes + 1)) for r in rows)
    size_cuts = sorted({sizes[max(0, -(-i * n // 32) - 1)] for i in range(1, 32)})
    lang, source = string_cuts([r.lang for r in rows]), string_cuts([r.source for r in rows])
    step = lambda cuts, v: 0 if v is None else sum(c < v for c in cuts)
    code = lambda v: None if v is None else v.encode()
    curve = {r.row: plain_curve((step(lang, code(r.lang)), step(source, code(r.source)), step(size_cuts, np.log2(float(r.bytes + 1)))), 5) for r in rows}
    want = {}
    for at, row in enumerate(sorted(curve, key=lambda i: (curve[i], i))):
        shard = at * 8 // n
        want[rows[row].doc_id] = (curve[row], shard, at - -(-shard * n // 8))
    got = {r.doc_id: (r.curve, r.shard, r.slot) for r in hilbert_shards.shard_documents(docs.drop("row")).collect()}
    assert got == want and len({c for c, *_ in got.values()}) > 20


def test_string_cuts_are_quantiles(spark):
    rng = np.random.default_rng(11)
    values = ["crawl-2018"] * 400 + ["crawl-2021"] * 5 + [f"crawl-20{i}{'x' * 300}" for i in rng.integers(10, 99, 300)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "s string")
    n, want = len(values), set()
    ranked = sorted(values)
    for i in range(1, 32):
        want.add(ranked[-(-i * n // 32)] if i * n % 32 else ranked[i * n // 32])
    got = hilbert_shards.string_cuts(df, "s")
    assert got == sorted(got) and len(got) <= 31 and "crawl-2018" in got
    steps = Counter(sum(c < v for c in got) for v in values)
    assert len(steps) > 10 and sorted(steps.values())[-2] <= 50  # beside the step of the very common value
    assert set(got) <= set(values) and len(set(got) & want) >= 0.6 * len(want)
    assert hilbert_shards.string_cuts(df.filter("1 = 0"), "s") == []


def test_hilbert_whole_table_and_pruning(spark, tmp_path):
    """One law over a table with a very common cell; a predicate on two dimensions touches fewer shards than in random order."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = spark.range(600).selectExpr("id + 1000000 AS doc_id", "'same text' AS text", "'en' AS lang", "'hot' AS source", "9L AS n_chars")
    both = docs.unionByName(hot)
    placed = hilbert_shards.shard_documents(both).cache()
    rows = placed.collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == both.count() and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    path = str(tmp_path / "shards")
    hilbert_shards.write_shards(both, placed, ["doc_id"], path)
    written = spark.read.parquet(path)
    assert sorted(r.doc_id for r in written.select("doc_id").collect()) == sorted(r.doc_id for r in both.select("doc_id").collect())
    # Shards whose ranges of language and size meet each language's longest tenth.
    about = [(r.shard, r.lang, r.n_chars) for r in written.select("shard", "doc_id", "lang", "n_chars").collect()]
    rng = np.random.default_rng(0)
    mixed = [(int(s), lang, n) for s, (_, lang, n) in zip(rng.integers(0, 8, len(about)), about, strict=True)]

    def touched(rows):
        found = 0
        for lang in sorted({x for _, x, _ in rows if x}):
            low = np.quantile([n for _, x, n in rows if x == lang], 0.9)
            for shard in range(8):
                mine = [(x, n) for s, x, n in rows if s == shard and x]
                found += min(x for x, _ in mine) <= lang <= max(x for x, _ in mine) and max(n for _, n in mine) >= low
        return found

    assert touched(about) < 0.8 * touched(mixed)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    df = spark.range(1 << (n * bits))
    steps = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
    at = {r.curve: [r.id >> (bits * i) & ((1 << bits) - 1) for i in range(n)] for r in hilbert_shards.with_hilbert_index(df, steps, bits=bits).collect()}
    assert sorted(at) == list(range(len(at)))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


def test_warc(spark):
    pages = [
        (5, "http://a/%41 b\r\nX: y", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, None), (10, "", ""), (None, "http://c", "<p>same</p>"),
        (None, "u", "alone"), (11, "http://big", "äöü\x00" * 2_000_000), (12, "x", "�"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "n", "size", "body")})
    path = warc.scratch_path(spark, "test-warc")
    warc.write_archives(df, path, limit=1 << 20)
    got = warc.read_archives(spark, path).collect()
    assert all(r.problem is None for r in got)
    want, responded = Counter(), set()
    for page, url, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == body]
        least = min((p for p in same if p is not None), default=None)
        revisit = page != least or body in responded  # of equal rows one is the response
        if not revisit:
            responded.add(body)
        want[page, url, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", least if revisit else None] += 1
        assert revisit or any(r.payload == body for r in got)
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    by_handle = sorted(map(str, got))
    opened = warc.read_archives(spark, path, opener=lambda uri: open(uri.removeprefix("file:"), "rb")).collect()
    assert sorted(map(str, opened)) == by_handle
    assert warc.round_trip(df.filter("1 = 0")).count() == 0


def test_warc_long_headers(spark):
    """URLs have no limit, and neither has a block's HTTP header."""
    pages = [(1, "http://x/" + "a" * 2_000_000, "<p>one</p>"), (2, "http://y/" + "ü%\n" * 700_000, "<p>two</p>")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.problem) for r in got) == [(p, u, "response", None) for p, u, _ in pages]
    block = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 3_000_000 + b"\r\nContent-Length: 4\r\n\r\nbody"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    for step in (7919, 1 << 16):
        found = list(warc.read_records(gzip.compress(head.encode() + block + b"\r\n\r\n"), step=step))
        assert [(r[4], r[6], r[7]) for r in found] == [(4, b"body", None)]


def test_warc_repeated_ids(spark):
    pages = [(1, "u2", "x"), (1, "u1", "x"), (1, "u1", "x"), (1, None, "x"), (2, "u", "x"), (None, "n", "y"), (None, "n", "y"), (3, "z", "z")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in got) == Counter(
        [(1, "u1", "response", None), (1, "u1", "revisit", 1), (1, "u2", "revisit", 1), (1, None, "revisit", 1), (2, "u", "revisit", 1), (None, "n", "response", None), (None, "n", "revisit", None), (3, "z", "response", None)]
    )


def test_warc_reader_finds_damage():
    record = warc.write_record(1, "http://x", b"hello world", None, False)

    plain = gzip.decompress(record)
    assert next(warc.read_records(record))[7] is None
    assert next(warc.read_records(gzip.compress(plain.replace(b"hello", b"hallo"))))[7] == "block digest"
    assert next(warc.read_records(gzip.compress(plain[:-5])))[7] == "framing"
    problems = lambda data, **kw: [r[7] for r in warc.read_records(data, **kw)]
    assert problems(record[:-9]) == ["the archive ends inside a gzip member"] or problems(record[:-9])[-1] == "the archive ends inside a gzip member"
    assert [r[0] for r in warc.read_records(record * 3, step=7)] == [1, 1, 1]
    broken = bytearray(record)
    broken[len(record) // 2] ^= 0xFF
    middle = [r[:1] + r[7:8] for r in warc.read_records(record + bytes(broken) + record)]
    assert middle[0] == (1, None) == middle[-1] and [m for m in middle if m[1]]
    assert problems(record + b"no gzip at all" + record) == [None, "gzip", None]
    assert problems(gzip.compress(b"no header") + record) == ["no header", None]
    assert problems(gzip.compress(plain.replace(b"Content-Length: ", b"Content-Size: ", 2)) + record)[-1] is None
    assert problems(b"") == []


def test_warc_reader_takes_other_writers_records():
    import base64

    def record(kind, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:35f2dc0c-7b7d-4a1f-a5a4-0123456789ab>", *more, f"Content-Length: {len(block)}", "", ""]
        return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n")

    body = b"<p>" + b"x" * 200_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha256 = hashlib.sha256(body).hexdigest()
    archive = (
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields")
        + record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/")
        + record("response", http, "Content-Type:application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{sha256}", "WARC-Target-URI: http://a/")
        + record("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32)
        + record("resource", body, "Content-Type: text/html", "WARC-Block-Digest: xyz:1")
        + record("metadata", b"")
        + record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:1>")
    )
    two = gzip.compress(gzip.decompress(record("metadata", b"a: 1")) * 2)  # two records in one member
    got = list(warc.read_records(archive + two, step=1000))
    assert [r[2] for r in got] == ["warcinfo", "request", "response", "response", "resource", "metadata", "revisit", "metadata", "metadata"]
    assert [r[7] for r in got] == [None, None, None, "payload digest", None, None, None, None, None]
    assert got[2][5] == f"sha256:{sha256}" and got[2][6] == body and got[4][5] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert all(r[0] is None and r[8].startswith("<urn:uuid:") for r in got) and got[6][3] is None and got[6][9] == "<urn:uuid:1>" and got[6][4] is None


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"{\\"a\\":1}"},{"from":"gpt","value":null}]}', "shared", [("user", '{"a":1}'), ("assistant", "")]),
        ('{"completion":"y","prompt":"[x]"}', "prompt", [("user", "[x]"), ("assistant", "y")]),
        ('{"instruction":"i","input":"","output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o","id":7,"meta":{"a":[{"b":1}]}}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"system":"s","instruction":"i","input":"j","output":"o"}', "instruction", [("system", "s"), ("user", "i\n\nj"), ("assistant", "o")]),
        ('{"messages":[{"role":"user","content":"a","name":"x"},{"content":"b","role":"assistant","calls":[]}],"id":3}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"u"},"c"]},{"role":"assistant","content":"b"}]}', "messages", [("user", 'a{"type":"image","url":"u"}c'), ("assistant", "b")]),
        ('{"messages":[]}', "no_messages", []), ('{"id":1,"conversations":[]}', "no_conversations", []),
        ('{"system":"s","prompt":"p","response":"r","x y":{"z":1}}', "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"prompt":"p","response":"r"}', "response", [("user", "p"), ("assistant", "r")]), ('{"answer":"4","question":"2+2"}', "question", [("user", "2+2"), ("assistant", "4")]),
        ('{"conversations":[{"role":"user","content":"q"}]}', "conversations", [("user", "q")]),
        ('{"other":1}', None, None), ("no json", None, None), (None, None, None), ('{"x":{"messages":[{"role":"","content":""}]}}', None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, *_) in enumerate(records)], "conv_id long, record string").withColumn("head", F.lit("clash"))
    got = chat_format.canonical_turns(df).orderBy("conv_id").collect()
    for r, (_, layout, turns) in zip(got, records, strict=True):
        assert r.unknown == (records[r.conv_id][0] if layout is None else None)
        assert r.layout == layout and (None if r.turns is None else [tuple(t) for t in r.turns]) == turns
    assert chat_format.format_conversations(df).count() == len(records)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\n<\\|", "<<SYS>>x<</SYS>>", "", None, "a\nb\r\n\x00日本🙂", "<<s>", "[[INST]]", "x" * 50_000, "<|im_end|>" * 50]
    rows = [(i % 4, None if i == 5 else i, ["user", "assistant", "system", "to\\ol\n<|x", None][i % 5], t) for i, t in enumerate(nasty * 2)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash"))
    out = chat_format.format_conversations(chat_format.records_of_rows(df))
    turns, learned = chat_format.read_turns(F.col("formatted")), chat_format.learned_text(F.col("formatted"), F.col("loss_spans"))
    for r in out.select("conv_id", turns.alias("turns"), learned.alias("learned")).collect():
        mine = [(t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        assert [tuple(t) for t in r.turns] == [x[1:] for x in mine]
        assert r.learned == "".join(x[2] for x in mine if x[1] == "assistant")
    assert chat_format.format_conversations(chat_format.records_of_rows(df.filter("1 = 0"))).count() == 0
