"""Indexes, name joins, automata, saved models and hot keys against plain Python and full scans."""

import random
import re
from difflib import get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import aliases, intervals, names, parsing, postings, retrieval, scan, taxonomy, tree_model, validate, vector_index
from sieveline.operators import ranking as rk
from sieveline.plans import scaled

# -- postings


@pytest.mark.parametrize("limit", [5000, 30])
def test_postings_find_what_scoring_everything_finds(spark, sf, limit):
    """limit 30: queries bring terms into the vocabulary and others out of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "zebra zebra quagga")], "doc_id long, text string"))
    index = postings.build(docs, "doc_id", "text", limit, ["the"], block=16)
    queries = [(1, "the ring of zebra and gear"), (2, "nothing_here xyzzy"), (3, ""), (4, "quagga"), *((r.doc_id + 100, r.text[:80]) for r in docs.filter("doc_id % 50 = 7").collect() if r.text)]
    found, report = postings.search(index, spark.createDataFrame(queries, "query long, text string"), 10)
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    for name, text in queries:
        want = retrieval.lexical_scores(docs, "doc_id", "text", text, limit, ["the"]).filter("lexical > 0").orderBy(F.col("lexical").desc(), "id").limit(10).collect()
        assert sorted(got.get(name, [])) == [(i, r.id, r.lexical) for i, r in enumerate(want, 1)], (name, text)
    assert all(r.scored <= r.blocks for r in report.collect())


def test_postings_skip_blocks(spark):
    """Texts that resemble each other share blocks, so a query for one kind reads few of them."""
    docs = spark.range(4000).select(F.col("id"), F.concat_ws(" ", F.concat(F.lit("topic"), F.col("id") % 50), F.lit("common words"), F.concat(F.lit("only"), F.col("id"))).alias("text"))
    index = postings.build(docs, "id", "text")
    found, report = postings.search(index, spark.createDataFrame([(1, "topic7 common"), (2, "only77 topic3")], "query long, text string"), 5)
    assert [(r.query, r.id) for r in found.filter("rank = 1").orderBy("query").collect()] == [(1, 7), (2, 77)]
    read = {r.query: (r.scored, r.blocks) for r in report.collect()}
    assert read[1][1] == 63 and read[1][0] < 10 and read[2][1] < 10  # the second has few blocks at all


def test_postings_are_gathered_where_their_block_lies(spark):
    """Texts move as whole rows; no exchange has a term for each row."""
    counted = spark.createDataFrame([(i, i, ["a", f"b{i % 3}"], [1, 2]) for i in range(40)], "id long, row long, terms array<string>, counts array<long>")
    placed = spark.range(40).select(F.col("id").alias("row"), F.lit(2.0).alias("square"), F.floor(F.col("id") / 8).alias("block"))
    rows = postings.each_term(postings._by_block(counted, placed), "id", "row", "square", "block")
    got = postings._gathered(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(term", plan) and "hashpartitioning(block" in plan
    assert {(r.term, r.block): sorted(p.id for p in r.postings) for r in got.filter("term = 'a'").collect()} == {("a", b): list(range(b * 8, b * 8 + 8)) for b in range(5)}


def test_postings_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    found, report = postings.search(postings.build(empty, "id", "text"), spark.createDataFrame([(1, "a query")], "query long, text string"))
    assert found.count() == 0 and report.count() == 0


# -- names


def _words(rng, n, letters="abcde rst"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 22))).strip() for _ in range(n)} - {""})


@pytest.mark.parametrize("cutoff", [0.75, 0.6, 0.9])
def test_closest_names_are_those_of_a_full_comparison(spark, cutoff):
    rng = random.Random(5)
    entries = _words(rng, 250)
    own = _words(rng, 120) + [e[:3] + e[4:] for e in entries[::4] if len(e) > 4] + [e + "x" for e in entries[::9]]
    frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "text string")
    got = {r.name: r.entry for r in names.closest_names(frame(own), frame(entries), cutoff).collect()}
    want = {o: m[0] for o in own if (m := get_close_matches(o, entries, n=1, cutoff=cutoff))}
    assert got == want and want


def test_rows_of_a_common_gram_are_dealt(spark, monkeypatch):
    """One pair of letters that all texts have makes as many tasks as its pairs need, and nothing is lost."""
    monkeypatch.setattr(names, "MET", 500)
    monkeypatch.setattr(names, "COMPARED", 100)
    rng = random.Random(8)
    own, entries = ([f"aa{''.join(rng.choice('bcdé') for _ in range(n))}" for _ in range(k)] for n, k in ((6, 60), (7, 90)))
    frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "text string")
    grams = frame(own).withColumn("gram", F.lit("aa"))
    left, right, tasks = names._meeting(grams.withColumnRenamed("text", "name"), frame(entries).withColumn("gram", F.lit("aa")).withColumnRenamed("text", "entry"))
    sizes = [len(x) for x in right.rdd.glom().collect()]
    assert tasks == left.rdd.getNumPartitions() and tasks > 5 and max(sizes) < sum(sizes) / 2
    got = {r.name: r.entry for r in names.closest_names(frame(own), frame(entries)).collect()}
    assert got == {o: m[0] for o in own if (m := get_close_matches(o, sorted(set(entries)), n=1, cutoff=0.75))} and got


def test_common_letters_are_those_of_a_table():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé𐐀") for _ in range(rng.choice([0, 1, 6, 20, 64, 70])))
    left, right = [word() for _ in range(150)], [word() for _ in range(150)]
    for a, b, n in zip(left, right, names.common_letters(left, right).tolist(), strict=True):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        assert n == row[-1] if len(a) <= 64 else n == min(len(a), len(b))


def test_few_pairs_are_compared(spark, sf):
    a, b = scaled.words_of_table(spark, sf, "benchmark", 5), scaled.words_of_table(spark, sf, "conversations", 5)
    pairs, every = names.likely_pairs(a, b).count(), a.count() * b.count()
    assert pairs < every / 20
    own, entries = [r.text for r in a.collect()], sorted(r.text for r in b.collect())
    got = {r.name: r.entry for r in scaled.jn8_closest_names(spark, sf).collect()}
    sample = own[:: max(1, len(own) // 150)]  # difflib takes a while for all
    assert {o: got.get(o) for o in sample} == {o: next(iter(get_close_matches(o, entries, n=1, cutoff=0.75)), None) for o in sample}


def test_subsets_are_those_of_a_nested_loop(spark):
    rng = random.Random(3)
    phrase = lambda: " ".join(rng.choice("red blue ring gear bolt a b c d e".split()) for _ in range(rng.randint(1, 4)))
    own, entries = sorted({phrase() for _ in range(80)} | {"-/", "red/blue-ring"}), sorted({phrase() for _ in range(60)})
    for more in ([], [" - "]):
        rows = [(e, i * 7 % 31) for i, e in enumerate(entries + more)]
        words = lambda x: {w for w in re.split(r"[\s/\-]+", x) if w}
        want = {}
        for o in own:
            fits = [(p, e) for e, p in rows if words(e) <= words(o) or words(o) <= words(e)]
            if fits:
                want[o] = min(fits)[1]
        found = names.subset_names(spark.createDataFrame([(o,) for o in own], "text string"), spark.createDataFrame(rows, "text string, pos int"))
        assert {r.name: r.entry for r in found.collect()} == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_take_the_first_step_that_fits(spark):
    known = spark.createDataFrame([("kubernetes", "Kubernetes", 0), ("k8s", "Kubernetes", 1), ("apache spark", "Spark", 2), ("sql", "SQL", 3)], "alias string, canonical string, pos int")
    own = spark.createDataFrame([("K8s ",), ("kubernets",), ("spark",), ("nothing",), (None,), ("",), ("SQL/Server",)], "name string")
    got = {r.name: (r.canonical, r.method) for r in taxonomy.normalise_names(own, known).collect()}
    assert got == {
        "K8s ": ("Kubernetes", "exact"), "kubernets": ("Kubernetes", "fuzzy"), "spark": ("Spark", "subset"), "nothing": (None, "none"), None: (None, "none"), "": (None, "none"), "SQL/Server": ("SQL", "subset"),
    }


# -- aliases


def test_found_aliases_are_not_shuffled(spark):
    """However many parts the aliases lie in; a name of more aliases than a part holds is still one."""
    rows = [(f"name{i:02}", [f"word{i:02}{c}" for c in "abc"], f"kind{i % 3}", i) for i in range(20)]
    table = spark.createDataFrame(rows, "canonical string, aliases array<string>, category string, pos int")
    texts = spark.createDataFrame([(i, f"word{i:02}c word{i:02}b and word{(i + 1) % 20:02}a") for i in range(20)], "id long, text string")
    want = sorted([(i, f"name{i:02}", f"kind{i % 3}", f"word{i:02}b", i) for i in range(20)] + [(i, f"name{j:02}", f"kind{j % 3}", f"word{j:02}a", j) for i in range(20) for j in [(i + 1) % 20]])
    for at_once in (7, 3, 2):
        found = parsing.alias_skills(texts, "id", "text", table, at_once)
        assert sorted((r.id, r.skill, r.category, r.alias, r.pos) for r in found.collect()) == want
        if at_once > 2:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan


TEXTS = [
    (1, "We use C++, c and C in Node.js; nodejs, node js.\nGo (golang) go/R r"), (2, "Sta sta STA ads ADS Ads x_go go_x"), (3, None), (4, ""), (5, "Ünï-code uni code unicode E-Mail e mail email mail-box"),
    (6, "a.b.c .net asp.net ASPNET asp.net."), (7, "İstanbul sql İ SQL;sql"), (8, "sql" * 50 + " sql"), (9, "go go\x85 go\x1cgo"), (10, "x" * 100 + " kubernetes " + "y" * 200),
]
ALIASES = [
    ("C", ["c", "c++"], "lang", 0), ("Node", ["node.js", "nodejs", "node-js"], "lang", 1), ("Go", ["golang", "go"], "lang", 2), ("R", ["r"], "lang", 3), ("Sta", ["sta"], "x", 4), ("Ads", ["ads"], "x", 5),
    ("Uni", ["uni-code", "unicode"], "y", 6), ("Mail", ["e-mail", "mail"], "y", 7), (".NET", [".net", "asp.net"], "z", 8), ("SQL", ["sql"], "z", 9), ("Kube", ["k8s", "kubernetes"], "z", 10), ("None", [], "z", 11),
]


def plain_aliases():
    """Each name's first alias that a text holds: containment of the alias as it is, then its pattern; by the regex module."""
    import regex

    out = {}
    for i, text in TEXTS:
        for name, own, *_ in ALIASES:
            for a in own:
                low = a.lower()
                if not text or low not in text.lower():
                    continue
                loose = regex.escape(low, special_only=False).replace(r"\.", r"\.?").replace(r"\-", r"[\-\s]?")
                edge = r"[\p{White_Space},/()|;:.]"
                strict = len(low) <= 3 or low in aliases.STRICT
                whole = rf"(?:(?<={edge})|^){loose}(?={edge}|$)" if strict else rf"\b{loose}\b"
                m = regex.search(whole, text, regex.M if len(a) <= 3 and low in aliases.CASED else regex.M | regex.I)
                if m:
                    out[i, name] = (a, m.start() + 1, len(m.group()))
                    break
    return out


@pytest.mark.parametrize("at_once", [50_000, 3])
def test_aliases_by_automaton(spark, at_once):
    texts = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    spread = spark.createDataFrame([(c, n, a) for c, own, *_ in ALIASES for n, a in enumerate(own)], "name string, n int, alias string")
    of = {(c, n): a for c, own, *_ in ALIASES for n, a in enumerate(own)}
    got = {(r.id, r.name): (of[r.name, r.n], r["at"], r.length) for r in aliases.first_aliases(texts, spread, at_once).collect()}
    assert got == plain_aliases()
    table = spark.createDataFrame(ALIASES, "canonical string, aliases array<string>, category string, pos int")
    rows = parsing.alias_skills(texts, "id", "text", table, at_once).collect()
    assert {(r.id, r.skill): r.alias for r in rows} == {k: v[0] for k, v in got.items()}
    assert next(r.evidence for r in rows if r.id == 10) == "x" * 39 + " kubernetes " + "y" * 99


def test_longest_alias_inside(spark):
    texts = spark.createDataFrame([(x,) for x in ("senior data engineer", "data", "nobody", "engineer data")], "text string")
    own = spark.createDataFrame([(x,) for x in ("data", "engineer", "data engineer", "senior")], "alias string")
    for at_once in (50, 1):
        assert {tuple(r) for r in aliases.longest_inside(texts, own, at_once).collect()} == {("senior data engineer", "data engineer"), ("data", "data"), ("engineer data", "engineer")}
    assert aliases.longest_inside(texts, own.limit(0)).count() == 0


# -- vectors


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def test_many_queries_in_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(300, None), (301, [0.0] * 8), (302, [1.0]), (5, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(q, rows[q][1]) for q in range(0, 300, 20)], "query long, vector array<float>")
    got = {}
    for r in vector_index.nearest(df, asked, 7).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.cosine))
    unit = lambda v: np.array(v, dtype=np.float32).astype(float) / (np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) or 1)
    for q in range(0, 300, 20):
        scored = sorted((-round(float(unit(v if v else [0.0] * 8) @ unit(rows[q][1])), 10), i) for i, v in rows if v is None or len(v) == 8)
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in scored[:7]]
    assert vector_index.nearest(df.limit(0), asked, 7).count() == 0 == vector_index.nearest(df, asked.limit(0), 7).count()


def test_inverted_file_finds_nine_of_ten(spark, sf):
    df = vectors(spark, sf)
    index = vector_index.build(df, "vec_id")
    assert index.vectors.count() == df.count() and index.vectors.select("cell").distinct().count() > 5
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found, read = vector_index.search(index, asked, 50)
    exact = {(r.query, r.id) for r in vector_index.nearest(df, asked, 50, "vec_id").collect()}
    hits = {(r.query, r.id) for r in found.collect()}
    share = np.mean([r.read for r in read.collect()]) / index.n
    assert len(hits & exact) / len(exact) >= 0.9 and share < 0.95, (len(hits & exact) / len(exact), share)


def test_clear_clusters_need_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 10
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=16)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = vector_index.build(df)
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    found, read = vector_index.search(index, asked, 20)
    exact = {(r.query, r.id) for r in vector_index.nearest(df, asked, 20).collect()}
    assert len({(r.query, r.id) for r in found.collect()} & exact) / len(exact) >= 0.9
    assert np.mean([r.read for r in read.collect()]) / index.n < 0.25


# -- saved trees


def walk(tree, x):
    """A tree by the rules, a node at a time."""
    at = 0 if tree["split_feature"] else ~0
    while at >= 0:
        v, d = x[tree["split_feature"][at]], tree["decision_type"][at]
        kind = d >> 2 & 3
        if d & 1:
            bits = tree["cat_threshold"][tree["cat_boundaries"][int(tree["threshold"][at])] : tree["cat_boundaries"][int(tree["threshold"][at]) + 1]]
            k = -1 if np.isnan(v) or np.isinf(v) or v <= -1 else int(v)
            left = k >= 0 and k // 32 < len(bits) and bits[k // 32] >> k % 32 & 1 == 1
        else:
            if np.isnan(v) and kind != 2:
                v = 0.0
            left = bool(d & 2) if kind == 1 and abs(v) <= 1e-35 or kind == 2 and np.isnan(v) else v <= tree["threshold"][at]
        at = tree["left_child"][at] if left else tree["right_child"][at]
    return tree["leaf_value"][~at]


def random_tree(rng, features):
    n = rng.integers(0, 9)
    t = {k: [] for k in ("split_feature", "threshold", "decision_type", "left_child", "right_child", "cat_threshold")}
    t["cat_boundaries"], open_, leaves = [0], [], 0
    for i in range(n):  # node i is put where a random open child is
        if i:
            node, side = open_.pop(rng.integers(len(open_)))
            t[side][node] = i
        cat = rng.random() < 0.25
        t["split_feature"].append(int(rng.integers(features)))
        t["decision_type"].append(int(cat) | int(rng.integers(2)) << 1 | int(rng.integers(3)) << 2)
        t["threshold"].append(float(len(t["cat_boundaries"]) - 1) if cat else float(np.round(rng.normal(), 3)))
        if cat:
            t["cat_threshold"] += [int(x) for x in rng.integers(0, 2**32, size=rng.integers(1, 3))]
            t["cat_boundaries"].append(len(t["cat_threshold"]))
        t["left_child"].append(0)
        t["right_child"].append(0)
        open_ += [(i, "left_child"), (i, "right_child")]
    for node, side in open_:
        t[side][node] = ~leaves
        leaves += 1
    t["leaf_value"] = [float(x) for x in rng.normal(size=max(1, leaves))]
    return t


def saved(trees, features, header=""):
    names_ = " ".join(f"f{i}" for i in range(features))
    body = "".join(f"Tree={i}\nnum_leaves={len(t['leaf_value'])}\n" + "".join(f"{k}={' '.join(map(repr, v))}\n" for k, v in t.items()) + "\n" for i, t in enumerate(trees))
    return f"tree\nversion=v4\nnum_class=1\nnum_tree_per_iteration=1\n{header}feature_names={names_}\n\n{body}end of trees\n\nparameters:\n"


def test_saved_trees(spark, tmp_path):
    rng = np.random.default_rng(11)
    trees = [random_tree(rng, 5) for _ in range(40)]
    rows = rng.normal(scale=2, size=(400, 5))
    rows[rng.random(rows.shape) < 0.15] = np.nan
    rows[rng.random(rows.shape) < 0.15] = 0.0
    rows[::3] = np.round(rows[::3] * 10)
    rows[0, 0], rows[1, 1], rows[2, 2] = np.inf, -np.inf, 1e300
    want = [sum(walk(t, x) for t in trees) for x in rows]
    (tmp_path / "model.txt").write_text(saved(trees, 5))
    model = tree_model.read_model(spark, str(tmp_path / "model.txt"))
    np.testing.assert_allclose(model.raw(rows), want, atol=1e-12)
    averaged = tree_model.parse_model(saved(trees, 5, "average_output\n"))
    np.testing.assert_allclose(averaged.predict(rows), np.array(want) / 40, atol=1e-12)
    binary = tree_model.parse_model(saved(trees, 5, "objective=binary sigmoid:0.5\n"))
    np.testing.assert_allclose(binary.predict(rows), 1 / (1 + np.exp(-0.5 * np.array(want))), atol=1e-12)
    assert len(model.predict(np.zeros((0, 5)))) == 0
    for bad in ("", "tree\nfeature_names=a\n", saved(trees, 5).replace("num_class=1", "num_class=3").replace("num_tree_per_iteration=1", "num_tree_per_iteration=3")):
        with pytest.raises(ValueError, match="tree|classes"):
            tree_model.parse_model(bad)


# -- hot keys


def test_running_values_over_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.6 else rng.choice([None, 2, 3, i % 50 + 4]), rng.randint(0, 500), i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, at int, i int, v int").repartition(4)
    df.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        dealt = scan.spread(df, ["k"], ["at", "i"])
        assert dealt.filter("k = 1").select(scan.CHUNK).distinct().count() > 1
        got = scan.running(df, ["k"], ["at", "i"], total={"sum": F.col("v")}, reached={"most": F.col("v")}, previous={"last": F.col("v")}).collect()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, want = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: r[1:3]):
        total, most, last = state.get(k, (None, None, None))
        new = total if v is None else (total or 0) + v
        want[i] = (new, most, last)
        state[k] = (new, v if most is None else most if v is None else max(most, v), v)
    assert {r.i: (r["sum"], r.most, r["last"]) for r in got} == want


def test_spells_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 else i % 7, a := rng.randint(0, 4000), a + rng.randint(0, 4)) for i in range(2000)]
    got = sorted(map(tuple, intervals.merged(spark.createDataFrame(rows, "k int, a int, b int").repartition(6), ["k"], "a", "b").collect()))
    want = []
    for k, a, b in sorted(rows):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((k, a, b, 1))
    assert got == want


@pytest.mark.parametrize("q", [0.0, 0.37, 0.99, 1.0])
def test_percentiles_of_groups(spark, q):
    rng = np.random.default_rng(8)
    inf = float("inf")
    groups = {
        "hot": [float(x) for x in rng.lognormal(sigma=4, size=9000)], "same": [2.5] * 300, "one": [7.0], "two": [1.0, 2.0], "ties": [float(x) for x in rng.integers(0, 4, size=500)],
        "wide": [1e308, -1e308, 0.0, 1e-300] * 50, "inf": [inf, -inf, inf, 1.0, 2.0, inf], None: [float(x) for x in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("nan", float("nan")), ("hot", float("nan"))]
    got = {r.g: (r.percentile, r.n) for r in rk.grouped_percentile(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", q, buckets=16, few=10).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, place = sorted(vs), q * (len(vs) - 1)
        low, high = s[int(np.floor(place))], s[int(np.ceil(place))]
        assert got[g] == (low if low == high else pytest.approx(low + (high - low) * (place - np.floor(place)), nan_ok=True), len(vs)), g


def test_rules_of_a_long_ranking(spark):
    """Beyond a hundred thousand rows every rule is still checked."""
    rows = spark.range(100_001).select(
        F.when(F.col("id") == 500, "bad").when(F.col("id") == 700, "CAND_0000009").otherwise(F.concat(F.lit("CAND_"), F.lpad(F.col("id").cast("string"), 7, "0"))).alias("candidate_id"),
        F.when(F.col("id") == 300, "x").when(F.col("id") == 200, "5").otherwise((F.col("id") + 1).cast("string")).alias("rank"),
        F.when(F.col("id") == 400, "y").when(F.col("id") == 900, "200000").when(F.col("id").isin(50, 51), "99951").otherwise((100_001 - F.col("id")).cast("string")).alias("score"), F.lit("r").alias("reasoning"),
    ).withColumn("candidate_id", F.when(F.col("rank") == "51", F.lit("CAND_0999999")).otherwise(F.col("candidate_id")))
    got = {r.problem: r.n for r in validate.ranking_problems(rows).collect()}
    assert set(got) == {"row_count", "bad_id", "repeated_id", "bad_rank", "bad_score", "repeated_rank", "rank_range", "score_rises", "tie_order"}
    assert got["bad_id"] == got["repeated_id"] == got["bad_rank"] == got["bad_score"] == got["repeated_rank"] == got["tie_order"] == 1 and got["rank_range"] == 100_001 - 100 - 2
