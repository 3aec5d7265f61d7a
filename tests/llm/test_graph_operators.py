"""The prefix trie, the filter audit and the URL filters against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sieveline.llm import filter_audit, prefix_trie, url_filters
from sieveline.llm.oracles_graph import RULES

CLASH = ["node", "depth", "class", "k", "len", "ends", "part", "failed", "digest", "rule", "host", "path", "row", "allow", "n", "rank", "__chunk"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# -- prefix trie


def trie(df):
    conv = F.col("conv")
    return prefix_trie.conversation_trie(df, F.crc32(conv.cast("string")) % 6, 5, conv - conv % 100)


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(str(c) for c in m if len(built[c]) == len(k)) for k, m in members.items()}
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()
    )


def got_trie(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in trie(df).collect())


TURNS = "conv_id long, turn long, role string, text string"


def talk(conv, *texts, turn=0):
    return [(conv, turn + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def conversations():
    rows = [r for c in range(0, 40) for r in talk(c, *(f"t{c % (d + 2)}-{d}" for d in range(c % 8)))]
    rows += [r for c in range(200, 260) for r in talk(c, "hello", "hi", "how", "fine", "good", "bye", *(["more"] * (c % 3)))]  # copies
    rows += [(300, None, None, None), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "a", "z"), (300, 1, "user", "a")]  # nulls, ties, repeated rows
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "x"), (-7, 1, "user", "ünï"), (-107, 3, "user", "y"), (1 << 40, 0, "user", "big")]
    rows += talk(305, *(f"long {i}" for i in range(300))) + talk(306, *(f"long {i}" for i in range(300))) + talk(307, "word " * 50_000)
    return rows


def test_trie(spark):
    rows = conversations()
    for n in (1, 7):
        df = clashing(spark.createDataFrame(rows, TURNS)).repartition(n)
        assert got_trie(df) == plain_trie(rows)


def test_trie_of_one_class_and_none(spark):
    rows = talk(201, "a", "b", "c", "d", "e", "f") + talk(301, "a", "b", "c", "d", "e", "f") + talk(401, "a", "b", "c", "d", "e", "f")
    # Conversations of equal bases lose as many turns; what is left differs only if the crc does.
    assert got_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    one = talk(201, "a", "b", "c", "d", "e", "f", "g")
    assert got_trie(spark.createDataFrame(one, TURNS)) == plain_trie(one)
    empty = spark.createDataFrame([], TURNS)
    assert got_trie(empty) == [] and len(trie(empty).columns) == 8


def test_trie_of_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got_trie(df) == plain_trie([tuple(r) for r in df.collect()])


def test_ids_of_a_large_class_stream(spark, monkeypatch):
    """Runs of a class join to the same hash, wherever they are cut."""
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    import pyarrow as pa

    ids = list(range(-5, 95))
    sorted_batches = [pa.RecordBatch.from_arrays([pa.array([c] * 50, pa.int64()), pa.array(ids[i : i + 50], pa.int64())], ["class", "conv"]) for c in (1, 2) for i in (0, 50)]
    runs = list(prefix_trie._runs(sorted_batches))
    assert max(len(r.split(",")) for b in runs for r in b.column(2).to_pylist()) == 7
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [(c, e) for b in prefix_trie._hashes(runs) for c, e in zip(*(x.to_pylist() for x in b.columns), strict=True)] == [(1, want), (2, want)]


# -- filter audit


def plain_audit(docs, labels):
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for d, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        parts[part or ""].append(({f for f, x in fails.items() if x}, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        shapley = Counter()
        mine = []
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                gone = [r for r in rows if not r[0] & set(order[:i]) and f in r[0]]
                shapley[f] += len(gone)
                kept = sum(not r[0] & set(order[: i + 1]) for r in rows)
                mine.append((part, "".join(order), i + 1, kept, len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def got_audit(docs, labels):
    cols = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[c] for c in cols) for r in filter_audit.audit_filters(docs, labels).collect())


PLENTY = " ".join(f"wort{i}" for i in range(60))
DOCS = [
    (1, PLENTY, "a"), (2, PLENTY, "a"), (3, PLENTY, "b"), (None, PLENTY, "b"), (0, None, None), (4, "", ""), (5, " \t\n", "b"), (6, PLENTY + " #", "a"), (7, "A" * 10 + " " + PLENTY, "a"),
    (8, "ein wort " * 40, "a"), (9, PLENTY.upper(), "c"), (9, PLENTY.upper(), "c"), (9, PLENTY.upper(), "d"), (10, "Ünï\x85çode\u2003x " * 30, "c"), (11, "ÄÖÜ" * 40 + " AB", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 1, None), (7, None, 1), (9, 1, 1), (None, 1, 1), (999, 1, 1), (10, 1, 0)]
D, L = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def test_audit(spark):
    docs, labels = clashing(spark.createDataFrame(DOCS, D)).repartition(3), spark.createDataFrame(LABELS, L)
    assert got_audit(docs, labels) == plain_audit(DOCS, LABELS)
    assert len(got_audit(docs, labels.limit(0))) == 600 * len({p or "" for *_, p in DOCS})


def test_audit_of_nothing(spark):
    assert got_audit(spark.createDataFrame([], D), spark.createDataFrame([], L)) == []


def test_lattice():
    edges, steps = filter_audit.lattice_edges(), filter_audit.order_steps()
    assert len(edges) == 80 and len(steps) == 600
    walks = Counter((applied, f) for _, _, applied, f in steps)
    assert {(s, f): n for s, f, n in edges} == dict(walks)


@pytest.mark.parametrize("size", [3, 16, 64, 1 << 20])
def test_words_in_slices(size):
    text = (" \t\n".join(f"w{i % 97}" for i in range(2000)) + "\x0b\x0c\r" + "long" * 50 + " é\x85ü " + "  ").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    for held in (len(text) // 5, 1 << 20):
        assert filter_audit.count_words(text, size, held) == (len(words), len(set(words)))
    assert filter_audit.count_words(b"", size) == (0, 0) == filter_audit.count_words(b" \n", size)


# -- URL filters


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_verdicts(pages, rules, rounds=url_filters.ROUNDS):
    judged = []
    for page, url, html in pages:
        host, path = plain_url(url)
        fit = [r for r in rules for h, _, p in (r.prefix.partition("/"),) if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        judged.append((page, host, path, max(fit, key=lambda r: len(r.prefix), default=None), html))
    links, known = Counter(), {h for _, h, *_ in judged if h}
    for _, host, _, _, html in judged:
        for to in re.findall(url_filters.HREF, html or "") if host else ():
            if to.lower() != host:
                links[host, to.lower()] += 1
                known.add(to.lower())
    pairs = set()
    for h in known:
        while "." in h.partition(".")[2]:
            pairs.add((h, h := h.partition(".")[2]))
    for a, b in pairs:
        links[a, b] += 1
        links[b, a] += 1
    nodes = {h for _, h, *_ in judged if h} | {h for pair in links for h in pair}

    def ranks(links, seeds):
        every, out = sum(seeds.values()), Counter()
        for (a, _), n in links.items():
            out[a] += n
        now, came = Counter(), Counter()
        for k in range(rounds + 1):
            back = url_filters.UNITS - sum(came.values())
            now = Counter(came)
            for h, n in seeds.items():
                now[h] += int(n / every * float(back))
            if k == rounds:
                return now
            came = Counter()
            for (a, b), n in links.items():
                came[b] += int(float(now[a]) * (n / out[a]) * url_filters.DAMPING)

    trust = ranks(links, Counter(h for _, h, _, r, _ in judged if r and r.allow))
    distrust = ranks({(b, a): n for (a, b), n in links.items()}, Counter(h for _, h, _, r, _ in judged if r and not r.allow))
    bad = {h for h in nodes if distrust[h] > trust[h] and distrust[h] * len(nodes) >= url_filters.LEAST * url_filters.UNITS}
    say = lambda h, r: "allow" if (r.allow if r else h not in bad) else "block"
    return sorted([(p, h, path, r.prefix if r else None, say(h, r)) for p, h, path, r, _ in judged], key=str)


def got_urls(df, rules=RULES):
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()], key=str)


PAGES = [
    (1, "http://A.good.org/x", '<a href="http://spam.org/">'), (2, "http://spam.org/x", "<a href=//bad.net/fr/><a href='http://BAD.net'>"), (3, "http://bad.net/fr/1", ""),
    (4, "http://m.example.com/en/x", '<A HREF = "HTTPS://good.org">'), (5, None, None), (6, "nothing", '<a href="http://lost.org">'), (7, "http://www.example.com/en/", '<a href="http://good.org/x">'),
    (8, "http://good.org", ""), (9, "http://x.bad.net/en/", ""), (10, "http://q.com?x://y/z", ""), (11, "://", ""), (12, "a\nb://C.Com/p#q?r", "x"), (13, "http://com/", ""), (14, "http://xcom/", ""),
    (15, "http://example.com/english/", ""), (16, "http://net/es/", "<a href=http://spam.org/a><a href='/local'>"), (2, "http://spam.org/x", "<a href=//bad.net/fr/>"), (None, "http://spam.org", None),
    (17, "http://sub.spam.org/", "<a href=//spam.org>" * 20_000), (18, "https://éa.example.com:80/en/", ""),
]
P = "page_id long, url string, html string"


def test_urls(spark):
    df = clashing(spark.createDataFrame(PAGES, P)).repartition(3)
    got = got_urls(df)
    assert got == plain_verdicts(PAGES, RULES)
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[2] == "block" and verdicts[8] == "allow" and verdicts[5] == verdicts[6] == "allow"


def test_urls_without_seeds_or_pages(spark):
    df = spark.createDataFrame(PAGES, P)
    assert {r[4] for r in got_urls(df, [url_filters.Rule("nowhere.invalid/", False)])} == {"allow"}
    assert got_urls(df.limit(0)) == []
    assert {r[3] for r in got_urls(df, [])} == {None}


def test_longest_rule_wins(spark):
    rules = [url_filters.Rule("com/", False), url_filters.Rule("a.com/", True), url_filters.Rule("a.com/x/", False), url_filters.Rule("b.a.com/", True), url_filters.Rule("com/xyz", True)]
    pages = [(i, f"http://{h}/{p}", None) for i, (h, p) in enumerate([("com", ""), ("z.a.com", "x"), ("z.a.com", "x/y"), ("b.a.com", "x/"), ("b.a.com", ""), ("q.com", "xyzz"), ("aa.com", "")])]
    got = {r[0]: r[3] for r in got_urls(spark.createDataFrame(pages, P), rules)}
    assert got == {0: "com/", 1: "a.com/", 2: "a.com/x/", 3: "b.a.com/", 4: "b.a.com/", 5: "com/xyz", 6: "com/"}


def test_ranks_are_whole_and_complete(spark):
    links = spark.createDataFrame([("t", "a", "b", 2), ("t", "a", "c", 1), ("t", "b", "a", 1)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("t", "a", 3), ("t", "d", 1)], "kind string, host string, n long")
    ranks = {r.host: r["rank"] for r in url_filters.propagate(links, seeds).collect()}
    assert set(ranks) == {"a", "b", "c", "d"} and 0 <= url_filters.UNITS - sum(ranks.values()) < 10
    assert ranks["b"] > ranks["c"] > 0
