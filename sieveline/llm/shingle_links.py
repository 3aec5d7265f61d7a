"""Near-duplicates by exact Jaccard similarity of word shingles.

Documents whose sets of ``WORDS``-word shingles have a similarity of ``SHARE`` or more are linked; a
component is what links connect. All such pairs are found, not only those that a sketch brings
together: fingerprints of linked documents may differ in any number of bits, so no radius holds them.

Shingles of a document are put in one global order, those common in a sample last. Two sets that are
similar enough share a shingle among the first ``n - ceil(SHARE * n) + 1`` of each, so pairs are looked
for under those shingles only and then verified over the whole sets. The sample decides how many
pairs must be verified, never which are found. Shingles are compared by 64-bit hashes.

Before whole sets are compared, sketches are: the parity of each of m buckets of shingle hashes, m the
power of two from four times the set's size on. Each bucket whose parities differ holds a shingle that only one
set has, so sets whose sketches differ in more than a ninth of their sizes together can't be similar
enough. That is a bound, not an estimate: no pair is lost, and few others come through.

Links are first looked for by SimHash: fingerprints of the same shingles, whose BK-trees (``simhash.find_links``) give those within
its radius. Those links, and for each shingle the pairs of its documents with one of them, are verified over the whole sets; that joins
most copies. No radius holds all similar pairs, so what these leave is found as follows. Shingles
with documents of several components are then brought together by the largest of those components, and
all pairs of different components there are compared in tasks: first by sketches, which leaves the
documents of likely pairs, then those by their whole sets. A task sends on the links of a spanning
forest, never all pairs. Groups of more than ``GROUP`` documents, or of very long ones, are split, and
each pair of parts is a task of its own.

Cases: a null text counts as empty; a text of fewer words than a shingle is one shingle; of a component
the smallest id stays, null ids count last; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, clear_scratch, keep_rows, scratch_scope, ship, stored, text_or_empty
from sieveline.llm import simhash
from sieveline.llm.simhash import components
from sieveline.llm.windows import distinct, window_hashes

WORDS, SEED = 5, 42
#: Similarity as a fraction, so that the limit itself is exact.
SHARE = (4, 5)
#: Documents sampled for common shingles, and how many of those are kept at most.
SAMPLE, COMMON = 10_000, 200_000
#: Documents of a group, and shingles of them all, that one task compares with each other.
GROUP, GROUP_SHINGLES = 4096, 4 << 20


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct hashes, sorted; a text without words has the hash of the empty one. A text is hashed slice by slice; what is held is eight bytes for each distinct shingle of a slice."""
    import xxhash

    parts = [distinct(h.view(np.int64)) for h in window_hashes(text or "", size, SEED)]
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64).view(np.int64)
    return parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))


def _sets(text: Column, size: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size) for t in texts])

    return run(text.cast("string"))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of buckets of distinct hashes, 64 to a long; halves xored give the sketch of half as many buckets."""
    bits = 4 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _common(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample, sorted, and how often."""
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64(text_or_empty(text), F.lit(7)), F.lit(n)) < SAMPLE) if n > SAMPLE else docs
    counts = some.select(F.explode(_sets(F.col(text), size)).alias("s")).groupBy("s").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "s").limit(COMMON).orderBy("s").toPandas()
    return rows["s"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)


def _leading(docs: DataFrame, text: str, size: int) -> Column:
    """Struct of the set's hash, its size, its sketch and the shingles that pairs are looked for under, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, text, size))
    top, of = SHARE

    @F.pandas_udf("node long, n int, sketch array<long>, prefix array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        known, counts = shared.value
        nodes, sizes, sketches, prefixes = [], [], [], []
        for t in texts:
            s = shingles(t, size)
            count = np.zeros(len(s), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                count = np.where(known[at] == s, counts[at], 0)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            sizes.append(len(s))
            sketches.append(sketch(s))
            prefixes.append(s[np.lexsort((s, count))][: len(s) - -(-len(s) * top // of) + 1])
        return pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "n": np.array(sizes, dtype=np.int32), "sketch": sketches, "prefix": prefixes})

    return run(F.col(text).cast("string"))


def _possible(a: str, b: str) -> Column:
    """Whether sizes, and places of the shared shingle in the order, leave room for enough others."""
    top, of = SHARE
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    most = 1 + F.least(n - i, m - j) - 1
    return (of * F.least(n, m) >= top * F.greatest(n, m)) & ((top + of) * most >= top * (n + m))


def _apart(x: str, y: str) -> Column:
    """In how many buckets two sketches differ; of sketches of unequal length the longer is folded."""

    def folded(long: Column, short: Column) -> Column:
        half = F.size(short)
        return F.zip_with(F.slice(long, 1, half), F.slice(long, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    a, b = F.col(x), F.col(y)
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    same = F.when(F.size(a) == F.size(b), longer).otherwise(folded(longer, shorter))
    return F.aggregate(F.zip_with(same, shorter, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, one: n + one)


def _likely_stars(stars: DataFrame, each: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may be similar enough by their sketches."""
    top, of = SHARE
    side = lambda end: each.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    both = stars.distinct().join(side("a"), "a").join(side("b"), "b")
    # Similarity is (n + m - d) / (n + m + d) at least top / of, d being the shingles that one set has.
    return both.filter(_apart("s_a", "s_b") * (top + of) <= (of - top) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _fingerprint_pairs(each: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: all of a fingerprint with its least, and the least of fingerprints that the trees link."""
    own = each.select("node", "fp")
    least = stored(own.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("nodes")), "shingle-prints")
    same = own.join(least.filter("nodes > 1"), "fp").filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    linked = stored(simhash.find_links(least.select("fp")), "shingle-print-links").select(F.col("a").alias("x"), F.col("b").alias("y"))
    side = lambda fp, end: least.select(F.col("fp").alias(fp), F.col("low").alias(end))
    met = linked.join(side("x", "p"), "x").join(side("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return same.unionByName(met)


def _sets_of(ids: DataFrame, docs: DataFrame, each: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """node, set for these nodes, from the text of one document of each."""
    wanted = stored(each.join(ids, "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")), "shingle-nodes")
    right = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    marked = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_or_empty(text)).alias("__hash"), F.col(text).alias("__text"))
    found = marked.join(right, marked["__id"].eqNullSafe(F.col("id")) & (marked["__hash"] == F.col("hash"))).dropDuplicates(["node"])
    return stored(found.select("node", _sets(F.col("__text"), size).alias("set")), "shingle-sets")


def _verified(pairs: DataFrame, docs: DataFrame, each: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""
    top, of = SHARE
    pairs = stored(pairs, "shingle-pairs")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(ids, docs, each, id_col, text, size)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(of * common >= top * (F.size("x") + F.size("y") - common)).select("a", "b")


def _with_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def find_links(each: DataFrame, docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that are similar enough."""
    rows = each.select("node", "n", F.posexplode("prefix").alias("pos", "s"))
    shared = stored(rows.groupBy("s").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("s"), "shared-shingles")
    kept = stored(rows.join(shared, "s").select("s", F.struct("node", "n", "pos").alias("own")), "shingle-rows")
    least = stored(kept.groupBy("s").agg(F.min("own").alias("least")), "shingle-least")
    stars = kept.join(least, "s").filter("least.node < own.node").filter(_possible("least", "own")).select(F.col("least.node").alias("a"), F.col("own.node").alias("b"))
    stars = stars.unionByName(_fingerprint_pairs(each))
    first = stored(_verified(_likely_stars(stars, each), docs, each, id_col, text, size), "shingle-links")

    rooted = stored(_with_root(kept.select("s", "own", F.col("own.node").alias("node")), first).select("s", "own", "root"), "shingle-roots")
    # Of two documents of different components that share a shingle, both meet under its largest component.
    largest = rooted.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("n_roots")).filter("n_roots > 1").select("s", "main")
    mixed = rooted.join(stored(largest, "shingle-main"), "s").select("main", F.col("own.node").alias("node"), "root").distinct()
    mixed = stored(mixed.join(each.select("node", "n", "sketch"), "node"), "shingle-mixed")
    members = stored(_likely_members(mixed), "shingle-members")
    sets = _sets_of(members.select("node").distinct(), docs, each, id_col, text, size)
    rows = members.join(sets, "node").select("key", "node", "root", F.size("set").alias("n"), "set", "side")
    return first.unionByName(rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_by_group(_group_links), "a long, b long"))


def _likely_members(mixed: DataFrame) -> DataFrame:
    """key, node, root, side: those of a group (main) that are in a pair of different roots which may be similar enough by its sketches."""
    # Groups beyond the limits are few rows here; a member goes to each pair of parts that its part is in.
    most = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    hot = stored(mixed.groupBy("main").agg(most.alias("parts")).filter("parts > 1"), "hot-groups")
    split = mixed.join(hot, "main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("main", F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    split = split.select(key.alias("key"), "node", "root", "n", "sketch", side.alias("side"))
    rest = mixed.join(hot, "main", "left_anti").select(F.xxhash64("main").alias("key"), "node", "root", "n", "sketch", F.lit(0).alias("side"))
    rows = rest if hot.isEmpty() else rest.unionByName(split)
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_by_group(_group_members), "key long, node long, root long, side int")


def likely(sizes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sketches: list[np.ndarray]):
    """Positions (i, j) of a group's rows, sorted by size, that are of different roots and may be similar enough.

    Of rows of sides 1 and 2 only pairs of both sides count.
    """
    top, of = SHARE
    width = np.array([len(x) for x in sketches])
    # Rows by length of sketch, and folded once for comparison with the next shorter.
    stacks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        whole = np.stack([sketches[i] for i in at]).view(np.uint64)
        stacks[w] = at, whole
    first = np.searchsorted(sizes, -(-sizes * top // of))
    for w, (at, own) in stacks.items():
        for half, (to, others) in ((w, stacks[w]), (w // 2, stacks.get(w // 2, (None, None)))):
            if to is None or half == 0:
                continue
            mine = own if half == w else own[:, :half] ^ own[:, half:]
            for k, i in enumerate(at.tolist()):
                low, high = np.searchsorted(to, first[i]), np.searchsorted(to, i)
                js = to[low:high]
                if not len(js):
                    continue
                ok = roots[js] != roots[i]
                if sides[i]:
                    ok &= sides[js] != sides[i]
                if not ok.any():
                    continue
                apart = np.bitwise_count(others[low:high][ok] ^ mine[k]).sum(axis=1, dtype=np.int64)
                js = js[ok]
                for j in js[apart * (top + of) <= (of - top) * (sizes[js] + sizes[i])].tolist():
                    yield i, j


def _group_members(key: int, nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, sketches: list[np.ndarray]):
    """The rows of a group that are in likely pairs."""
    import pyarrow as pa

    found = np.zeros(len(nodes), dtype=bool)
    for i, j in likely(sizes, roots, sides, sketches):
        found[i] = found[j] = True
    if found.any():
        n = int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(nodes[found]), pa.array(roots[found]), pa.array(sides[found].astype(np.int32))], ["key", "node", "root", "side"])


def _group_links(key: int, nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]):
    """Links that connect the components of a group as all its links would."""
    import pyarrow as pa

    top, of = SHARE
    parent: dict[int, int] = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    edges = []
    for i, j in likely(sizes, roots, sides, [sketch(x) for x in sets]):
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a == b:
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if of * common >= top * (len(sets[i]) + len(sets[j]) - common):
            parent[max(a, b)] = min(a, b)
            edges.append((nodes[i], nodes[j]))
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in zip(*edges, strict=True)], ["a", "b"])


def _by_group(handle):
    """Rows (key, node, root, n, a list, side) by key and n -> what ``handle`` makes of each group."""

    def run(batches):
        key, parts = None, []

        def close():
            columns = (np.concatenate([p[c] for p in parts]) for c in range(4))
            return handle(key, *columns, [x for p in parts for x in p[4]])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            nodes, roots, sizes, sides = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 5))
            flat, ends = batch.column(4).flatten().to_numpy(), np.cumsum(batch.column(4).value_lengths().to_numpy())
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if parts and keys[a] != key:
                    yield from close()
                    parts = []
                key, first = int(keys[a]), ends[a - 1] if a else 0
                parts.append((nodes[a:b], roots[a:b], sizes[a:b], sides[a:b], np.split(flat[first : ends[b - 1]], ends[a : b - 1] - first)))
        if parts:
            yield from close()

    return run


def find_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """doc_id, text_hash, first (that of the row that stays): a row for each row of ``docs`` that isn't alone."""
    spark = docs.sparkSession
    ship(spark)
    with scratch_scope() as own:
        marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), simhash.fingerprints(F.col(text), size).alias("fp"), _leading(docs, text, size).alias("lead"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
        marked = stored(marked.select("doc_id", "text_hash", "fp", "lead.*"), "shingle-leads")
        each = stored(marked.groupBy("node").agg(first, F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("fp", "n", "sketch", "prefix"))), "shingle-each")
        links = stored(find_links(each, docs, id_col, text, size), "shingle-links")
        clear_scratch(spark, [p for p in own if not any(f"/{name}-" in p for name in ("shingle-leads", "shingle-each", "shingle-links"))])
        named = stored(_with_root(each.select("node", "first", "rows"), links), "shingle-named")
        groups = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1").select("root", "first")
        members = stored(named.select("node", "root").join(stored(groups, "shingle-groups"), "root").select("node", "first"), "shingle-members")
        out = stored(marked.select("doc_id", "text_hash", "node").join(members, "node").select("doc_id", "text_hash", "first"), "shingle-components")
        clear_scratch(spark, own[:-1])
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of ``docs``."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    verdicts = find_components(docs, id_col, text, size).select(F.col("doc_id").alias("id"), "text_hash", same.alias("kept"))
    return keep_rows(docs, verdicts, {"id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_or_empty(text))})
