"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles.
Fingerprints that differ in at most ``radius`` bits are linked; a component is what links connect.

Equal fingerprints are merged first. The 64 bits are then cut into ``blocks`` runs: two fingerprints
within the radius agree on at least ``blocks - radius`` of them, so for each choice of so many blocks
a fingerprint goes to the shard named by its bits there, and every linked pair meets in some shard.
A shard's fingerprints form a BK-tree (children keyed by their Hamming distance to the parent), and
a search follows only edges within the radius of the distance to the node. A shard sends on the
edges of a spanning forest, never all its pairs. Trees stay where their shard is: a broadcast would
carry the fingerprints of all documents, which grow with the input.

Shards much larger than ``SHARD`` are dealt anew by further bits; what is still larger is split into parts,
and each pair of parts becomes a task of its own.
Components come from rounds of taking each other's smallest neighbour; tables of a round are
written to the shared folder.

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked like
any other; of equal ids the smallest names the component, null ids count last (a component of only
null ids is named null); an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, keep_rows, ship, stored, text_or_empty
from sieveline.llm.windows import window_hashes

WORDS, RADIUS, BLOCKS, SEED = 4, 4, 7, 42
#: Fingerprints of a shard that one task compares with each other.
SHARD = 4096


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """Bit by bit what more than half of the windows' hashes have; a text is hashed slice by slice."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in window_hashes(text or "", size, SEED):
        n += len(hashes)
        for i in range(0, len(hashes), 65_536):
            part = hashes[i : i + 65_536].astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(text: Column, size: int = WORDS) -> Column:
    """As a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text.cast("string"))


class BKTree:
    """Fingerprints by Hamming distance: a node's children hang at their distance to it."""

    __slots__ = ("nodes", "children")

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Put a value in; the position of its node."""
        at, n = 0, len(self.nodes)
        if n:
            while True:
                d = (self.nodes[at] ^ value).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = n
                    break
                at = nxt
        self.nodes.append(value)
        self.children.append({})
        return n

    def within(self, value: int, radius: int):
        """Positions of the nodes within the radius."""
        todo = [0] if self.nodes else []
        while todo:
            at = todo.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


def spanning_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links among distinct values that connect what all links would."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, parts, edges = BKTree(), [], 0, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        mine = len(parent)
        found = 0
        for at in tree.within(v, radius):
            r = root(at)
            if found == 0:
                parent.append(r)
                edges.append((tree.nodes[at], v))
                found = 1
            elif r != (m := root(mine)):
                parent[r] = m
                edges.append((tree.nodes[at], v))
                parts -= 1
            if parts == 1:  # all that came before are connected: nothing more to learn
                break
        if not found:
            parent.append(mine)
            parts += 1
        tree.add(v)
    return edges


def _link_shards(radius: int):
    def run(batches):
        import pyarrow as pa

        def flush(values):
            if len(values) > 1:
                for a, b in spanning_edges(values, radius):
                    left.append(a)
                    right.append(b)

        def out():
            arrays = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (left, right)]
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

        left: list[int] = []
        right: list[int] = []
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            values = batch.column(1).to_numpy().view(np.uint64)
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            first, last = keys[0], keys[-1]
            if key is not None and first == key:
                held += values[: starts[1]].tolist()
                starts = starts[1:]
            if len(starts) > 1:
                flush(held)
                sizes = np.diff(starts[:-1])
                for i in np.flatnonzero(sizes > 1).tolist():
                    flush(values[starts[i] : starts[i + 1]].tolist())
                held = values[starts[-2] :].tolist()
            key = last
            if len(left) > 50_000:
                yield out()
        flush(held)
        yield out()

    return run


def _masks(blocks: int, choose: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, choose)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _finer_masks(mask: int, radius: int) -> list[int]:
    """Masks over the bits that a mask leaves out: of ``radius + 2`` runs of those, fingerprints within the radius agree on two."""
    bits = [b for b in range(64) if not mask >> b & 1]
    runs = radius + 2
    parts = [sum(1 << b for b in bits[len(bits) * i // runs : len(bits) * (i + 1) // runs]) for i in range(runs)]
    masks = [a | b for a, b in combinations(parts, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def find_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between the distinct values of column ``fp`` that connect all within the radius."""
    spark = prints.sparkSession
    ship(spark)
    masks = _masks(blocks, blocks - radius)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    members = prints.select("fp", F.posexplode(keys).alias("mask", "key"))
    sizes = lambda df: df.groupBy("key").count().filter(F.col("count") > shard)
    hot = stored(sizes(members), "hot-shards")
    finer = [_finer_masks(m, radius) for m in masks]
    wide = hot.filter(F.col("count") > len(finer[0]) * shard).select("key")
    if not wide.isEmpty():
        # Beyond this size it costs less to deal a shard's members anew, by pairs of runs of the bits left over.
        inner = F.get(F.array(*(F.array(*map(F.lit, f)) for f in finer)), F.col("mask"))
        dealt = members.join(wide, "key").select("fp", "mask", F.explode(F.transform(inner, lambda m: F.xxhash64("key", m, F.col("fp").bitwiseAND(m)))).alias("key"))
        hot = stored(hot.join(wide, "key", "left_anti").unionByName(sizes(dealt)), "hot-shards")
        members = members.join(wide, "key", "left_anti").unionByName(dealt, allowMissingColumns=True)
    # Shards beyond the limit are few rows here; a member of one goes to each pair of parts that its part is in.
    hot = hot.select("key", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = members.join(hot, "key").withColumn("part", part).select("fp", "key", "part", other.alias("other"))
    split = split.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")
    rest = members.join(hot, "key", "left_anti").select("key", "fp")
    link = _link_shards(radius)
    edges = [x.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long") for x in ([rest, split] if not hot.isEmpty() else [rest])]
    return edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each end of an edge the smallest node of its component.

    Each round links every node to the smallest among its neighbours and itself, and its larger
    neighbours to that one too; paths shorten by half or better.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    # What is joined is stored first: joins of stored tables have shuffles of their own, which Spark
    # splits where a node has very many links.
    now = stored(canonical(edges), "links")
    count = now.count()
    while count:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "links-low")
        large = both.filter("b > a").join(least, "a").select("low", "b").select(F.col("low").alias("a"), "b")
        large = stored(canonical(large), "links-large")
        # the small star: a node's smaller neighbours and itself go to the smallest of them
        least = stored(large.groupBy("b").agg(F.min("a").alias("low")), "links-low")
        small = large.join(least, "b").select(F.col("low").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        new = stored(canonical(small.select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")
        n = new.count()
        if count == n and now.join(new, ["a", "b"], "left_anti").isEmpty():
            break
        now, count = new, n
    roots = now.groupBy("b").agg(F.min("a").alias("root"))
    return roots.select(F.col("b").alias("node"), "root").unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _prints(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), fingerprints(F.col(text), size).alias("fp"))
    return stored(chosen, "fingerprints")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """fp, first, rows: the least (none, doc_id, text_hash) of the component of each fingerprint, and the component's rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    each = stored(prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    roots = components(find_links(each.select("fp"), radius))
    linked = stored(each.join(roots, each.fp == roots.node).select("fp", "root", "first", "rows"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("first").alias("least"), F.sum("rows").alias("all_rows")), "linked-least")
    named = linked.select("fp", "root").join(least, "root").select("fp", F.col("least").alias("first"), F.col("all_rows").alias("rows"))
    return named.unionByName(each.join(linked, "fp", "left_anti").select("fp", "first", "rows"))


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of ``docs``."""
    prints = _prints(docs, id_col, text, size)
    # Only fingerprints of several rows must be joined; any other row is a component of its own.
    named = stored(_labelled(prints, radius).filter("rows > 1").select("fp", "first"), "fingerprint-components")
    name = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    joined = prints.join(F.broadcast(named) if named.count() <= FEW else named, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), name.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component within the radius, that with the smallest id, with the columns of ``docs``."""
    prints = _prints(docs, id_col, text, size)
    named = _labelled(prints, radius).filter("rows > 1").select("fp", "first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    verdicts = prints.join(named, "fp").select(F.col("doc_id").alias("id"), "text_hash", same.alias("kept"))
    return keep_rows(docs, verdicts, {"id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_or_empty(text))})
