"""A prefix trie of conversations: which beginnings they share, and what sharing saves.

A node at depth d is a sequence of d turns; its members are the conversations that begin with it, the smallest of
which names it. The trie is built level by level: per depth, the live conversations are grouped by (parent node, next
turn), the group's smallest conversation is the new node, and the members of groups that still hold two different
conversations go on. Then nodes are joined with their parents level by level from the bottom, which rolls up children,
leaves and savings.

Two things keep levels few and groups small. Conversations that are equal as wholes are one class with a count from the
start, so a group of copies costs one row a level. And a node with one class below it needs no more levels: the
rest of that conversation is a tail of nodes whose figures follow from the turns themselves. So there are as many levels as
the longest beginning that two different conversations share, plus one.

Turns travel as 256-bit digests of role and text; texts aren't moved, but for turns that tie. The place of a
turn and the characters up to it come from a scan by range partitions (``operators.scan``), so a long conversation is no
one task's. The ids of a class that are hashed in order are put together in runs first, and the runs of one
class stream through one hash.

Cases: turns are ordered by turn (nulls first), those of equal turn by role, then text; repeated rows are turns of their own;
a null role or text is empty; rows without a conversation id belong to none and are left out; an empty table has no
nodes; remainders have the sign of the id, as in SQL; very long texts are read by Spark's own digest and length only;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, ship, stored
from sieveline.operators.scan import running

#: Ids that one row of a run holds.
RUN = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest, chars, cum (characters so far): one narrow row for each turn of ``rows`` (conv_id, turn, role, text)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", said("role").alias("role"), said("text").alias("text"))
    again = stored(turns.groupBy("conv", "turn").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn")), "ties")
    n = again.count()
    tie = F.lit("")
    if n:
        again = again.withColumn("__tied", F.lit(True))
        turns = turns.join(F.broadcast(again) if n <= FEW else again, (F.col("conv") == F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")), "left")
        tie = F.when(F.col("__tied"), F.col("text")).otherwise(F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    narrow = turns.select("conv", "turn", "role", tie.alias("tie"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    placed = running(narrow, ["conv"], ["turn", "role", "tie"], total={"pos": F.lit(1).cast("long"), "cum": F.col("chars")})
    return placed.select("conv", "pos", "digest", "chars", "cum")


def rebuilt_turns(turns: DataFrame, borrowed: Column, most: int, base: Column) -> DataFrame:
    """conv, depth, digest, chars, cum: every conversation as the first turns of another, then its own after as many.

    borrowed: how many turns come from the other (``most`` at most), base: the other's id; both expressions over ``conv``.
    Depth 0, without a text, is there for each conversation. A conversation that only ``base`` names isn't one.
    """
    h = borrowed.cast("long")
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.max(F.when(F.col("pos") <= h, F.col("cum"))).alias("skipped"))
    heads = convs.withColumns({"h": h, "base": base, "skipped": F.coalesce("skipped", F.lit(0))})
    lead = turns.filter(F.col("pos") <= most).join(heads.select(F.col("base").alias("of")).distinct(), F.col("conv") == F.col("of"), "left_semi")
    lead = lead.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars", "cum"))).alias("lead"))
    heads = heads.join(lead, "base", "left").withColumn("lead", F.expr(f"slice(coalesce(lead, array()), 1, least(h, {most})::int)"))
    taken = F.size("lead").cast("long")
    before = F.when(taken > 0, F.element_at("lead", F.greatest(F.size("lead"), F.lit(1)))["cum"]).otherwise(F.lit(0))
    heads = stored(heads.select("conv", "n", "h", "lead", (taken - F.col("h")).alias("shift"), (before - F.col("skipped")).alias("more")), "heads")
    first = heads.select("conv", F.explode("lead").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.digest", "t.chars", "t.cum")
    own = turns.join(heads.filter("n > h").select("conv", "h", "shift", "more"), "conv").filter("pos > h")
    own = own.select("conv", (F.col("pos") + F.col("shift")).alias("depth"), "digest", "chars", (F.col("cum") + F.col("more")).alias("cum"))
    zero = F.lit(0).cast("long")
    root = heads.select("conv", zero.alias("depth"), F.lit(b"").alias("digest"), zero.alias("chars"), zero.alias("cum"))
    # Levels read one depth each: sorted files let them skip the rest.
    return stored(first.unionByName(own).unionByName(root).sortWithinPartitions("depth"), "rebuilt")


def _runs(batches):
    """Rows (class, conv), sorted -> (class, first, ids): runs of comma-joined ids."""
    import pyarrow as pa

    held: list[int] = []
    of = None
    out: list[tuple] = []

    def batch():
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["class", "first", "ids"])
        out.clear()
        return b

    def close():
        if held:
            out.append((of, held[0], ",".join(map(str, held))))
            held.clear()

    for b in batches:
        for c, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != of or len(held) == RUN:
                close()
                of = c
            held.append(conv)
        if len(out) >= 256:
            yield batch()
    close()
    yield batch()


def _hashes(batches):
    """Rows (class, first, ids), a class's together and in order -> (class, ends)."""
    import pyarrow as pa

    digest, of, done = None, None, []
    for b in batches:
        for c, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if c != of:
                if digest is not None:
                    done.append((of, digest.hexdigest()))
                digest, of = hashlib.sha256(ids.encode()), c
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["class", "ends"])
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([digest.hexdigest()])], ["class", "ends"])


def classes_of(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, k, len, total, ends) and the turns of the classes: conversations that are equal as wholes are one class, named by the smallest."""
    lanes = {f"x{i}": F.bit_xor(F.xxhash64("digest", "depth", F.lit(i))) for i in range(4)}
    convs = stored(rebuilt.groupBy("conv").agg(F.max("depth").alias("len"), F.max("cum").alias("total"), *(c.alias(n) for n, c in lanes.items())), "conversations")
    same = ["len", "total", *lanes]
    classes = stored(convs.groupBy(*same).agg(F.min("conv").alias("class"), F.count("*").alias("k")), "classes")
    n = classes.filter("k > 1").count()
    alone = F.sha2(F.col("class").cast("string"), 256)
    if not n:
        return classes.select("class", "k", "len", "total", alone.alias("ends")), rebuilt.withColumnRenamed("conv", "class")
    several = classes.filter("k > 1").select("class", *same)
    several = F.broadcast(several) if n <= FEW else several
    members = convs.join(several, same).select("class", "conv")
    runs = members.repartitionByRange("class", "conv").sortWithinPartitions("class", "conv").mapInArrow(_runs, "class long, first long, ids string")
    ends = runs.repartition("class").sortWithinPartitions("class", "first").mapInArrow(_hashes, "class long, ends string")
    classes = stored(classes.join(ends, "class", "left").select("class", "k", "len", "total", F.coalesce("ends", alone).alias("ends")), "classes")
    copies = members.filter("conv != class").select("conv")
    return classes, stored(rebuilt.join(copies, "conv", "left_anti").withColumnRenamed("conv", "class").sortWithinPartitions("depth"), "turns")


def grow(classes: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """By depth: nodes that two or more classes share, tops of tails (nodes of one class) with their parents, and classes that end in shared nodes.

    Nodes and tops: depth, conv_id, parent, n_convs, own (characters saved by the node itself; of a top, with its tail).
    """
    found = classes.agg(F.min("class").alias("root"), F.count("*").alias("n"), F.sum("k").alias("k")).first()
    if not found["n"]:
        return [], [], []
    zero = F.lit(0).cast("long")
    root = [zero.alias("depth"), F.lit(found["root"]).alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(found["k"]).alias("n_convs")]
    if found["n"] == 1:
        return [], [classes.select(*root, (F.col("total") * (F.col("k") - 1)).alias("own"))], []
    shared, tops, ended = [classes.sparkSession.range(1).select(*root, zero.alias("own"))], [], []
    live = classes.select("class", "k", "len", "total", F.lit(found["root"]).alias("node"))
    depth = 0
    while True:
        ended.append(live.filter(F.col("len") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("conv_id"), "class"))
        depth += 1
        here = live.filter(F.col("len") >= depth).join(turns.filter(F.col("depth") == depth).drop("depth"), "class")
        groups = here.groupBy("node", "digest").agg(
            F.min("class").alias("child"), F.sum("k").alias("n_convs"), F.count("*").alias("n_classes"), F.max("chars").alias("chars"), F.max(F.col("total") - F.col("cum") + F.col("chars")).alias("rest")
        )
        groups = stored(groups, "level")
        alone = F.col("n_classes") == 1
        own = (F.col("n_convs") - 1) * F.when(alone, F.col("rest")).otherwise(F.col("chars"))
        nodes = groups.select(F.lit(depth).cast("long").alias("depth"), F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n_convs", own.alias("own"), "n_classes")
        tops.append(nodes.filter("n_classes = 1").drop("n_classes"))
        several = groups.filter("n_classes > 1").select("node", "digest", "child")
        n = several.count()
        if not n:
            return shared, tops, ended
        shared.append(nodes.filter("n_classes > 1").drop("n_classes"))
        live = stored(here.join(F.broadcast(several) if n <= FEW else several, ["node", "digest"]).select("class", "k", "len", "total", F.col("child").alias("node")), "live")


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    turns: conv, depth (0 for all, then from 1), digest, chars, cum.
    """
    ship(turns.sparkSession)
    classes, turns = classes_of(turns)
    shared, tops, ended = grow(classes, turns)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    if not tops:
        none = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return turns.sparkSession.createDataFrame([], none)
    rolled: list[DataFrame] = []
    for depth in range(len(shared) - 1, -1, -1):
        below = tops[depth].select("parent", one.alias("n_leaves"), F.col("own").alias("saved"))
        if rolled:
            below = below.unionByName(rolled[-1].select("parent", "n_leaves", "saved"))
        kids = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
        up = shared[depth].join(kids, "conv_id").select("depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", (F.col("own") + F.col("below")).alias("saved"))
        rolled.append(stored(up, "rolled"))
    starts = _every(tops).select(F.col("conv_id").alias("class"), F.col("depth").alias("top"), "parent")
    tails = turns.join(starts, "class").filter("depth >= top").join(classes, "class")
    last = F.col("depth") == F.col("len")
    tails = tails.select(
        F.col("class").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("k").alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), ((F.col("k") - 1) * (F.col("total") - F.col("cum") + F.col("chars"))).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    if not rolled:
        return tails
    closed = _every(ended).join(classes.select("class", "ends"), "class").drop("class")
    inner = _every(rolled).join(closed, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )
    return inner.unionByName(tails)


def conversation_trie(rows: DataFrame, borrowed: Column, most: int, base: Column) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text); see ``rebuilt_turns``."""
    return build_trie(rebuilt_turns(ordered_turns(rows), borrowed, most, base))
