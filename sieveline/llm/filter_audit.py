"""Filter interaction audit: what each filter removes, in every order of the filters, for each part of a corpus.

A document is a set of failed filters. Applying filters in some order walks the lattice of subsets of
filters from the bottom to the top; an edge of it is (the subset applied already, the next filter), and
what a step removes depends on its edge only, not on how the subset came to be. So documents are counted
by (part, failed set, labels) first, the counts contribute to the edges of the lattice (5 filters: 80), and
the steps of all orders (120 x 5 = 600) join the edges that they walk. Nothing here grows with
documents times orders.

One filter, a copy of a smaller document, needs other rows: the smallest id of each text is aggregated and
joined back on (digest, id), so that a group of copies spreads over tasks by its ids.

Cases: a null text counts as empty, and so do equal texts of null rows; a null part is the empty string; a null
id is neither smaller nor larger than another, so such a row is no copy and makes none; rows of one id and one text
are no copies of each other, but each counts as a document; a label holds if any row of its id says so, labels without
an id are not looked at; an empty table has no parts and an empty result; other columns are not looked at. A very long
text is worked on in slices, and its distinct words in as many passes as keep the words held at a time within a slice's.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship, stored

#: The filters and what fails them.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = b"#$%&*|"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that continue a code point.
_INNER = bytes(range(0x80, 0xC0))
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20
#: Bytes of a text whose different words one pass holds.
PASS = 32 << 20
FACTS = "doc_id long, part string, digest binary, failed int"


def _slices(data: bytes, size: int):
    """Consecutive slices that end where a word ends."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end


def count_words(data: bytes, size: int = SLICE, held_at_once: int = PASS) -> tuple[int, int]:
    """Words and distinct words of a text in UTF-8: a slice is split at a time, and a pass holds the different words of its share, one pass for every ``held_at_once`` bytes."""
    passes = len(data) // held_at_once + 1
    if passes == 1 and len(data) <= size:
        words = data.split()
        return len(words), len(set(words))
    total = distinct = 0
    for k in range(passes):
        held: set[bytes] = set()
        for piece in _slices(data, size):
            words = piece.split()
            total += len(words) if k == 0 else 0
            held.update(w for w in set(words) if passes == 1 or zlib.crc32(w) % passes == k)
        distinct += len(held)
    return total, distinct


def failed_filters(data: bytes | None) -> tuple[bytes, int]:
    """SHA-256 of a text in UTF-8, and the filters A to D that it fails as bits 1, 2, 4, 8."""
    data = data or b""
    words, distinct = count_words(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (
        words < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * words,
        100 * capitals > MAX_CAPITALS_PERCENT * len(data.translate(None, _INNER)),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return hashlib.sha256(data).digest(), sum(1 << i for i, x in enumerate(fails) if x)


def _facts(batches):
    import pyarrow as pa

    for batch in batches:
        found = [failed_filters(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([d for d, _ in found], pa.binary()), pa.array([m for _, m in found], pa.int32())], ["doc_id", "part", "digest", "failed"]
        )


def document_facts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, digest, failed (bits of A to D): one narrow row for each document."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("text")).mapInArrow(_facts, FACTS)


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, failed (bits of A to E), good, toxic, n: documents by what they fail and by their labels."""
    facts = stored(document_facts(docs, id_col, text, part), "facts")
    known = facts.filter("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    holds = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(holds("quality"), holds("toxic"))
    told = facts.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return told.groupBy(
        "part", F.col("failed").bitwiseOR(copy).alias("failed"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(F.count("*").alias("n"))


def lattice_edges(filters: str = FILTERS) -> list[tuple[int, int, int]]:
    """(subset applied, next filter, orders that walk the edge): subsets as bits, filters by place."""
    n = len(filters)
    return [(s, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def order_steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, subset applied before it, its filter by place) for all permutations."""
    out = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, applied, f))
            applied |= 1 << f
    return out


def edge_counts(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, applied, filter and what happens on that edge of the lattice: rows of ``failure_counts`` contribute to every edge.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, and walked: removed times the orders that walk the edge.
    """
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in lattice_edges(filters)))
    each = counts.select("*", F.explode(edges).alias("e")).select("*", "e.*")
    own, earlier = F.col("failed").bitwiseAND(F.expr("shiftleft(1, filter)")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    alone = F.col("failed") == F.expr("shiftleft(1, filter)")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    removed = own & ~earlier
    found = each.groupBy("part", "applied", "filter", "orders").agg(
        n(~own & ~earlier).alias("kept"), n(removed).alias("removed"), n(own & earlier).alias("redundant"), n(alone).alias("unique_fails"),
        n(removed & F.col("good")).alias("good_lost"), n(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return found.withColumn("walked", F.col("removed") * F.col("orders"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    spark = docs.sparkSession
    edges = stored(edge_counts(failure_counts(docs, labels, id_col, text, part)), "edges")
    shapley = edges.groupBy(F.col("part").alias("of_part"), F.col("filter").alias("of_filter")).agg(F.sum("walked").alias("shapley"))
    steps = F.broadcast(spark.createDataFrame(order_steps(), "filter_order string, step int, applied int, filter int"))
    walked = edges.join(shapley, (F.col("part") == F.col("of_part")) & (F.col("filter") == F.col("of_filter"))).join(steps, ["applied", "filter"])
    return walked.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
