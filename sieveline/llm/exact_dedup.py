"""Exact deduplication through a cuckoo-filter index of live digests.

``CuckooIndex`` holds short fingerprints in a cuckoo filter and, beside them, the full digests in
buckets. A lookup asks the filter first; only a hit is verified against the bucket. Digests can be
deleted again; an insertion that finds no place makes the filter twice as large and refills it from
the stored keys.

``find_duplicates`` shards documents by digest. A task merges the copies that it reads in an index of its own, so a group
that holds a third of all rows sends few rows from each task; the copies of different tasks meet in
their shard's index. In both, a copy is a hit that its bucket confirms: ``live_entries`` gives their number. Shards are as many as keep an
index at ``SHARD_KEYS`` digests or so, and each is indexed as a stream, one at a time.

``update_index`` keeps a table of live digests over time: documents that retire are taken out of the
index, new ones put in.

Cases: a null text counts as empty; texts are equal after each run of white space became one
space; of repeated rows (same id, same text) exactly one is kept; a null id sorts after all others;
an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, SPACE, keep_rows, ship, stored, text_or_empty

#: Digests for each shard, about. A shard's index is all that a task holds in memory.
SHARD_KEYS = 100_000
SLOTS, MAX_KICKS = 4, 200
#: Digests that a task merges before it sends them on.
MERGED = 100_000
#: What a row does to the index: it is in it, leaves it, or comes new; in this order.
LIVE, RETIRED, NEW = 0, 1, 2
CHANGES = "shard long, kind int, digest binary, id long, row long, n long, hits long"
#: hits: on one row of each shard, the confirmed hits of its index and of the merges before it.
ENTRIES = "digest binary, keep_id long, keep_row long, group_size long, hits long"


class CuckooIndex:
    """Cuckoo filter with 16-bit fingerprints over buckets of full digests.

    Keys are ``bytes`` of at least 16 bytes that are already uniform (digests). Values are lists
    that the caller may change in place.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.resizes = self.hits = self.deleted = 0
        self.content: dict[int, dict[bytes, list]] = {}
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = [[] for _ in range(buckets)]

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[-2:], "big") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[-10:-2], "big") & self.mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def _place(self, key: bytes) -> bool:
        fingerprint, at = self._print(key), self._home(key)
        for b in (at, self._other(at, fingerprint)):
            if len(self.slots[b]) < SLOTS:
                self.slots[b].append(fingerprint)
                return True
        for kick in range(MAX_KICKS):
            bucket = self.slots[at]
            i = kick % SLOTS
            fingerprint, bucket[i] = bucket[i], fingerprint
            at = self._other(at, fingerprint)
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(fingerprint)
                return True
        return False

    def _bucket(self, key: bytes) -> dict[bytes, list]:
        return self.content.setdefault(int.from_bytes(key[:2], "big"), {})

    def maybe(self, key: bytes) -> bool:
        """What the filter says: never False for a live key."""
        fingerprint, at = self._print(key), self._home(key)
        return fingerprint in self.slots[at] or fingerprint in self.slots[self._other(at, fingerprint)]

    def get(self, key: bytes) -> list | None:
        """The value of a live key: a hit in the filter that its bucket confirms."""
        found = self._bucket(key).get(key) if self.maybe(key) else None
        self.hits += found is not None
        return found

    def insert(self, key: bytes, value: list) -> None:
        """Add a key that isn't live yet."""
        self._bucket(key)[key] = value
        if not self._place(key):
            self._grow()

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._allocate(buckets)
            if all(self._place(k) for b in self.content.values() for k in b):
                return

    def delete(self, key: bytes) -> bool:
        """Remove a live key; a key that isn't live changes nothing, whatever its fingerprint hits."""
        if not self.maybe(key) or self._bucket(key).pop(key, None) is None:
            return False
        self.deleted += 1
        fingerprint, at = self._print(key), self._home(key)
        for b in (at, self._other(at, fingerprint)):
            if fingerprint in self.slots[b]:
                self.slots[b].remove(fingerprint)
                return True
        raise AssertionError("a live key had no fingerprint")

    def __len__(self) -> int:
        return sum(map(len, self.content.values()))

    def items(self) -> Iterator[tuple[bytes, list]]:
        for b in self.content.values():
            yield from b.items()


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _earlier(a: list, b: list) -> bool:
    """Whether (id, row, ...) of a stays rather than b's: the smaller id, null ids last, then the earlier row."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _merge_copies(bits: int, kind: int):
    """Rows (digest, id, row) -> rows of ``CHANGES``, copies that a task reads merged."""

    def run(batches):
        import pyarrow as pa

        index = CuckooIndex()

        def out():
            entries, hits = list(index.items()), index.hits
            for i in range(0, len(entries), 20_000):
                part = entries[i : i + 20_000]
                cols = list(zip(*(v for _, v in part), strict=True))
                shards = [int.from_bytes(k[:8], "big") >> 64 - bits for k, _ in part]
                arrays = [pa.array(shards, pa.int64()), pa.array([kind] * len(part), pa.int32()), pa.array([k for k, _ in part], pa.binary()), *(pa.array(c, pa.int64()) for c in cols)]
                arrays.append(pa.array([hits if i == 0 else 0] + [0] * (len(part) - 1), pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in CHANGES.split(", ")])

        for batch in batches:
            for key, doc, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                apply_change(index, NEW, key, doc, row, 1)
            if len(index) >= MERGED:
                yield from out()
                index = CuckooIndex()
        yield from out()

    return run


def apply_change(index: CuckooIndex, kind: int, key: bytes, doc: int | None, row: int | None, n: int) -> None:
    """Put n copies of a digest in, or take n out; the last one out deletes the digest."""
    found = index.get(key)
    if kind == RETIRED:
        if found is not None:
            found[2] -= n
            if found[2] <= 0:
                index.delete(key)
    elif found is None:
        index.insert(key, [doc, row, n])
    else:
        # A group that is live already keeps its name; new copies merge by the smallest id.
        if found[1] is not None and _earlier([doc, row], found):
            found[0], found[1] = doc, row
        found[2] += n


def _index_shards(batches):
    """Rows of ``CHANGES``, a shard's together and by kind -> ``ENTRIES``, a row for each digest that is live in the end."""
    import pyarrow as pa

    index, shard, before = CuckooIndex(), None, 0

    def closed():
        rows = list(index.items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            cols = [*zip(*(v for _, v in part), strict=True), [index.hits + before if i == 0 else 0] + [0] * (len(part) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary())] + [pa.array(c, pa.int64()) for c in cols], ["digest", "keep_id", "keep_row", "group_size", "hits"])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        columns = [batch.column(i).to_pylist() for i in range(1, 7)]
        for start, end in _runs(shards):
            if shards[start] != shard:
                yield from closed()
                index, shard, before = CuckooIndex(), shards[start], 0
            for kind, key, doc, row, n, hits in zip(*(c[start:end] for c in columns), strict=True):
                apply_change(index, kind, key, doc, row, n)
                before += hits
    yield from closed()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return []
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True))


def _digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "digests")


def _bits(n: int, shard_keys: int) -> int:
    return max(4, (n // shard_keys).bit_length())


def _changes(digests: DataFrame, bits: int, kind: int) -> DataFrame:
    return digests.select("digest", "doc_id", "row").mapInArrow(_merge_copies(bits, kind), CHANGES)


def _indexed(changes: DataFrame) -> DataFrame:
    return changes.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_index_shards, ENTRIES)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def live_entries(digests: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """digest, keep_id, keep_row, group_size, hits for each distinct digest of rows (digest, doc_id, row)."""
    return _indexed(_changes(digests, _bits(digests.count(), shard_keys), NEW))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    ship(docs.sparkSession)
    digests = _digests(docs, id_col, text)
    # Texts that occur once keep themselves: only the others must be joined.
    groups = _few(stored(live_entries(digests, shard_keys).filter("group_size > 1").drop("hits"), "copies"))
    joined = digests.join(groups, "digest", "left")
    return joined.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdicts = find_duplicates(docs, id_col, text).filter("group_size > 1").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept")
    return keep_rows(docs, verdicts, {"id": F.col(id_col).cast("long"), "digest": text_digest(text)})


def update_index(
    entries: DataFrame | None, new: DataFrame, retired: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS
) -> tuple[DataFrame, DataFrame]:
    """The table of live digests after documents retired and new ones came, and a verdict for each new row.

    entries: columns digest, keep_id, group_size as returned before (None: nothing is live). Retired
    rows count by their text and go before new rows come; the last copy of a text that retires takes
    its digest out of the index. A group keeps its name while any copy is live. Verdicts: doc_id,
    keep_id, kept (false: the text is live already, or a new row of a smaller id has it).
    """
    ship(new.sparkSession)
    came = _digests(new, id_col, text)
    gone = None if retired is None else _digests(retired, id_col, text)
    bits = _bits(sum(df.count() for df in (came, gone, entries) if df is not None), shard_keys)
    changes = _changes(came, bits, NEW)
    if gone is not None:
        changes = changes.unionByName(_changes(gone, bits, RETIRED))
    if entries is not None:
        shard = F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), 56 - bits)
        none = F.lit(None).cast("long")
        live = entries.select(shard.alias("shard"), F.lit(LIVE).alias("kind"), "digest", F.col("keep_id").alias("id"), none.alias("row"), F.col("group_size").alias("n"), F.lit(0).cast("long").alias("hits"))
        changes = changes.unionByName(live)
    after = stored(_indexed(changes), "entries")
    verdicts = came.join(after.select("digest", "keep_id", "keep_row"), "digest", "left")
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return after.select("digest", "keep_id", "group_size"), verdicts.select("doc_id", "keep_id", kept.alias("kept"))
