"""Language-model scores by deleted interpolation.

The probability of a word after the words before it mixes maximum-likelihood estimates of n-grams of
``order`` words and fewer: P_k = l_k * (count of the k-gram / count of its context) + (1 - l_k) * P_(k-1),
where P_1 mixes the word's relative frequency with the uniform estimate. Each weight l_k depends on how
often its context was seen (buckets by powers of two; 0 for an unseen context), so the probabilities after
any context sum to one. Weights are learned by expectation-maximisation: counts from most of the
training documents are mixed so that they explain the training documents put aside. Scoring then
uses counts from all training documents.

Counts cover every training document and nothing is pruned. A task turns its documents into blocks:
arrays of word numbers, and the block's distinct n-grams as sorted 64-bit keys with counts. Blocks
are written once to the shared folder. Keys travel by key range to where they are summed, and the
sums travel back to the blocks that asked, so no task or broadcast holds the model. There are ``RANGES``
ranges, and more only beyond ``RANGE_BYTES`` of text for each; a row is a block's keys of a range. Words have 63-bit
keys and longer n-grams as many: among 100 million different words a shared count has a chance of one in 1800.

The expectation step is exact: events (counts around each put-aside token) stay in a stored table, each
iteration sums the weights' numerators and denominators over it, and only those few numbers reach the driver.

Cases: a null or empty text is one end token; a null id counts as the empty text when the training
part is chosen; repeated rows count each; without training documents the uniform estimate remains;
an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship, stored, text_or_empty
from sieveline.llm.windows import slices

#: Training leaves out documents whose crc32(id as text) mod FOLDS is HELD_OUT; of the others, EM learns from ASIDE.
FOLDS, HELD_OUT, ASIDE = 7, 2, 3
BLOCK_TOKENS = 350_000
#: Tokens that are worked on at once within a block.
SLICE = 1 << 16
#: Key ranges, and bytes of text beyond which a range is halved.
RANGES, RANGE_BYTES = 256, 16 << 20
#: Words of the longest n-gram. Iterations of expectation-maximisation, and the change of weights that ends them.
ORDER, ITERATIONS, ENOUGH = 2, 20, 1e-3
BUCKETS = 64
#: Some of each estimate always goes to the next, so that no probability is 0.
MOST = 1 - 1e-6
#: No word is white space, so these can't be words.
END, START = b"\n", b"\r"
BLOCKS = "aside boolean, block long, docs binary, words binary, tokens binary"
KEYS = "bucket int, block long, aside boolean, keys binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, which compress well where upper bytes are mostly zero."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Odd keys for n-grams, from the keys of their contexts and the even keys of their last words."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + ((word << np.uint64(31)) | (word >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


class _Grams:
    """The distinct n-grams of a block: words (by number) first, then pairs, and so on."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, start: int, order: int) -> None:
        self.tokens = tokens
        self.first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.starts = start
        every, self.places, self.offsets = [words], [tokens], [0]
        before, begin = words[tokens], words[[start]]
        for _ in range(2, order + 1):
            context = np.empty_like(before)
            context[1:] = before[:-1]
            context[self.first] = begin
            before, begin = gram_keys(context, words[tokens]), gram_keys(begin, words[[start]])
            distinct, place = np.unique(before, return_inverse=True)
            self.offsets.append(self.offsets[-1] + len(every[-1]))
            self.places.append(place.astype(np.int32))
            every.append(distinct)
        keys = np.concatenate(every)
        self.sizes = [len(x) for x in every]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, trains: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the tokens of weight 1, in key order."""
        return np.concatenate([np.bincount(p, trains, n) for p, n in zip(self.places, self.sizes, strict=True)]).astype(np.int64)[self.order]

    def by_token(self, sums: np.ndarray, starts: int):
        """Slices of tokens and, from sums in key order, the counts around each token: for the longest n-gram
        down to pairs the n-gram's and its context's, then the word's.

        starts: what the start of a document counts as context.
        """
        own = np.empty_like(sums)
        own[self.order] = sums
        at_first = np.zeros(len(self.tokens), dtype=bool)
        at_first[self.first] = True
        for i in range(0, len(self.tokens), SLICE):
            j = min(i + SLICE, len(self.tokens))
            # one token more in front: its n-grams are the contexts of the first
            levels = [own[off + p[max(i - 1, 0) : j]] for off, p in zip(self.offsets, self.places, strict=True)]
            now = [x[min(i, 1) :] for x in levels]
            rows = []
            for k in range(len(levels) - 1, 0, -1):
                context = np.empty_like(now[0])
                context[1 if i == 0 else 0 :] = levels[k - 1][:-1]
                context[at_first[i:j]] = starts
                rows += [now[k], context]
            yield slice(i, j), [*rows, now[0]]


class _Block:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[START]
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, bool, bool, int]] = []
        self.size = 0

    def add(self, doc: int | None, text: str, fold: int) -> None:
        n = 1
        for part in slices(text):  # what a block holds of a text is a number for each token, and its distinct words
            words = part.lower().split()
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.parts.append(np.array([self.number[END]], np.int32))
        self.docs.append((doc or 0, doc is None, fold == HELD_OUT, n))
        self.size += n

    def row(self, block: int, aside: bool) -> tuple:
        import xxhash

        words = np.array([xxhash.xxh64_intdigest(w) for w in self.number], np.uint64) & ~np.uint64(1)
        ids, none, held, lengths = (np.array(c, np.int64) for c in zip(*self.docs, strict=True))
        return aside, block, np.stack([ids, none, held, lengths]).tobytes(), words.tobytes(), _planes(np.concatenate(self.parts))


def _read_block(docs: bytes, words: bytes, tokens: bytes, order: int) -> tuple[np.ndarray, _Grams]:
    about = np.frombuffer(docs, np.int64).reshape(4, -1)
    return about, _Grams(np.frombuffer(words, np.uint64), _from_planes(tokens, np.int32), about[3], 0, order)


def _batch(rows, schema: str):
    import pyarrow as pa

    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _cut_blocks(limit: int):
    def run(batches):
        from pyspark import TaskContext

        done = TaskContext.get().partitionId() << 32
        open_blocks = {False: _Block(), True: _Block()}

        def close(aside):
            nonlocal done
            block, open_blocks[aside] = open_blocks[aside], _Block()
            if block.docs:
                yield _batch([block.row(done, aside)], BLOCKS)
                done += 1

        for batch in batches:
            for doc, text, fold in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                aside = fold == ASIDE
                open_blocks[aside].add(doc, text.as_py(), fold)
                if open_blocks[aside].size >= limit:
                    yield from close(aside)
        yield from close(False)
        yield from close(True)

    return run


def _keys_of_blocks(bits: int, order: int):
    """Each block's distinct n-grams with their training counts, by key range."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                aside, block, *data = (batch.column(k)[i].as_py() for k in range(5))
                docs, grams = _read_block(*data, order)
                counts = grams.counts(np.repeat(docs[2] == 0, docs[3]).astype(np.float64))
                cuts = np.searchsorted(grams.keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
                rows = [
                    (b, block, aside, _planes(np.diff(grams.keys[i:j], prepend=np.uint64(0))), _planes(counts[i:j]))
                    for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(counts)], strict=True))
                    if i < j
                ]
                for k in range(0, len(rows), 256):
                    yield _batch(rows[k : k + 256], KEYS)

    return run


SUMS = "block long, bucket int, main binary, aside binary, n_main long, n_aside long, v_main long, v_all long"


def _sum_ranges(batches):
    """Rows (bucket, block, aside, keys, counts), a bucket's together -> each block's sums, and totals (block -1)."""
    held: list[tuple] = []

    def close():
        keys = [np.cumsum(_from_planes(r[3], np.uint64), dtype=np.uint64) for r in held]
        counts = [_from_planes(r[4], np.int64) for r in held]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        sums = np.zeros((2, len(distinct)), np.int64)
        for aside in (0, 1):
            for row, end, c in zip(held, ends, counts, strict=True):
                if row[2] == bool(aside):
                    sums[aside, at[end - len(c) : end]] += c  # keys are distinct within a row
        words = (distinct & np.uint64(1)) == 0
        rows = [(-1, held[0][0], b"", b"", int(sums[0, words].sum()), int(sums[1, words].sum()), int((sums[0, words] > 0).sum()), int((sums[:, words].sum(axis=0) > 0).sum()))]
        for row, end, c in zip(held, ends, counts, strict=True):
            mine = at[end - len(c) : end]
            rows.append((row[1], row[0], _planes(sums[0, mine]), _planes(sums[1, mine]), 0, 0, 0, 0))
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], SUMS)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0][0] != row[0]:
                yield from close()
                held.clear()
            held.append(row)
    if held:
        yield from close()


def _blocks_with_sums(batches, order: int):
    """Rows (block, bucket, docs, words, tokens, main, aside) by block and bucket -> documents, n-grams and sums of each block."""
    own, main, aside = None, [], []

    def close():
        return *_read_block(*own[2:5], order), np.concatenate(main), np.concatenate(aside)

    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(k)[i].as_py() for k in range(7)]
            if row[1] == -1:
                if own:
                    yield close()
                own, main, aside = row, [], []
            else:
                main.append(_from_planes(row[5], np.int64))
                aside.append(_from_planes(row[6], np.int64))
    if own:
        yield close()


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def mixed(rows: list[np.ndarray], weights: np.ndarray, n: int, vocabulary: int) -> tuple[np.ndarray, list]:
    """Probabilities, and for each level from the longest n-gram down its bucket, its part, and its probability.

    rows: counts as ``by_token`` gives them; weights: a row for words, pairs and so on, a column for each bucket.
    """
    levels = []
    p = np.full(len(rows[-1]), 1.0 / (vocabulary + 1))
    for k in range(len(weights)):
        i = len(rows) - 1 - 2 * k
        if k == 0:
            bucket, estimate = np.zeros(len(rows[-1]), np.int64), _ratios(rows[-1], n)
        else:
            bucket, estimate = context_bucket(rows[i + 1]), _ratios(rows[i], rows[i + 1])
        share = weights[k][bucket]
        part = share * estimate
        p = part + (1 - share) * p
        levels.append((bucket, part, p))
    return p, levels[::-1]


def expected(rows: list[np.ndarray], events: np.ndarray, weights: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """Numerators and denominators of the weights: how many events are expected to come from a level, of those that reach it."""
    out = np.zeros((2, *weights.shape))
    reach = events.astype(np.float64)
    for k, (bucket, part, p) in zip(range(len(weights) - 1, -1, -1), mixed(rows, weights, n, vocabulary)[1], strict=True):
        take = reach * part / p
        out[0, k] += np.bincount(bucket, take, BUCKETS)
        out[1, k] += np.bincount(bucket, reach, BUCKETS)
        reach = reach - take
    return out


def first_weights(order: int) -> np.ndarray:
    weights = np.full((order, BUCKETS), 0.5)
    weights[1:, 0] = 0.0
    return weights


def next_weights(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Weights after an iteration; a bucket without events takes those of the next lower one that has some, else of the next higher."""
    out = before.copy()
    for k in range(len(out)):
        seen = np.flatnonzero(sums[1, k] > 0)
        out[k, seen] = np.minimum(sums[0, k, seen] / sums[1, k, seen], MOST)
        if k == 0:
            continue
        out[k, 0] = 0.0  # an unseen context has no estimate
        seen = seen[seen > 0]
        if len(seen):
            for b in set(range(1, BUCKETS)) - set(seen.tolist()):
                lower = seen[seen < b]
                out[k, b] = out[k, lower[-1] if len(lower) else seen[0]]
    return out


EVENTS = "n binary, counts binary"


def _expect(weights: np.ndarray, n: int, vocabulary: int):
    """Rows of ``EVENTS`` -> (level, bucket, reached, taken), one row for each weight."""

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((2, *weights.shape))
        for batch in batches:
            for events, counts in zip(batch.column(0), batch.column(1), strict=True):
                m = np.frombuffer(events.as_py(), np.int64)
                sums += expected(list(_from_planes(counts.as_py(), np.int64).reshape(-1, len(m))), m, weights, n, vocabulary)
        level, bucket = np.nonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(bucket), pa.array(sums[1, level, bucket]), pa.array(sums[0, level, bucket])], ["level", "bucket", "reached", "taken"])

    return run


def learn_weights(events: DataFrame, order: int, n: int, vocabulary: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights by expectation-maximisation over the stored events; each iteration brings at most ``order`` times ``BUCKETS`` numbers here."""
    weights = first_weights(order)
    for _ in range(iterations):
        rows = events.mapInArrow(_expect(weights, n, vocabulary), "level long, bucket long, reached double, taken double")
        sums = np.zeros((2, order, BUCKETS))
        for r in rows.groupBy("level", "bucket").agg(F.sum("reached").alias("reached"), F.sum("taken").alias("taken")).collect():
            sums[:, r.level, r.bucket] = r.taken, r.reached
        after = next_weights(sums, weights)
        change, weights = np.abs(after - weights).max(), after
        if change < ENOUGH:
            break
    return weights


def _ratios(over: np.ndarray, under) -> np.ndarray:
    return np.divide(over, under, out=np.zeros(len(over)), where=np.asarray(under) > 0)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, ranges: int = RANGES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    doc = F.col(id_col).cast("long")
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    chosen = docs.select(doc.alias("doc_id"), text_or_empty(text).alias("text"), fold.alias("fold"))
    size, n_main, n_all = chosen.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("fold").isin(HELD_OUT, ASIDE)), F.count_if(F.col("fold") != HELD_OUT)
    ).first()
    bits = max((ranges - 1).bit_length(), (size // range_bytes).bit_length(), 1)

    blocks = stored(chosen.mapInArrow(_cut_blocks(block_tokens), BLOCKS), "lm-blocks")
    keys = blocks.mapInArrow(_keys_of_blocks(bits, order), KEYS)
    sums = stored(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sum_ranges, SUMS), "lm-sums")
    n_m, n_a, v_m, v_all = (x or 0 for x in sums.filter("block = -1").agg(*(F.sum(c) for c in ("n_main", "n_aside", "v_main", "v_all"))).first())

    empty = F.lit(None).cast("binary")
    own = blocks.select("block", F.lit(-1).alias("bucket"), "docs", "words", "tokens", empty.alias("main"), empty.alias("aside"), F.col("aside").alias("is_aside"))
    back = sums.filter("block >= 0").select("block", "bucket", empty.alias("docs"), empty.alias("words"), empty.alias("tokens"), "main", "aside")

    def together(left: DataFrame, right: DataFrame) -> DataFrame:
        rows = left.drop("is_aside").unionByName(right)
        return rows.repartition("block").sortWithinPartitions("block", "bucket")

    def events(batches):
        import pyarrow as pa

        for _, grams, main, _ in _blocks_with_sums(batches, order):
            for _, rows in grams.by_token(main, n_main):
                mark = rows[0].astype(np.uint64)
                for x in rows[1:]:
                    mark = gram_keys(mark, x.astype(np.uint64))
                _, first, n = np.unique(mark, return_index=True, return_counts=True)  # equal events once
                data = _planes(np.concatenate([x[first] for x in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array([data], pa.binary())], ["n", "counts"])

    asides = own.filter("is_aside")
    put_aside = together(asides, back.join(asides.select("block"), "block", "left_semi"))
    seen = stored(put_aside.mapInArrow(events, EVENTS), "lm-events")
    weights = learn_weights(seen, order, n_m, v_m)
    n = n_m + n_a
    if not n:
        weights[:] = 0.0

    def scored(batches):
        import pyarrow as pa

        for about, grams, main, aside in _blocks_with_sums(batches, order):
            size = len(grams.tokens)
            known, base, score = np.empty(size, np.int64), np.empty(size), np.empty(size)
            for at, rows in grams.by_token(main + aside, n_all):
                score[at] = np.log10(mixed(rows, weights, n, v_all)[0])
                base[at] = np.log10((rows[-1] + 1) / (n + v_all + 1))
                known[at] = rows[-1] > 0
            by_doc = [np.add.reduceat(x, grams.first) for x in (known, base, score)]
            ids = pa.array(about[0], pa.int64(), mask=about[1].astype(bool))
            for i in range(0, len(ids), 20_000):
                part = slice(i, i + 20_000)
                arrays = [ids[part], pa.array(about[2][part].astype(bool)), pa.array(about[3][part]), *(pa.array(x[part]) for x in by_doc)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = together(own, back).mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
