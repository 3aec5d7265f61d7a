"""Terms of texts counted inside the row: no term moves to be counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.shipping import ship

#: Texts whose terms are counted at a time.
ROWS = 500


def _counted(batches):
    """Rows (..., list of terms) -> rows (..., distinct terms, counts), by one sort of the batch's term numbers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            lists = batch.column(batch.num_columns - 1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            place = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths) * width + coded.indices.to_numpy(zero_copy_only=False)
            keys, counts = np.unique(place, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=batch.num_rows))]).astype(np.int32)
            terms = coded.dictionary.take(pa.array(keys % width))
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(ends, terms.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "terms", "counts"])


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    """The other columns of ``texts``, then terms and counts: arrays of a text's distinct tokens and how often each stands there.

    A null text has none. Tokens are Spark's; Arrow batches are counted by number, a batch's terms at a time.
    """
    ship(texts.sparkSession)
    others = [c for c in texts.columns if c != text]
    rows = texts.select(*others, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("__tokens"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(_counted, f"{kinds}, terms array<string>, counts array<bigint>")


def each_term(counted: DataFrame, *columns: str) -> DataFrame:
    """A row for each text and term: columns, term, tf."""
    return counted.select(*columns, F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(*columns, F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
