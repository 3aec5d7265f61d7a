"""An inverted index for lexical retrieval: the k best texts of many queries without reading every text.

The index holds three tables: ``terms`` (how often and in how many texts), ``blocks`` and ``lengths`` of the collection. Texts are
dealt to blocks of neighbours: texts are ordered by the term that weighs most in them (of those that could fill a block), then by that weight, so
that a block's texts resemble each other and blocks differ in what they can reach. A row of ``blocks`` is a term's postings in one block, with the
largest weight per length that any of them has: the most that the term can add to a score there. Rows of a file are sorted by term, so
a query's read touches its own terms' pages.

A search has two rounds. From the maxima alone, each (query, block) gets a bound; each query's blocks of the highest bounds are
scored first, and their k-th score is a threshold that the final one can't fall below. Then only blocks whose bound reaches the
threshold are scored. Every other block is left unread, and the result is that of scoring everything.

Scores are those of ``retrieval.lexical_scores``, where each query counts as one more text: that changes the weights of the
query's own terms and may bring terms into the vocabulary and others out of it. The postings of those terms correct each text's length
to the same value. Where a term drops out, bounds would not hold: blocks that have it are scored as if their bound were infinite.

Cases: null and empty texts have no postings; a query of no known term finds nothing; only texts of a score above zero are found; ties
go by id; repeated ids are texts of their own, told apart by nothing but their row, and both found; an empty collection gives
empty tables. A term that a third of all texts have is that many postings, a row for each block.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ranking import global_rank
from sieveline.operators.termcounts import each_term, term_counts
from sieveline.storage import stored

#: Texts of a block.
BLOCK = 64
#: Query terms that are broadcast at most; more go by a shuffle.
FEW = 500_000
#: Query terms that are pushed into the scan as a list at most.
PUSHED = 1000
MAX_FEATURES = 5000


@dataclass(frozen=True)
class Postings:
    """The tables of an index and the folder they lie in."""

    terms: DataFrame
    blocks: DataFrame
    n: int
    max_features: int
    stop_words: tuple[str, ...]


def _idf(n: Column | float, df: Column | str) -> Column:
    """Smoothed, for n texts of which one is the query."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + (F.col(df) if isinstance(df, str) else df))) + 1.0


def _by_block(counted: DataFrame, placed: DataFrame) -> DataFrame:
    """Whole rows of texts with their block; a block's texts in one partition."""
    return counted.join(placed, "row").repartition("block")


def _gathered(rows: DataFrame) -> DataFrame:
    """term, block, most, postings, of rows that ``_by_block`` has dealt: no row moves."""
    most = F.max(F.when(F.col("square") > 0, F.col("tf") / F.sqrt("square")).otherwise(F.lit(float("inf"))))
    return rows.groupBy("term", "block").agg(most.alias("most"), F.collect_list(F.struct("id", "row", "tf", "square")).alias("postings"))


def build(docs: DataFrame, id_col: str, text: str, max_features: int = MAX_FEATURES, stop_words: Iterable[str] = (), block: int = BLOCK) -> Postings:
    """Index texts. Texts are shuffled as whole rows, to their numbers and then to their blocks; statistics move as partial counts."""
    stop = tuple(sorted(set(stop_words)))
    counted = stored(term_counts(docs.select(F.col(id_col).alias("id"), F.col(text).alias("__text")), "__text").withColumn("row", F.monotonically_increasing_id()), "term-counts")
    each = each_term(counted, "id", "row")
    if stop:
        each = each.filter(~F.col("term").isin(*stop))
    n = counted.count()
    terms = each.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df"))
    ranked = global_rank(terms, [("ctf", True), ("term", False)], "place")
    terms = stored(ranked.withColumn("idf", _idf(float(n + 1), "df")).sort("term"), "postings-terms")
    known = F.broadcast(terms.filter(F.col("place") < max_features).select("term", "idf", "df"))  # at most max_features rows
    weight = F.col("tf") * F.col("idf")
    shape = each.join(known, "term").groupBy("row").agg(F.sum(weight * weight).alias("square"), F.max(F.when(F.col("df") >= block, F.struct(weight.alias("w"), "term"))).alias("lead"))
    lead = counted.select("row").join(shape, "row", "left").select("row", F.coalesce("square", F.lit(0.0)).alias("square"), F.col("lead.term").alias("lead"), (F.col("lead.w") / F.sqrt("square")).alias("share"))
    placed = global_rank(lead, [("lead", False), ("share", True), ("row", False)], "at").select("row", "square", F.floor(F.col("at") / block).alias("block"))
    # Texts go to their blocks as whole rows, so a block's terms are gathered where they lie: postings never move.
    # Postings of one (term, block) are no more than a block has texts.
    rows = each_term(_by_block(counted, stored(placed, "placed")), "id", "row", "square", "block")
    if stop:
        rows = rows.filter(~F.col("term").isin(*stop))
    blocks = _gathered(rows)
    blocks = stored(blocks.sortWithinPartitions("term", "block"), "postings-blocks")
    return Postings(terms, blocks, n, max_features, stop)


def _vocabulary_changes(index: Postings, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, term, tf, df, known) with what is in each query's vocabulary, and (query, term, idf) of terms that drop out of it.

    asked: query, term, tf. Terms of the index stay unless others pass them: only the last places, as many as the longest query has terms, can change.
    """
    terms = index.terms.select("term", "ctf", "df", "place", "idf")
    own = asked.join(terms, "term", "left").select("query", "term", "tf", F.coalesce("ctf", F.lit(0)).alias("ctf"), F.coalesce("df", F.lit(0)).alias("df"), "place", "idf")
    own = stored(own, "asked")
    inside = F.col("place") < index.max_features
    longest = asked.groupBy("query").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    room = max(0, index.max_features - terms.limit(index.max_features).count())  # an index of fewer terms takes new ones without loss
    last = terms.filter((F.col("place") < index.max_features) & (F.col("place") >= index.max_features - longest)).select("term", "ctf", "idf")
    outside = own.filter(~F.coalesce(inside, F.lit(False)))
    queries = outside.select("query").distinct()
    # A query's rivals: the last places, with its own counts added, and its terms outside.
    mine = own.select("query", "term", F.col("tf").alias("more"))
    rivals = queries.select("query", F.explode(last.agg(F.collect_list(F.struct("term", "ctf", "idf"))).scalar()).alias("l")).select("query", "l.*")
    rivals = rivals.join(mine, ["query", "term"], "left").select("query", "term", (F.col("ctf") + F.coalesce("more", F.lit(0))).alias("ctf"), "idf", F.lit(True).alias("was"))
    rivals = rivals.unionByName(outside.select("query", "term", (F.col("ctf") + F.col("tf")).alias("ctf"), "idf", F.lit(False).alias("was")))
    best = Window.partitionBy("query").orderBy(F.col("ctf").desc(), "term")
    seats = F.count_if("was").over(Window.partitionBy("query")) + room
    rivals = stored(rivals.withColumn("seat", F.row_number().over(best) <= seats), "rivals")
    come = rivals.filter("NOT was AND seat").select("query", "term", F.lit(True).alias("comes"))
    gone = rivals.filter("was AND NOT seat").select("query", "term", "idf")
    own = own.join(come, ["query", "term"], "left").filter(F.coalesce(inside, F.lit(False)) | F.col("comes"))
    return own.select("query", "term", "tf", "df", F.coalesce(inside, F.lit(False)).alias("inside"), "idf"), gone


def search(index: Postings, queries: DataFrame, k: int = 10, query_col: str = "query", text: str = "text", digits: int = 10, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, id, score, rank) of each query's k best texts, and (query, blocks, bounded, scored): how many blocks have its terms and how many were read.

    queries: a number or name and a text for each; first: blocks of the highest bounds that are scored for the threshold.
    """
    first = first or max(2, 2 * k // BLOCK + 1)
    asked = each_term(term_counts(queries.select(F.col(query_col).alias("query"), F.col(text).alias("__text")), "__text"), "query")
    if index.stop_words:
        asked = asked.filter(~F.col("term").isin(*index.stop_words))
    asked = stored(asked, "queries")
    own, gone = _vocabulary_changes(index, asked)
    # The weight that a query's terms have when it counts as a text; what they had in the texts' lengths is taken out of those.
    now = _idf(float(index.n + 1), F.col("df") + 1)
    own = own.select("query", "term", (F.col("tf") * now).alias("q"), now.alias("now"), F.when(F.col("inside"), F.col("idf")).otherwise(F.lit(0.0)).alias("was"))
    length = own.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"), F.min(F.when(F.col("was") > 0, F.col("now") / F.col("was"))).alias("least"))
    own = stored(own.join(length, "query"), "weights")
    gone = stored(gone, "gone")
    n = own.count() + gone.count()
    small = F.broadcast if n <= FEW else (lambda df: df)
    blocks_of = index.blocks
    if n <= PUSHED:  # so few terms reach the scan as a filter
        blocks_of = blocks_of.filter(F.col("term").isin([r.term for r in own.select("term").union(gone.select("term")).distinct().collect()]))

    heads = blocks_of.select("term", "block", "most")
    # A text's length shrinks by no more than its most lowered term does.
    bound = F.col("q") / F.col("q_norm") * F.col("now") * F.col("most") / F.least(F.lit(1.0), F.coalesce("least", F.lit(1.0)))
    bounds = heads.join(small(own), "term").groupBy("query", "block").agg(F.sum(bound).alias("bound"))
    loose = heads.join(small(gone.select("query", "term")), "term").select("query", "block").distinct().withColumn("loose", F.lit(True))
    bounds = bounds.join(loose, ["query", "block"], "left").select("query", "block", F.when(F.col("loose"), F.lit(float("inf"))).otherwise(F.col("bound")).alias("bound"))
    bounds = stored(bounds, "bounds")

    def scores(blocks: DataFrame) -> DataFrame:
        """query, id, row, score of the texts in (query, block)."""
        parts = own.select("query", "term", "q", "q_norm", "now", "was").unionByName(
            gone.select("query", "term", F.lit(0.0).alias("q"), F.lit(None).cast("double").alias("q_norm"), F.lit(0.0).alias("now"), F.col("idf").alias("was"))
        )
        wanted = blocks_of.select("term", "block", "postings").join(small(stored(parts, "parts")), "term").join(blocks.select("query", "block"), ["query", "block"], "left_semi")
        each = wanted.select("query", "q", "q_norm", "now", "was", F.explode("postings").alias("p")).select("query", "q", "q_norm", "now", "was", "p.*")
        tf = F.col("tf").cast("double")
        summed = each.groupBy("query", "id", "row").agg(
            F.sum(F.col("q") * F.col("now") * tf).alias("dot"), F.max("q_norm").alias("q_norm"),
            (F.max("square") + F.sum(tf * tf * (F.col("now") * F.col("now") - F.col("was") * F.col("was")))).alias("square"),
        )
        score = F.round(F.try_divide(F.col("dot"), F.sqrt(F.greatest("square", F.lit(0.0))) * F.col("q_norm")), digits)
        return summed.select("query", "id", "row", F.coalesce(score, F.lit(0.0)).alias("score")).filter("score > 0")

    by_bound = Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")
    lead = stored(bounds.withColumn("at", F.row_number().over(by_bound)).filter(F.col("at") <= first), "lead-blocks")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row")
    early = stored(scores(lead).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "early")
    threshold = early.filter(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    slack = 10.0 ** -(digits - 1)
    rest = bounds.join(small(threshold), "query", "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - slack))
    rest = stored(rest.join(lead.select("query", "block"), ["query", "block"], "left_anti").select("query", "block"), "rest-blocks")
    late = scores(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = early.drop("rank").unionByName(late.drop("rank")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    read = rest.groupBy("query").agg(F.count("*").alias("more"))
    report = bounds.groupBy("query").agg(F.count("*").alias("blocks")).join(lead.groupBy("query").agg(F.count("*").alias("lead")), "query").join(read, "query", "left")
    report = report.select("query", "blocks", (F.col("lead") + F.coalesce("more", F.lit(0))).alias("scored"))
    return found.select("query", "id", "score", "rank"), report
