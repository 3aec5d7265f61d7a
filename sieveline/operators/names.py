"""Joins of names with a dictionary: the closest by ratio, and sets of words inside one another. No side is read whole by a task.

**Closest name.** The ratio of two texts is 2M / T: M letters in matching blocks, T letters in all. At a cutoff c, M is at least cT / 2, and at
most T - 2M places part the blocks, so the texts share at least M - (T - 2M + 1)(q - 1) grams of q letters, in order, each at places
that differ by no more than the letters that stay unmatched. Grams are indexed by rarity in the dictionary: if two texts share t grams, then
each has one of the shared grams among all but its t - 1 commonest, and the rarest shared one is among those of both. So only these prefixes are
joined, by gram, with the bounds of length and place and a bound by parity sketches of their letters; what meets is a candidate, and candidates alone are
compared. A gram's rows are dealt to as many tasks as its pairs need. Before a ratio is taken, the longest common subsequence is, which has no fewer letters
than the matching blocks and costs a hundredth. Pairs too short to be sure of two common
letters in a row are joined by single letters instead. Nothing is missed: the result is that of comparing every name with the whole dictionary.

**Words inside words.** A set lies in another only if its rarest word does, so each set is sent by that word and meets the sets
that hold it: once for entries inside names and once for names inside entries.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.shipping import ship
from sieveline.storage import stored

CUTOFF = 0.75
#: Pairs of one gram's rows that a task goes through, and candidates that a task compares, about.
MET, COMPARED = 4_000_000, 50_000
#: Tasks of such a join at most; beyond that each does more.
TASKS = 2000
#: Candidates whose subsequences are found at a time.
ROWS = 1000


def _least_matched(total: Column, cutoff: float) -> Column:
    """Letters that two texts of so many letters in all match at least; a hair is taken off lest rounding lose one."""
    return F.ceil(total * (cutoff / 2) - 1e-9)


def _least_shared(total: Column, cutoff: float, q: int) -> Column:
    """Grams of q letters that they share at least."""
    matched = _least_matched(total, cutoff)
    return matched - (total - 2 * matched + 1) * (q - 1)


def pairs_from(cutoff: float) -> int:
    """From so many letters in all, two texts at the cutoff surely share two letters in a row; 0: never sure."""
    for total in range(2, 2000):
        if all((m := ceil(t * cutoff / 2 - 1e-9)) - (t - 2 * m + 1) >= 1 for t in range(total, total + 64)):
            return total
    return 0


def _sketch(text: str) -> Column:
    """64 parities of a text's letters, each letter's first, second, ... apart: sketches differ in no more bits than letters are left over on either side."""
    bit = "transform(xs, (x, i) -> shiftleft(1L, (ascii(x) + 26 * size(filter(slice(xs, 1, i), y -> y = x))) % 64))"
    return F.expr(f"aggregate(transform(array(split({text}, '')), xs -> aggregate({bit}, 0L, (s, b) -> s ^ b)), 0L, (s, b) -> s ^ b)")


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """text, n (letters), sketch, gram, at (from 1): a row for each place."""
    places = texts.filter(F.col("n") >= q).select("text", "n", "sketch", F.explode(F.sequence(F.lit(1), F.col("n") - (q - 1))).alias("at"))
    return places.select("text", "n", "sketch", F.substring("text", F.col("at"), F.lit(q)).alias("gram"), "at")


def _prefix(grams: DataFrame, order: DataFrame, cutoff: float, q: int, least: int, most: int | None) -> DataFrame:
    """Each text's grams but the commonest that no partner can need: text, n, gram, at."""
    # The shortest partner asks for the fewest shared grams, but pairs of fewer than ``least`` letters in all, or of ``most``, are not joined here.
    shortest = F.greatest(F.ceil(F.col("n") * (1 + cutoff / (2 - cutoff)) - 1e-9), F.lit(least))
    longest = F.floor(F.col("n") * (1 + (2 - cutoff) / cutoff) + 1e-9)
    needed = F.array_min(F.transform(F.sequence(shortest, F.greatest(shortest, longest)), lambda t: _least_shared(t, cutoff, q)))
    kept = F.col("n") - (q - 1) - F.greatest(needed, F.lit(1)) + 1
    ranked = (grams.filter(shortest < most) if most else grams).join(order, "gram", "left")
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.coalesce("df", F.lit(0)), "gram", "at"))
    return ranked.withColumn("place", place).withColumn("kept", kept).filter((F.col("place") <= F.col("kept")) & (longest >= shortest)).select("text", "n", "sketch", "gram", "at")


def _meeting(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with ``part``, and for how many tasks: rows of a gram that make many pairs are dealt, those of the right to one part, those of the left to all."""
    counts = left.groupBy("gram").agg(F.count("*").alias("l")).join(right.groupBy("gram").agg(F.count("*").alias("r")), "gram")
    parts = stored(counts.select("gram", (F.col("l") * F.col("r")).alias("pairs"), F.ceil(F.col("l") * F.col("r") / MET).cast("int").alias("parts")), "gram-parts")
    tasks = min(TASKS, parts.agg(F.ceil(F.sum("pairs") / MET)).first()[0] or 1)
    part = F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = [left.join(parts, "gram").withColumn("part", every), right.join(parts, "gram").withColumn("part", part)]
    return *(x.drop("parts", "pairs").repartition(tasks, "gram", "part") for x in dealt), tasks


def likely_pairs(names: DataFrame, entries: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """name, entry: pairs that may reach the cutoff, each once; all that do are among them. names, entries: column text, distinct."""
    sized = lambda df: stored(df.select("text", F.length("text").alias("n"), _sketch("text").alias("sketch")).filter("n > 0"), "sized-names")
    names, entries = sized(names), sized(entries)
    sure = pairs_from(cutoff)
    found = None
    for q, low, high in ((1, 0, sure or None), (2, sure, None)) if sure else ((1, 0, None),):
        grams = _grams(entries, q)
        order = stored(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram-order")
        left = _prefix(_grams(names, q), order, cutoff, q, low, high).select(F.col("text").alias("name"), F.col("n").alias("a"), F.col("sketch").alias("x"), "gram", F.col("at").alias("i"))
        right = _prefix(grams, order, cutoff, q, low, high).select(F.col("text").alias("entry"), F.col("n").alias("b"), F.col("sketch").alias("y"), "gram", F.col("at").alias("j"))
        total = F.col("a") + F.col("b")
        matched = _least_matched(total, cutoff)
        fits = (matched <= F.least("a", "b")) & (F.col("i") - F.col("j") <= F.col("a") - matched) & (F.col("j") - F.col("i") <= F.col("b") - matched) & (total >= low)
        fits = fits & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= total - 2 * matched)
        if high:
            fits = fits & (total < high)
        left, right, tasks = _meeting(stored(left, "name-grams"), stored(right, "entry-grams"))
        met = left.join(right, ["gram", "part"]).filter(fits).select("name", "entry").repartition(tasks, "name", "entry").distinct()
        found = met if found is None else found.unionByName(met)
    return found


def common_letters(left: list[str], right: list[str]) -> np.ndarray:
    """The longest common subsequence of each pair, in letters; the shorter text's length where the left one has more than 64.

    Bit by bit: a column of 64 places for each pair, moved on by a letter of the right text at a time.
    """
    lengths = np.array([len(x) for x in right], dtype=np.int64)
    sizes = np.array([len(x) for x in left], dtype=np.int64)
    codes = np.frombuffer("".join(right).encode("utf-32-le"), dtype=np.uint32)
    letters, at = np.unique(codes, return_inverse=True)
    number = {chr(c): i for i, c in enumerate(letters.tolist())}
    width = int(lengths.max(initial=0))
    text = np.full((len(right), width), len(letters), dtype=np.int64)
    text[np.arange(width) < lengths[:, None]] = at
    own = {x: i for i, x in enumerate(dict.fromkeys(left))}
    masks = np.zeros((len(own), len(letters) + 1), dtype=np.uint64)
    for x, i in own.items():
        bits: dict[int, int] = {}
        for k, c in enumerate(x[:64]):
            if (n := number.get(c)) is not None:
                bits[n] = bits.get(n, 0) | 1 << k
        for n, b in bits.items():
            masks[i, n] = b
    row = np.array([own[x] for x in left], dtype=np.int64)
    free = np.full(len(left), 2**64 - 1, dtype=np.uint64)
    for k in range(width):
        met = free & masks[row, text[:, k]]
        free = (free + met) | (free - met)
    short = np.array([(1 << min(n, 64)) - 1 for n in sizes.tolist()], dtype=np.uint64)
    return np.where(sizes > 64, np.minimum(sizes, lengths), np.bitwise_count(~free & short).astype(np.int64))


def closest_names(names: DataFrame, entries: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """name, entry, ratio: the entry of the largest ratio to each name, from the cutoff on; ties: the greatest entry. Names without one are left out.

    names, entries: column text, distinct. The ratio is ``difflib.SequenceMatcher``'s, with the name as second text.
    """
    ship(names.sparkSession)
    pairs = stored(likely_pairs(names, entries, cutoff), "likely-pairs")
    pairs = pairs.repartition(max(1, min(TASKS, -(-pairs.count() // COMPARED))), "name").sortWithinPartitions("name")

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        matcher, last, out = SequenceMatcher(), None, []
        left, right = left.tolist(), right.tolist()
        for first in range(0, len(left), ROWS):
            own, theirs = left[first : first + ROWS], right[first : first + ROWS]
            for name, entry, common in zip(own, theirs, common_letters(own, theirs).tolist(), strict=True):
                if 2 * common < cutoff * (len(name) + len(entry)) - 1e-9:
                    out.append(0.0)
                    continue
                if name != last:
                    matcher.set_seq2(name)
                    last = name
                matcher.set_seq1(entry)
                out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    scored = pairs.select("name", "entry", ratio("name", "entry").alias("ratio")).filter(F.col("ratio") >= cutoff)
    best = scored.groupBy("name").agg(F.max(F.struct("ratio", "entry")).alias("b"))
    return best.select("name", "b.entry", "b.ratio")


def words_of(c: Column | str) -> Column:
    """The distinct words of a name: what white space, slashes and hyphens part."""
    return F.array_distinct(F.filter(F.split(c, r"[\s/\-]+"), lambda w: w != ""))


def _inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """s, l: texts (columns text, words) of which all words of the first are words of the second, which has the rarest of them."""
    spread = large.select("text", "words", F.explode("words").alias("word"))
    order = spread.groupBy("word").agg(F.count("*").alias("df"))
    own = small.select(F.col("text").alias("s"), F.col("words").alias("own"), F.explode("words").alias("word")).join(order, "word", "left")
    # A word that no large text has settles it: such a set lies in none.
    rarest = own.groupBy("s", "own").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).filter("r.df > 0").select("s", "own", F.col("r.word").alias("word"))
    met = rarest.join(spread, "word").filter(F.size(F.array_except("own", "words")) == 0)
    return met.select("s", F.col("text").alias("l"))


def subset_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """name, entry: of the entries whose words all stand in a name, or that have all its words, the first by pos, then text.

    names: column text, distinct; entries: text, pos. A text without words lies in every other.
    """
    left = stored(names.select("text", words_of("text").alias("words")), "name-words")
    right = stored(entries.select("text", "pos", words_of("text").alias("words")), "entry-words")
    some = lambda df: df.filter(F.size("words") > 0)
    pairs = _inside(some(right), some(left)).select(F.col("l").alias("name"), F.col("s").alias("entry"))
    pairs = pairs.unionByName(_inside(some(left), some(right)).select(F.col("s").alias("name"), F.col("l").alias("entry")))
    first = F.min(F.struct("pos", "text"))
    best = pairs.join(right.select(F.col("text").alias("entry"), "pos"), "entry").groupBy("name").agg(F.min(F.struct("pos", F.col("entry").alias("text"))).alias("b"))
    # Entries without words lie in every name; a name without words lies in every entry.
    empty = right.filter(F.size("words") == 0).agg(first).scalar()
    every = right.agg(first).scalar()
    out = left.select(F.col("text").alias("name"), F.size("words").alias("n")).join(best, "name", "left")
    out = out.select("name", F.when(F.col("n") == 0, every).otherwise(F.least("b", empty)).alias("b"))
    return out.filter("b IS NOT NULL").select("name", F.col("b.text").alias("entry"))
