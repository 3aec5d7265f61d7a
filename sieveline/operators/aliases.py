"""Aliases found in texts by a multi-pattern automaton: each text is read once, however many aliases there are.

A trie of the lower-case aliases with failure links reports every place where one stands; what touches the place decides whether it
counts. Short or marked aliases stand between white space, some marks, or ends of lines; others between words. Aliases with dots or
hyphens may be written loosely, so where one stands as it is, its pattern finds the first place of any form.

An automaton holds ``AT_ONCE`` aliases. Of a larger table, consecutive parts are scanned for one after another, so no
table is too large, and what the driver and a task hold has a bound. Parts end where a name ends, so what a part finds is final and
nothing found is shuffled; only a name of more than ``AT_ONCE`` aliases lies in several parts, and its finds are brought together.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.shipping import ship

# Aliases that stand only between white space or these marks, and those whose case counts.
STRICT = (
    "c", "r", "go", "js", "ts", "ui", "ux", "ml", "dl", "it", "ad", "wp", "tf", "np", "py", "rl", "ios", "sql", "api", "css", "aws", "gcp",
    "bq", "iac", "iam", "sre", "soc", "etl", "bi", "qa", "eda", "sa", "mv", "os",
)
CASED = ("c", "r", "sta", "ads", "c++")
MARKS = ",/()|;:."

#: Aliases of one automaton.
AT_ONCE = 50_000
FOUND = "name string, n int, at int, length int, evidence string"


class Alias(NamedTuple):
    """An alias: what it stands for, its place among that name's aliases, and itself."""

    name: str
    n: int
    alias: str


def _in_word(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) in ("Nd", "Nl", "Mn", "Me", "Mc", "Pc") or c in "\u200c\u200d"


def _apart(c: str) -> bool:
    """Whether a strict alias may touch this; nothing at all counts as well."""
    return not c or c in MARKS or c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def snippet(text: str, start: int, length: int) -> str:
    """From 40 characters before a place (from 0) to 100 after it, on one line."""
    return text[max(0, start - 40) : start + length + 100].replace("\n", " ").strip(" ")


class Scanner:
    """Finds aliases in texts."""

    def __init__(self, aliases: list[Alias]) -> None:
        import ahocorasick

        self.of: dict[str, list[Alias]] = {}
        for a in aliases:
            if a.alias:
                self.of.setdefault(a.alias.lower(), []).append(a)
        self.automaton = ahocorasick.Automaton()
        for low in self.of:
            self.automaton.add_word(low, low)
        if self.of:
            self.automaton.make_automaton()
        self._patterns: dict[str, object] = {}

    def _pattern(self, alias: str):
        """What finds an alias in any form; only for those that stand in a text as they are."""
        import regex

        if alias not in self._patterns:
            low = alias.strip(" ").lower()
            loose = "".join(r"\.?" if c == "." else r"[\-\s]?" if c == "-" else regex.escape(c) for c in low)
            strict = len(low) <= 3 or low in STRICT
            edge = rf"[\s{regex.escape(MARKS)}]"
            whole = rf"(?:(?<={edge})|^){loose}(?={edge}|$)" if strict else rf"\b{loose}\b"
            cased = len(alias) <= 3 and low in CASED
            self._patterns[alias] = regex.compile(whole, regex.M | regex.U if cased else regex.M | regex.U | regex.I)
        return self._patterns[alias]

    @staticmethod
    def _counts(text: str, low: str, alias: str, start: int) -> bool:
        """Whether an alias that stands at a place stands there for itself."""
        end = start + len(low)
        before, after = text[start - 1 : start], text[end : end + 1]
        if len(low) <= 3 or low in STRICT:
            if len(alias) <= 3 and low in CASED and text[start:end] != low:
                return False
            return _apart(before) and _apart(after)
        word = lambda c: bool(c) and _in_word(c)
        return word(before) != word(low[0]) and word(low[-1]) != word(after)

    def first_places(self, text: str) -> dict[str, tuple[int, int, int]]:
        """Of each name that a text holds: the first of its aliases (n) that counts, where, and how long."""
        best: dict[str, tuple[int, int, int]] = {}
        if not text or not self.of:
            return best
        lower = text.lower()
        plain = len(lower) == len(text)  # else places in one are not those in the other
        by_pattern: set[str] = set()
        done: set[str] = set()
        for end, low in self.automaton.iter(lower):
            if low in done:
                continue
            left = False
            for a in self.of[low]:
                if a.name in best and best[a.name][0] <= a.n:
                    continue
                if not plain or "." in low or "-" in low or low != low.strip(" "):
                    key = a.alias
                    if key not in by_pattern:
                        by_pattern.add(key)
                        if m := self._pattern(key).search(text):
                            best[a.name] = (a.n, m.start(), m.end() - m.start())
                    continue
                start = end - len(low) + 1
                if self._counts(text, low, a.alias, start):
                    best[a.name] = (a.n, start, len(low))
                else:
                    left = True
            if not left and all(a.name in best and best[a.name][0] <= a.n for a in self.of[low]):
                done.add(low)
        return best


_scanners: dict[str, Scanner] = {}


def _scanning(key: str, shared, more: tuple) -> object:
    """more: name and Arrow type of what the rows of aliases hold after the alias."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner([Alias(*a[:3]) for a in shared.value]), {a[:2]: a[2:] for a in shared.value} if more else {}
        scanner, told = _scanners[key]
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                took, rows = [], []
                for i, text in enumerate(part.column(1)):
                    said = text.as_py() or ""
                    for name, (n, at, length) in scanner.first_places(said).items():
                        took.append(i)
                        rows.append((name, n, at + 1, length, snippet(said, at, length), *told.get((name, n), ())))
                names, kinds = ["name", "n", "at", "length", "evidence"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                if more:
                    names, kinds = [*names, "alias", *(x for x, _ in more)], [*kinds, pa.string(), *(k for _, k in more)]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *names])

    return run


def _parts(aliases: DataFrame, order: tuple[str, str], at_once: int, more: Iterable[str] = ()) -> Iterator[tuple[list[tuple], bool]]:
    """Consecutive parts of a table of aliases in the order of two columns, which tell its rows apart, and whether the part's only name may go on.

    A part ends with the last of a name's rows, unless one name alone fills it. One empty part of an empty table.
    """
    rest, none = aliases, True
    while True:
        rows = [tuple(r) for r in rest.select(*order, "alias", *more).orderBy(*order).limit(at_once + 1).collect()]
        last = len(rows) <= at_once
        open_name = False
        if not last:
            following = rows.pop()[0]
            whole = [r for r in rows if r[0] != following]
            open_name = not whole
            rows = whole or rows
        if rows or none:
            yield rows, open_name
        if last:
            return
        none, (a, b) = False, rows[-1][:2]
        rest = aliases.filter((F.col(order[0]) > a) | ((F.col(order[0]) == a) & (F.col(order[1]) > b)))


def first_aliases(texts: DataFrame, aliases: DataFrame, at_once: int = AT_ONCE, more: Iterable[str] = ()) -> DataFrame:
    """id, name, n, at (from 1), length, evidence: of each name that a text holds, the first of its aliases that does, at its first place.

    texts: id, text, an id once; aliases: name, n (the alias's place among the name's), alias. With ``more``, columns of aliases, the found alias and those follow.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, more = texts.sparkSession, tuple(more)
    ship(spark)
    kinds = tuple((c, to_arrow_type(aliases.schema[c].dataType)) for c in more)
    schema = ", ".join([f"id {texts.schema['id'].dataType.simpleString()}", FOUND, *(["alias string"] if more else []), *(f"`{c}` {aliases.schema[c].dataType.simpleString()}" for c in more)])
    found, split, before = [], set(), False
    for rows, goes_on in _parts(aliases, ("name", "n"), at_once, more):
        if goes_on or before:
            split.add(rows[0][0])
        before = goes_on
        found.append(texts.select("id", "text").mapInArrow(_scanning(uuid.uuid4().hex, spark.sparkContext.broadcast(rows), kinds), schema))
    every = reduce(DataFrame.unionByName, found)
    if not split:
        return every
    # A name that alone fills a part is found by several.
    several = every.filter(F.col("name").isin(*split)).groupBy("id", "name").agg(F.min_by(F.struct(*every.columns[2:]), "n").alias("b")).select("id", "name", "b.*")
    return every.filter(~F.col("name").isin(*split)).unionByName(several)


def _inside(key: str, shared) -> object:
    def run(batches) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        if key not in _scanners:
            _scanners.clear()
            automaton = ahocorasick.Automaton()
            for alias, _, _ in shared.value:
                automaton.add_word(alias, alias)
            if shared.value:
                automaton.make_automaton()
            _scanners[key] = automaton
        automaton = _scanners[key]
        for batch in batches:
            best = []
            for text in batch.column(0).to_pylist():
                held = (x for _, x in automaton.iter(text)) if text and len(automaton) else ()
                best.append(max(held, key=lambda x: (len(x), x.encode()), default=None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], ["text", "alias"])

    return run


def longest_inside(texts: DataFrame, aliases: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """text, alias: the longest alias that stands anywhere in a text (ties: the greatest); texts without one are left out.

    texts: column text, distinct; aliases: column alias, distinct and not empty.
    """
    spark = texts.sparkSession
    ship(spark)
    rows = aliases.select("alias", F.lit(0).alias("n"))
    found = [texts.select("text").mapInArrow(_inside(uuid.uuid4().hex, spark.sparkContext.broadcast(part)), "text string, alias string") for part, _ in _parts(rows.withColumn("key", F.col("alias")), ("key", "n"), at_once)]
    every = reduce(DataFrame.unionByName, found).filter("alias IS NOT NULL")
    if len(found) == 1:
        return every
    return every.groupBy("text").agg(F.max(F.struct(F.length("alias").alias("l"), "alias"))["alias"].alias("alias"))
