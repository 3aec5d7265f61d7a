"""Text predicates and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache, reduce
from importlib.resources import files
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore of any script, so both sides of a comparison see the same words.
WORD = r"\p{L}\p{N}_"


def low(c: Column | str) -> Column:
    """Lower-case; null counts as empty."""
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def terms(values: Iterable[str]) -> Column:
    values = [v.lower() for v in values]
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def any_in(text: Column, values: Iterable[str]) -> Column:
    """Does the text contain one of the terms anywhere?"""
    return reduce(or_, (F.contains(text, F.lit(v.lower())) for v in values), F.lit(False))


def hits_in(text: Column, values: Iterable[str]) -> Column:
    """How many of the terms the text contains anywhere: a sum that compiles, where a lambda over the terms would be interpreted."""
    return reduce(add, (F.when(F.contains(text, F.lit(v.lower())), 1).otherwise(0) for v in values), F.lit(0))


def bounded(term: str) -> str:
    """The pattern of a term that no word character touches."""
    return f"(^|[^{WORD}]){re.escape(term.lower())}($|[^{WORD}])"


def has_word(text: Column, term: str) -> Column:
    """Does the (lower-case) text hold the term as a word? The pattern is tried only where the term stands at all."""
    return F.contains(text, F.lit(term.lower())) & text.rlike(bounded(term))


def any_word(text: Column, values: Iterable[str]) -> Column:
    """Does the (lower-case) text hold one of the terms as a word?"""
    values = [v.lower() for v in values]
    if not values:
        return F.lit(False)
    return any_in(text, values) & text.rlike(f"(^|[^{WORD}])({'|'.join(map(re.escape, values))})($|[^{WORD}])")


def words_hit(text: Column, values: Iterable[str]) -> Column:
    """How many of the terms stand in the text as words."""
    out = F.lit(0)
    for v in values:
        out = out + has_word(text, v).cast("int")
    return out


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))


@cache
def english_stop_words() -> tuple[str, ...]:
    """The list that lexical retrieval leaves out by default."""
    return tuple(files("sieveline.functions").joinpath("english_stop_words.txt").read_text(encoding="utf-8").split())


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
