"""License notices in texts, found by diagonal voting.

All rolling k-grams of a text's words are joined with the positions of the same k-grams in the
templates. A match at word p of the text and q of a template votes for diagonal p - q; the votes of a
copied passage fall on one diagonal, or on neighbouring ones where words were put in or left out.
Neighbouring diagonals are merged, and a merged span counts if it covers enough of its template
densely enough, covers its template's telling words (versions, nc, sa), and holds no word that names another
license of the same family (``UNLIKE``). Grams are compared word for word beside their hashes. Everything is DataFrame
expressions; the templates (``license_templates.txt``) are a small fixed table of grams, so that join is a broadcast.

Short phrases give labels of their own (``PHRASES``), counted at every place where they stand.

Cases: a null text counts as empty; repeated rows give repeated results; texts of fewer words than a
gram are only searched for phrases; an empty table gives an empty result; other columns of the input
are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass
from importlib.resources import files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stored, text_or_empty

GRAM = 3
#: Diagonals so near are merged; spans need this share of their own words, and their template's share of the template.
NEAR, DENSITY = 3, 0.5
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """A notice: its label, the share of its words that a span must cover, and its words."""

    label: str
    coverage: float
    words: tuple[str, ...]


def read_templates(text: str) -> tuple[Template, ...]:
    """The notices of a text: "== label share", then words up to the next; # begins a comment."""
    out: list[list] = []
    for line in text.splitlines():
        if line.startswith("=="):
            _, label, share = line.split()
            out.append([label, float(share), []])
        elif not line.startswith("#"):
            out[-1][2] += re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower())
    return tuple(Template(label, share, tuple(words)) for label, share, words in out)


TEMPLATES = read_templates(files("sieveline.llm").joinpath("license_templates.txt").read_text(encoding="utf-8"))
_NC, _SA, _ND = ("nc", "noncommercial", "commercial"), ("sa", "sharealike", "alike"), ("nd", "noderivatives", "noderivs", "derivatives", "derivs")
#: Words that, inside a span, make it the notice of another license.
UNLIKE = {
    "gpl-2.0": ("lesser", "library", "affero"), "gpl-3.0": ("lesser", "library", "affero"), "cc-by-4.0": (*_NC, *_SA, *_ND), "cc-by-nc-4.0": (*_SA, *_ND),
    "cc-by-sa-4.0": (*_NC, *_ND),
}
TELLING = tuple(sorted({w for ws in UNLIKE.values() for w in ws}))
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    # The Kelvin sign is the one character beyond ASCII whose lower case is ASCII; it must not become k.
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("µ"))), _BETWEEN), "")


def needed_places(template: Template) -> list[int]:
    """Where a template's telling words stand, which a span must cover: versions, nc, sa."""
    return [q for q, w in enumerate(template.words) if w.isdigit() and template.label != "bsd" or w in TELLING]


def _grams(spark, size: int) -> DataFrame:
    """gram_hash, template_gram, at: where each distinct gram of the templates stands."""
    at = defaultdict(list)
    for t, one in enumerate(TEMPLATES):
        for q in range(len(one.words) - size + 1):
            at[" ".join(one.words[q : q + size])].append({"template": t, "q": q})
    rows = json.dumps([{"gram": g, "at": v} for g, v in at.items()])
    parsed = F.from_json(F.lit(rows), "array<struct<gram:string,at:array<struct<template:int,q:int>>>>")
    return spark.range(1).select(F.inline(parsed)).select(F.xxhash64("gram").alias("gram_hash"), F.col("gram").alias("template_gram"), "at")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words, phrase places) and verified spans (row, label, first, last, score)."""
    spark = docs.sparkSession
    longest = max(len(p.split()) for p, _ in PHRASES)
    assert longest <= size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(text_or_empty(text)).alias("words"))
    # A document's first element stands for itself, so that every document leaves a row; the others are its grams.
    ahead = [F.slice("words", i + 1, F.size("words")) for i in range(size)]
    zipped = F.arrays_zip(*(a.alias(f"w{i}") for i, a in enumerate(ahead)))
    itself = F.array(F.struct(*(F.lit("").alias(f"w{i}") for i in range(size))))
    each = rows.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(itself, zipped)).alias("p", "w"))
    gram = F.concat_ws(" ", *(F.col(f"w.w{i}") for i in range(size)))
    each = each.select("row", "doc_id", "n_words", (F.col("p") - 1).alias("p"), gram.alias("gram"))
    phrase: Column = F.lit(None).cast("int")
    for i, (p, _) in enumerate(PHRASES):
        phrase = F.when((F.col("gram") == p) | F.startswith("gram", F.lit(p + " ")), i).otherwise(phrase)
    marked = each.withColumn("gram_hash", F.xxhash64("gram")).withColumn("phrase", phrase)
    marked = marked.withColumn("telling", F.when(F.substring_index("gram", " ", 1).isin(*TELLING), F.substring_index("gram", " ", 1)))
    found = marked.join(F.broadcast(_grams(spark, size)), "gram_hash", "left")
    at = F.when(F.col("gram") == F.col("template_gram"), F.col("at"))
    kept = found.select("row", "doc_id", "n_words", "p", "phrase", "telling", at.alias("at")).filter("p < 0 OR phrase IS NOT NULL OR telling IS NOT NULL OR at IS NOT NULL")
    kept = stored(kept, "license-grams")

    places = F.when(F.col("phrase").isNotNull(), F.col("p"))
    documents = kept.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.count("phrase").alias("n_base"),
        F.min(places).cast("long").alias("first_word"), F.max(places).cast("long").alias("last_word"), F.collect_set("phrase").alias("phrases"),
    )

    votes = kept.filter("at IS NOT NULL").select("row", "p", F.inline("at")).withColumn("diagonal", F.col("p") - F.col("q"))
    lines = votes.groupBy("row", "template", "diagonal").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR) | (F.col("first") - F.lag("last").over(by_diagonal) > size + NEAR)
    lines = lines.withColumn("band", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(by_diagonal))
    bands = lines.groupBy("row", "template", "band").agg(F.min("first").alias("first"), (F.max("last") + size).alias("last"), F.flatten(F.collect_list("qs")).alias("qs"))
    covered = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + size - 1))))
    lengths = F.array(*(F.lit(len(x.words)) for x in TEMPLATES))
    shares = F.array(*(F.lit(x.coverage) for x in TEMPLATES))
    labels = F.array(*(F.lit(x.label) for x in TEMPLATES))
    needed = F.array(*(F.array(*map(F.lit, needed_places(x))).cast("array<int>") for x in TEMPLATES))
    unlike = F.array(*(F.array(*map(F.lit, UNLIKE.get(x.label, ()))).cast("array<string>") for x in TEMPLATES))
    bands = bands.withColumn("places", covered).withColumn("covered", F.size("places")).withColumn("score", F.col("covered") / F.get(lengths, F.col("template")))
    all_needed = F.size(F.array_except(F.get(needed, F.col("template")), F.col("places").cast("array<int>"))) == 0
    spans = bands.filter((F.col("score") >= F.get(shares, F.col("template"))) & (F.col("covered") >= DENSITY * (F.col("last") - F.col("first"))) & all_needed).drop("qs", "places")
    others = kept.filter("telling IS NOT NULL").select(F.col("row").alias("other_row"), F.col("p").alias("other_p"), "telling")
    inside = (F.col("row") == F.col("other_row")) & F.col("other_p").between(F.col("first"), F.col("last") - 1)
    spans = spans.join(others, inside & F.array_contains(F.get(unlike, F.col("template")), F.col("telling")), "left_anti")
    return documents, spans.select("row", F.get(labels, F.col("template")).alias("label"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "score")


def label_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of ``docs``."""
    documents, spans = scan(docs, id_col, text)
    own = spans.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    names = F.array(*(F.lit(label) for _, label in PHRASES))
    base = F.array_distinct(F.transform("phrases", lambda i: F.get(names, i)))
    every = F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>"))))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return documents.join(own, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(base).alias("base_labels"), join(every).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
