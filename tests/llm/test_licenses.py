"""Licenses of one family that differ in a version or a word."""

import pytest

from sieveline.llm import license_scan

LONG_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
CASES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under the GNU General Public License, version 2 or later", "gpl,gpl-2.0"),
    ("licensed under the gnu general public license version 2; parts licensed under the gnu general public license version 3", "gpl,gpl-2.0,gpl-3.0"),
    ("licensed under the GNU Lesser General Public License version 2.1", "gpl"),
    ("licensed under the GNU Affero General Public License version 3", "gpl"),
    ("licensed under the apache license version 1.1", ""),
    (LONG_CC.format(""), "cc-by-4.0"),
    (LONG_CC.format("-NonCommercial"), "cc-by-nc-4.0"),
    (LONG_CC.format("-Non-Commercial"), "cc-by-nc-4.0"),
    (LONG_CC.format("-ShareAlike"), "cc-by-sa-4.0"),
    (LONG_CC.format("-NonCommercial-ShareAlike"), ""),
    ("licensed under CC BY-SA 4.0, for commercial use see below", "cc-by,cc-by-sa-4.0"),
    ("this library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "gpl,lgpl-2.1"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3.0,gpl"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy it", "unlicense"),
    ("under the following conditions: you may use this software for any purpose", ""),
]


@pytest.mark.parametrize("drop", [0, 1])
def test_every_notice_has_its_label(spark, drop):
    """Each template, in another text and with a word of its middle left out, is found."""
    rows = []
    for i, t in enumerate(license_scan.TEMPLATES):
        w = list(t.words)
        if drop and len(w) > 40:
            del w[20]
        rows.append((i, "some words before " + " ".join(w) + " and some after"))
    got = license_scan.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert license_scan.TEMPLATES[r.doc_id].label in r.labels.split(","), r


@pytest.fixture(scope="module")
def labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r.labels for r in license_scan.label_documents(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_family(labels, i):
    assert labels[i] == CASES[i][1]
