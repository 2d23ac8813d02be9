"""Licence scan: lines against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.llm.common import let, lower_ascii, text_of

LEAST_PERCENT = 80

# Common licence notices, normalised by the scan like the lines they are compared with.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}


def normalised(line: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, and of other characters as they are."""
    return F.array_remove(F.split(lower_ascii(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bigrams(ws: str) -> Column:
    pair = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    return let(F.col(ws), lambda w: F.array_distinct(pair(w)))


def license_lines(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = LEAST_PERCENT) -> DataFrame:
    """``(doc_id, line_no, license, dice)`` of lines at or over ``percent``; a line may match several.

    Sets of bigrams count, so a repeated bigram counts once; lines and templates of fewer than two
    words match nothing, null and empty texts neither. Sizes bound the coefficient: template T of t
    bigrams only meets lines of ``percent t / (200 - percent)`` to ``(200 - percent) t / percent``
    bigrams, so T is keyed by each such size and joined on size. The templates are a parameter of the
    job and fixed in number, so their table is broadcast; lines are never shuffled.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, notice string").withColumn("tw", normalised(F.col("notice"))).where("size(tw) >= 2")
    known = known.withColumn("tb", bigrams("tw")).withColumn(
        "size_of", F.explode(F.expr(f"sequence(int(ceil({percent} * size(tb) / {200 - percent}.0)), int(floor({200 - percent} * size(tb) / {percent}.0)))"))
    ).select("license", "tb", "size_of")
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line")).withColumn("ws", normalised(F.col("line"))).where("size(ws) >= 2")
    lines = lines.select("doc_id", "line_no", bigrams("ws").alias("lb")).withColumn("size_of", F.size("lb"))
    common = F.size(F.array_intersect("lb", "tb"))
    found = lines.join(F.broadcast(known), "size_of").withColumn("common", common)
    return found.where(200 * F.col("common") >= percent * (F.size("lb") + F.size("tb"))).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "license", (2.0 * F.col("common") / (F.size("lb") + F.size("tb"))).alias("dice")
    )


def query(docs: DataFrame) -> DataFrame:
    return license_lines(docs).withColumn("dice", F.round("dice", 6))


SQL = (
    r"""
with t(license, notice) as (values """
    + ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    + r"""),
n as (select license, list_filter(string_split_regex(lower(notice), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from t),
tb as (select license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from n),
l as (select doc_id, unnest(range(len(s))) as line_no, unnest(s) as line from (select doc_id, string_split(coalesce(text,''), chr(10)) as s from documents)),
w as (select doc_id, line_no, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from l),
lb as (select doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from w where len(w) >= 2)
select doc_id, line_no, license, round(2.0::double * len(list_intersect(lb.b, tb.b)) / (len(lb.b) + len(tb.b)), 6) as dice
from lb, tb where 200 * len(list_intersect(lb.b, tb.b)) >= 80 * (len(lb.b) + len(tb.b))
"""
)
