"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of a document is hashed and joined with the runs of the license templates.  A match
votes for the diagonal `document position - template position`; the votes are summed per diagonal,
neighbouring diagonals are merged (words put in or left out shift the rest of a license by a few places),
and a merged span counts when enough of the template's runs are in it, the telling last one of a notice among them.  A
span inside a longer one gives way to it: the words of "CC BY" in "CC BY-NC" are no license of their own.

The templates are a short list given by the caller, so their runs are a small table whatever the input;
its size is checked before it is broadcast.  No text is shuffled: only votes and one row per document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_RUNS = 100_000  # above it the runs are joined without a broadcast


@dataclass(frozen=True)
class Template:
    """A license text.  `exact` templates are phrases that count only when whole, and wherever they stand; of a
    `telling` one the last words must be there."""

    label: str
    text: str
    k: int = 4
    exact: bool = False
    telling: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))


# The base phrases and their labels.
BASE = [
    Template("mit", "mit license", 2, True),
    Template("apache", "apache license", 2, True),
    Template("gpl", "general public license", 2, True),
]
# Opening words of public licenses, later parts of them and the notices that point to them.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction"
)
_MIT_RIGHTS = (
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_REST = (
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE "
    "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
    "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
# The Creative Commons licenses and what their names add to "Attribution".
_CC = {
    "cc-by": "", "cc-by-nc": "NonCommercial", "cc-by-nc-nd": "NonCommercial NoDerivatives", "cc-by-nc-sa": "NonCommercial ShareAlike",
    "cc-by-nd": "NoDerivatives", "cc-by-sa": "ShareAlike",
}
NOTICES = [
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
             "in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "Licensed under the Apache License, Version", telling=True),
    Template("bsd", _BSD_GRANT),
    Template("bsd", _BSD_WARRANTY),
    *[Template(label, f"licensed under {label.replace('-', ' ')}", telling=True) for label in _CC],
    *[Template(label, f"licensed under a Creative Commons Attribution {more}", telling=True) for label, more in _CC.items()],
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation"),
    Template("gpl", "licensed under the GNU General Public License", telling=True),
    Template("isc", _ISC_GRANT),
    Template("isc", _ISC_REST),
    Template("isc", f"{_ISC_GRANT} {_ISC_REST}"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", telling=True),
    Template("mit", _MIT_GRANT),
    Template("mit", _MIT_RIGHTS),
    Template("mit", _MIT_WARRANTY),
    Template("mit", f"{_MIT_GRANT} {_MIT_RIGHTS} {_MIT_WARRANTY}"),
    Template("mit", "Released under the MIT License", telling=True),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", telling=True),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_runs(templates: list[Template]) -> list[tuple]:
    """(template, label, exact, telling, n_runs, n_words, k, tpos, run) of every run of k words of every template."""
    rows = []
    for i, t in enumerate(templates):
        n = len(t.words) - t.k + 1
        if n < 1:
            raise ValueError(f"template {t.text!r} is shorter than its k")
        rows += [(i, t.label, t.exact, t.telling, n, len(t.words), t.k, j, " ".join(t.words[j : j + t.k])) for j in range(n)]
    return rows


def scan(
    docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text",
    slack: int = 3, min_cover: float = 0.75,
) -> DataFrame:
    """(id, n_words, spans) for every row of `docs`; a span is (label, exact, start, end, cover).

    `slack`: diagonals up to so many places apart are one span.  `min_cover`: share of the template's runs
    that a span must hold.  `end` is one behind the last matched word.  Spans inside a longer one of a template that is not exact
    are left out; exact ones always stay.  Null and empty texts have no words
    and no spans.  Equal rows give equal results, one each; rows that share an id but not the text are
    scanned apart.  Very long texts are scanned whole, one row per word; an empty table gives an empty result.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    sizes = sorted({t.k for t in templates})
    runs = spark.createDataFrame(
        template_runs(templates),
        "template int, label string, exact boolean, telling boolean, n_runs int, n_words_t int, k int, tpos int, run string",
    ).withColumn("h", F.xxhash64("k", "run"))
    # One row that stands for the document itself, so that documents without a match stay.
    own = spark.createDataFrame([(-1, 0)], "template int, tpos int").withColumn("h", F.xxhash64(F.lit(-1)))
    table = runs.unionByName(own, allowMissingColumns=True)
    if len(template_runs(templates)) <= MAX_TEMPLATE_RUNS:
        table = F.broadcast(table)

    text = F.col(text_col)
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), words_of(text).alias("words")
    )
    wide = max(sizes)
    # One row per word with the words behind it, and one row per document (place -1).
    shifted = F.arrays_zip(*[F.slice("words", j + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{j}") for j in range(wide)])
    placed = source.select("id", "key", F.size("words").alias("n_words"), F.posexplode_outer(shifted).alias("pos", "w"))

    def run(k: int) -> Column:
        return F.concat_ws(" ", *[F.col(f"w.w{j}") for j in range(k)])

    options = [
        F.struct(F.lit(k).alias("k"), run(k).alias("run"), F.xxhash64(F.lit(k), run(k)).alias("h")) for k in sizes
    ]
    is_first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    marker = F.struct(F.lit(-1).alias("k"), F.lit("").alias("run"), F.xxhash64(F.lit(-1)).alias("h"))
    every = F.when(is_first, F.array(marker, *options)).otherwise(F.array(*options))
    hashed = placed.select("id", "key", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), F.explode(every).alias("g"))
    hits = hashed.join(
        table, (F.col("g.h") == F.col("h")) & ((F.col("template") < 0) | ((F.col("g.run") == F.col("run")) & (F.col("g.k") == F.col("k"))))
    )

    votes = hits.groupBy("id", "key", "n_words", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"),
        F.max(F.col("pos") + F.col("k")).alias("last"), F.first("label").alias("label"), F.first("exact").alias("exact"),
        F.first("telling").alias("telling"), F.first("n_runs").alias("n_runs"), F.first("n_words_t").alias("n_words_t"),
    )
    by_diagonal = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    starts = F.when(gap.isNull() | F.col("exact") | (gap > slack), 1).otherwise(0)
    spans = votes.withColumn("new", starts).withColumn("span", F.sum("new").over(by_diagonal)).groupBy(
        "id", "key", "n_words", "template", "span"
    ).agg(
        F.max("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("covered"),
        F.max(F.array_max("tpos")).alias("reached"), F.first("telling").alias("telling"),
        F.min("first").alias("start"), F.max("last").alias("end"), F.first("label").alias("label"),
        F.first("exact").alias("exact"), F.first("n_runs").alias("n_runs"), F.first("n_words_t").alias("n_words_t"),
    )
    cover = F.col("covered") / F.col("n_runs")
    good = (
        F.when(F.col("exact"), F.col("covered") == F.col("n_runs"))
        .otherwise((cover >= min_cover) & (F.col("end") - F.col("start") <= F.col("n_words_t") * 1.25 + slack)
                   & (~F.col("telling") | (F.col("reached") == F.col("n_runs") - 1)))
    )
    marked = spans.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("end_by", F.when(F.col("good") & ~F.col("exact"), F.col("end")))
    # A span gives way to one that starts before it and ends with it or later, or starts with it and ends later.
    in_document = Window.partitionBy("id", "key")
    before = F.max("end_by").over(in_document.orderBy("start").rangeBetween(Window.unboundedPreceding, -1))
    beside = F.max("end_by").over(Window.partitionBy("id", "key", "start"))
    inside = ~F.col("exact") & (F.coalesce(before >= F.col("end"), F.lit(False)) | F.coalesce(beside > F.col("end"), F.lit(False)))
    stays = marked.withColumn("inside", inside)
    found = F.struct("label", "exact", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), cover.alias("cover"))
    per_document = stays.groupBy("id", "key", "n_words").agg(
        F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"),
        F.array_sort(F.collect_list(F.when((F.col("template") >= 0) & F.col("good") & ~F.col("inside"), found))).alias("spans"),
    )
    return per_document.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long"), "spans",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def label_list(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), BASE + NOTICES)
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["start"])
    best = F.array_max(F.transform("spans", lambda s: s["cover"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), label_list(base).alias("base_labels"),
        label_list(F.col("spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _sql() -> str:
    rows = ", ".join(
        f"({i}, '{label}', {exact}, {telling}, {n}, {n_words}, {k}, {j}, '{run}')"
        for i, label, exact, telling, n, n_words, k, j, run in template_runs(BASE + NOTICES)
    )
    sizes = ", ".join(str(k) for k in sorted({t.k for t in BASE + NOTICES}))
    return rf"""
WITH t(template, label, exact, telling, n_runs, n_words_t, k, tpos, run) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT r, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS run
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([{sizes}]) AS k) AS s)),
v AS (SELECT r, template, pos - tpos AS diagonal, list(DISTINCT tpos) AS tpos, min(pos) AS first, max(pos + k) AS last,
      any_value(label) AS label, any_value(exact) AS exact, any_value(telling) AS telling, any_value(n_runs) AS n_runs, any_value(n_words_t) AS n_words_t
      FROM g JOIN t USING (k, run) GROUP BY ALL),
m AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER w > 3, true) THEN 1 ELSE 0 END AS new
      FROM v WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
n AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM m),
s AS (SELECT r, template, span, len(list_distinct(flatten(list(tpos)))) AS covered, max(list_max(tpos)) AS reached, min(first) AS start, max(last) AS stop,
      any_value(label) AS label, any_value(exact) AS exact, any_value(telling) AS telling, any_value(n_runs) AS n_runs, any_value(n_words_t) AS n_words_t
      FROM n GROUP BY ALL),
q AS (SELECT *, covered / n_runs AS cover, CASE WHEN NOT exact THEN stop END AS stop_by FROM s WHERE CASE WHEN exact THEN covered = n_runs
      ELSE covered / n_runs >= 0.75 AND stop - start <= n_words_t * 1.25 + 3 AND (NOT telling OR reached = n_runs - 1) END),
f AS (SELECT * FROM q QUALIFY exact OR NOT (coalesce(max(stop_by) OVER (PARTITION BY r ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= stop, false)
      OR coalesce(max(stop_by) OVER (PARTITION BY r, start) > stop, false))),
a AS (SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score, count(*) AS n_spans FROM f GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN a USING (r)"""


QUERIES = {"op1_license_scans": op1_license_scans}
ORACLES = {"op1_license_scans": _sql()}
