"""License scan by diagonal voting over word k-grams.

The hashes of all rolling word k-grams of a document meet the positions of the templates' k-grams in one Spark join; equal
words are compared, so a hash never counts alone. A hit votes for its diagonal, the place in the document less the place in
the template: the words of one copy lie on one diagonal, a word put in or left out moves the rest to a near one. Diagonals
of a document and template are counted, neighbours merged, and a merged span is verified by the share of the template's
words that its hits cover. Templates of a few words are phrases: they take k = 2 and must be there whole.

Only hits move: the text stays where it is read, and a table of one row per document goes beside the hits. The templates
are a parameter; their grams are broadcast up to ``MAX_BROADCAST`` of them, beyond it the planner joins them.

Null and empty texts have no words, no places, empty labels and score 0. Very long texts are read whole; their hits are
grouped by document, template and diagonal like any others. Repeated rows (one id, one text) give a row each with the same
values; rows of one id and different texts are told apart by the text. An empty table gives no rows. Columns but the id and
the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch, let, lower_ascii

GRAM, PHRASE_GRAM = 4, 2
#: Least share of a template's words that a span covers.
SHARE = 0.75
#: Diagonals of one template are neighbours up to a share of its words.
NEAR = 8
MAX_BROADCAST = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and labels of the contract.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Published license notices, as their owners word them.
NOTICES = [
    ("mit",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("apache",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("gpl",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
     "details."),
    ("agpl",
     "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("lgpl",
     "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means."),
    ("zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
     "for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


@dataclass(frozen=True)
class Template:
    """A text to look for; ``base`` marks the phrases whose places are counted. At least one word."""

    label: str
    text: str
    base: bool = False


TEMPLATES = [Template(label, text, True) for label, text in PHRASES] + [Template(*notice) for notice in NOTICES]


def words_of(text):
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z) text; null has none."""
    def inner(w):
        lead = (F.get(w, F.lit(0)) == "").cast("int")
        trail = (F.get(w, F.size(w) - 1) == "").cast("int")
        return F.slice(w, lead + 1, F.greatest(F.size(w) - lead - trail, F.lit(0)))

    return let(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), inner)


def _rolling(words, k: int):
    """Hashes of the runs of k words, by start."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)]))


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``t, label, base, n, k, hash, offset, gram``: every k-gram of every template with its place."""
    rows = [(i, t.label, t.base, t.text) for i, t in enumerate(templates)]
    words = (spark.createDataFrame(rows, "t int, label string, base boolean, text string")
             .select("t", "label", "base", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
             .withColumn("k", F.when(F.col("base"), F.least(F.lit(PHRASE_GRAM), "n")).otherwise(F.least(F.lit(GRAM), "n"))))
    hashes = F.when(F.col("k") == GRAM, _rolling(F.col("w"), GRAM))
    for k in range(1, GRAM):
        hashes = hashes.when(F.col("k") == k, _rolling(F.col("w"), k))
    return (words.select("*", F.posexplode(hashes).alias("offset", "hash"))
            .select("t", "label", "base", "n", "k", "hash", "offset",
                    F.slice("w", F.col("offset") + 1, F.col("k")).alias("gram")))


def _hits(docs: DataFrame, grams: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """Places of template grams in documents; one row without template (``t`` is null) per document."""
    w = F.col("w")
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    arrays = [F.struct(F.lit(k).alias("k"), _rolling(w, k).alias("hashes")) for k in sizes]
    arrays.append(F.struct(F.lit(0).alias("k"), F.array(F.lit(None).cast("long")).alias("hashes")))
    rolled = (read.select("doc_id", "text_hash", "w", F.inline(F.array(*arrays)))
              .select("doc_id", "text_hash", "w", "k", F.posexplode("hashes").alias("at", "hash")))
    joined = rolled.join(F.broadcast(grams) if broadcast else grams, ["k", "hash"], "left")
    return (joined.where((F.col("k") == 0) | (F.slice("w", F.col("at") + 1, F.col("k")) == F.col("gram")))
            .select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "t", "label", "base", "n",
                    F.col("k").alias("k"), "offset", F.col("at").cast("long").alias("at")))


def spans(docs: DataFrame, templates: list[Template] | None = None, share: float = SHARE,
          scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``: ``doc_id, text_hash, n_words`` of every document, and the verified spans
    ``doc_id, text_hash, label, base, start, stop, share`` (words from 0, ``stop`` excluded)."""
    templates, scratch = TEMPLATES if templates is None else templates, scratch or Scratch(docs.sparkSession)
    grams = template_grams(docs.sparkSession, templates)
    known = grams.groupBy("k").count().collect()
    hits = scratch.keep(_hits(docs.select("doc_id", "text"), grams, sorted(row["k"] for row in known),
                              sum(row["count"] for row in known) <= MAX_BROADCAST), "license-hits")
    doc = ["doc_id", "text_hash"]
    votes = (hits.where("t is not null").withColumn("diagonal", F.col("at") - F.col("offset"))
             .groupBy(*doc, "t", "label", "base", "n", "k", "diagonal").agg(F.collect_set("offset").alias("offsets")))
    order = W.partitionBy(*doc, "t").orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > F.expr(f"n div {NEAR}"))
    merged = (votes.withColumn("far", F.coalesce(far, F.lit(True)).cast("int"))
              .withColumn("span", F.sum("far").over(order.rowsBetween(W.unboundedPreceding, 0)))
              .groupBy(*doc, "t", "label", "base", "n", "k", "span")
              .agg(F.min(F.col("diagonal") + F.array_min("offsets")).alias("start"),
                   F.max(F.col("diagonal") + F.array_max("offsets") + F.col("k")).alias("stop"),
                   F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets")))
    words = F.flatten(F.transform("offsets", lambda o: F.sequence(o, o + F.col("k") - 1)))
    covered = F.size(F.array_distinct(words)) / F.col("n")
    whole = F.when(F.col("base"), covered == 1.0).otherwise(
        (covered >= F.lit(float(share))) & (F.col("stop") - F.col("start") <= 2 * F.col("n")))
    found = merged.where(whole).select(*doc, "label", "base", "start", "stop", covered.alias("share"))
    return hits.where("t is null").select(*doc, "n_words"), found


def scan(docs: DataFrame, templates: list[Template] | None = None, share: float = SHARE,
         scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best share of a template that a verified span covers, 1 for a phrase, 0 without any.
    """
    rows, found = spans(docs, templates, share, scratch)
    base = F.col("base")
    per = found.groupBy("doc_id", "text_hash").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    r, f = rows.alias("r"), per.alias("f")
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash"))
    return r.join(f, same, "left").select(
        "r.doc_id", "r.n_words", F.coalesce("f.n_base", F.lit(0)).cast("long").alias("n_base"), "f.first_word",
        "f.last_word", F.coalesce("f.base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("f.labels", F.lit("")).alias("labels"), F.coalesce("f.score", F.lit(0.0)).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """The query: all templates over whole texts."""
    return scan(docs)


def sql(table: str = "documents", templates: list[Template] | None = None) -> str:
    """The query in DuckDB SQL; ``table`` may be a subquery."""
    def words(column):
        lowered = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    texts = ", ".join("({}, '{}', {}, '{}')".format(i, t.label, t.base, t.text.replace("'", "''"))
                      for i, t in enumerate(TEMPLATES if templates is None else templates))
    return rf"""
with t as (select t, label, base, {words('text')} as w from (values {texts}) x(t, label, base, text)),
k as (select *, len(w) as n, least(len(w), case when base then {PHRASE_GRAM} else {GRAM} end) as k from t),
g as (select t, label, base, n, k, o - 1 as o, list_slice(w, o, o + k - 1) as gram
      from (select *, unnest(range(1, n - k + 2)) as o from k)),
d as (select row_number() over () as r, doc_id, coalesce({words('text')}, []) as w from {table}),
z as (select distinct k from k),
p as (select r, k, i - 1 as i, list_slice(w, i, i + k - 1) as gram
      from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, z where len(w) >= k)),
h as (select r, t, label, base, n, g.k as k, i - o as diagonal, o from p join g on p.k = g.k and p.gram = g.gram),
c as (select *, case when base or coalesce(diagonal - lag(diagonal) over q > n // {NEAR}, true) then 1 else 0 end as far
      from (select distinct r, t, label, base, n, k, diagonal from h) window q as (partition by r, t order by diagonal)),
s as (select *, sum(far) over (partition by r, t order by diagonal) as span from c),
m as (select r, t, label, base, n, span, min(diagonal + o) as start, max(diagonal + o + k) as stop
      from s join h using (r, t, label, base, n, k, diagonal) group by all),
v as (select r, t, span, count(distinct x) as covered from (
        select r, t, span, unnest(range(o, o + k)) as x from s join h using (r, t, label, base, n, k, diagonal))
      group by all),
f as (select r, label, base, start, covered / n as share from m join v using (r, t, span)
      where case when base then covered = n else covered / n >= {SHARE} and stop - start <= 2 * n end),
b as (select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word,
        max(start) filter (base) as last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
        string_agg(distinct label, ',' order by label) as labels, max(share) as score from f group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score
from d left join b using (r)"""
