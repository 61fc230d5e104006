"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the k-grams of a
table of license templates. A hit at document position p and template position t
votes for the diagonal p - t of that template. Votes are summed by diagonal, and
each diagonal is merged with those at most DRIFT behind it (words put in or left
out). A merged span is verified: its distinct template positions, in the order in
which the document has them, must make up enough of the template; by its making
it can't be longer than the template and DRIFT. The words of each hit are
compared, not their hash alone.

Scale: documents are read once. Positions are made from a number sequence and
looked up in the template table inside one code-generated stage, so only hits
and one row per document are shuffled, once, by row. Nothing is grouped by a
word, so frequent words make no hot keys. The template table is broadcast while
its rows are within BROADCAST_ROWS; a larger one is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, letters_words, positions, table

BROADCAST_ROWS = 200_000
#: Length of the k-grams: of phrases of up to three words, and of longer templates.
SHORT, LONG = 2, 4
#: A span is made of diagonals that lie so far apart at most.
DRIFT = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# The phrases and labels of the query contract.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

# Opening words of public license texts and notices.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)


def template_grams(spark, templates) -> DataFrame:
    """One row per template and k-gram position: template, label, base, grams, t, k, gram, h."""
    rows = []
    for number, one in enumerate(templates):
        words = one.text.split()
        k = SHORT if len(words) <= 3 else LONG
        grams = [" ".join(words[t : t + k]) for t in range(len(words) - k + 1)]
        rows += [(number, one.label, one.base, len(grams), len(words), t, k, gram) for t, gram in enumerate(grams)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, length int, t int, k int, gram string")
    split = F.split("gram", " ")
    short = F.xxhash64(F.lit(SHORT), split[0], F.get(split, F.lit(1)))
    long = F.xxhash64(F.lit(LONG), *[F.get(split, F.lit(i)) for i in range(LONG)])
    return grams.withColumn("h", F.when(F.col("k") == SHORT, short).otherwise(long))


def scan_spans(docs: DataFrame, templates=BASE + NOTICES, *, min_share: float = 0.75) -> DataFrame:
    """Spans of templates in documents, and one row (template null) per document.

    Columns: row (a number of the input row), doc_id, n_words, template, label,
    base, first, last (word positions, from 0), places (starts of it in the span),
    share (of the template's k-grams, verified in order, 0 to 1). Spans of less
    than min_share are left out; base templates must be complete.

    Row numbers come from the scan, so docs should be read from files or
    materialised. Null or empty text: no words, no spans. Ties, repeated rows and
    null doc_ids: each input row is scanned by itself. Texts of any length are
    scanned whole. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    header = spark.createDataFrame([(-1, None, None, None, None, 0, 0, "", -1)], grams.schema)
    grams = grams.unionByName(header)
    n_grams = sum(len(one.text.split()) for one in templates) + 1

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), letters_words(F.col("text")).alias("words"))
    at = read.select("row", "doc_id", "words", F.size("words").alias("n_words"), positions(F.col("words"), 2).alias("q"))
    p = F.floor(F.col("q") / 2).cast("int")
    word = lambda i: F.get("words", F.col("p") + i)
    at = at.withColumn("p", p)
    odd = F.col("q") % 2
    key = (
        F.when(F.col("q") < 0, F.lit(-1).cast("long"))
        .when((odd == 0) & (F.col("p") + SHORT <= F.col("n_words")), F.xxhash64(F.lit(SHORT), word(0), word(1)))
        .when((odd == 1) & (F.col("p") + LONG <= F.col("n_words")), F.xxhash64(F.lit(LONG), *[word(i) for i in range(LONG)]))
    )
    seen = F.concat_ws(" ", F.slice("words", F.col("p") + 1, F.col("k")))
    hits = at.withColumn("key", key).join(broadcast_if(grams, n_grams, BROADCAST_ROWS), (F.col("key") == F.col("h")) & ((F.col("q") < 0) | (seen == F.col("gram"))))
    hits = hits.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "template", "label", "base", "grams", "length", "p", (F.col("p") - F.col("t")).alias("diagonal"), "t")

    of = ["row", "doc_id", "n_words", "template", "label", "base", "grams", "length"]
    votes = hits.repartition("row").groupBy(*of, "diagonal").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    near = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    merged = votes.withColumn("near", F.when(F.col("base"), F.array(F.struct("diagonal", "ts"))).otherwise(F.collect_list(F.struct("diagonal", "ts")).over(near)))
    # Of each template position seen, the first place; and of those the ones that no earlier position stands behind.
    first_of = lambda t: F.array_min(F.transform(F.filter("near", lambda x: F.array_contains(x["ts"], t)), lambda x: x["diagonal"] + t))
    merged = merged.withColumn("seen", F.transform(F.array_sort(F.array_distinct(F.flatten("near.ts"))), lambda t: F.struct(t.alias("t"), first_of(t).alias("p"))))
    inverted = lambda x: F.exists("seen", lambda y: (y["t"] < x["t"]) & (y["p"] >= x["p"]))
    merged = merged.withColumn("verified", F.filter("seen", lambda x: ~inverted(x)))
    merged = merged.select(*of, F.array_min("verified.p").alias("first"), F.array_max("verified.p").alias("last"), (F.size("verified") / F.col("grams")).alias("share"))
    headed = F.col("template").isNull() | (F.col("template") < 0)
    merged = merged.where(headed | (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(min_share)))
    # Overlapping spans of a template are one; places of a base template stay apart.
    by = W.partitionBy("row", "template").orderBy("first", "last")
    apart = F.coalesce(F.col("first") > F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)) | F.coalesce(F.col("base"), F.lit(True))
    spans = merged.withColumn("span", F.sum(apart.cast("int")).over(by))
    spans = spans.groupBy(*of, "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("places"), F.max("share").alias("share"))
    k = F.when(F.col("length") <= 3, F.lit(SHORT)).otherwise(F.lit(LONG))
    named = lambda c: F.when(F.col("template") >= 0, c)
    return spans.select("row", "doc_id", "n_words", named(F.col("template")).alias("template"), "label", "base", named(F.col("first")).alias("first"), named(F.col("last") + k - 1).alias("last"), "places", "share")


def scan_licenses(docs: DataFrame, templates=BASE + NOTICES, *, min_share: float = 0.75) -> DataFrame:
    """One row per input row: counts, labels and score of the templates found.

    score is the largest share found of any template: 1 where one is complete, 0
    where none is. The other columns are those of the op2 contract.
    """
    spans = scan_spans(docs, templates, min_share=min_share)
    base = F.coalesce(F.col("base"), F.lit(False))
    labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            labels(F.when(base, F.col("label"))).alias("base_labels"),
            labels(F.when(F.col("template").isNotNull(), F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op2_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result in DuckDB: templates are compared at every position, without hashes."""
    rows = []
    for number, one in enumerate(BASE + NOTICES):
        words = one.text.split()
        k = SHORT if len(words) <= 3 else LONG
        n = len(words) - k + 1
        rows += [f"({number}, '{one.label}', {str(one.base).lower()}, {n}, {len(words)}, {t}, {k}, '{' '.join(words[t : t + k])}')" for t in range(n)]
    return rf"""
WITH grams(template, label, base, grams, length, t, k, gram) AS (VALUES {", ".join(rows)}),
read AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), spots AS (
  SELECT r, words, unnest(range(len(words))) AS p FROM read
), keyed AS (
  SELECT r, p, {SHORT} AS k, array_to_string(words[p + 1 : p + {SHORT}], ' ') AS gram FROM spots WHERE p + {SHORT} <= len(words)
  UNION ALL
  SELECT r, p, {LONG}, array_to_string(words[p + 1 : p + {LONG}], ' ') FROM spots WHERE p + {LONG} <= len(words)
), votes AS (
  SELECT r, template, label, base, grams, p - t AS diagonal, list(t) AS ts FROM keyed JOIN grams USING (k, gram) GROUP BY ALL
), merged AS (
  SELECT r, label, base, grams, CASE WHEN base THEN [{{'d': diagonal, 'ts': ts}}] ELSE list({{'d': diagonal, 'ts': ts}}) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING) END AS near FROM votes
), seen AS (
  SELECT r, label, base, grams, list_transform(list_distinct(flatten(list_transform(near, lambda x: x.ts))), lambda t: {{'t': t, 'p': list_min(list_transform(list_filter(near, lambda x: list_contains(x.ts, t)), lambda x: x.d + t))}}) AS seen FROM merged
), verified AS (
  SELECT r, label, base, grams, list_filter(seen, lambda x: len(list_filter(seen, lambda y: y.t < x.t AND y.p >= x.p)) = 0) AS kept FROM seen
), spans AS (
  SELECT r, label, base, list_min(list_transform(kept, lambda x: x.p)) AS first, len(kept) / grams::DOUBLE AS share FROM verified WHERE len(kept) / grams::DOUBLE >= CASE WHEN base THEN 1 ELSE 0.75 END
), found AS (
  SELECT r, (count(*) FILTER (base))::BIGINT AS n_base, (min(first) FILTER (base))::BIGINT AS first_word, (max(first) FILTER (base))::BIGINT AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM read LEFT JOIN found USING (r)
"""


OP2_SQL = _sql()
