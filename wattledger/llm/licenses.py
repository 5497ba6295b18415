"""Licence scan: phrases that stand word for word, and an exact set-similarity join with licence templates.

Text blocks are windows of words, as long as two of the longest template.  A block meets a template when it has at least ``threshold`` of the template's
different words.  Tokens are ordered by their frequency in the whole corpus, rarest first.  A block that meets a
template shares one of the template's first |T| - need + 1 tokens (prefix filter), has at least ``need`` words of the
templates' vocabulary (length filter), and after the first shared token enough of both are left (positional filter).
Only texts with a prefix token are taken apart.  All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.llm.common import ascii_lower
from wattledger.session import cut

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"),
)
#: Notices of common licences and of their neighbours, as their publishers print them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("lgpl-2", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: Licences whose notices differ in a word or two.  Of such neighbours only those with the largest share
#: of their words in a block label it, of these those with the most words.
FAMILIES = {"gpl-2": "gnu", "gpl-3": "gnu", "lgpl-2": "gnu", "agpl-3": "gnu", "cc-by": "cc", "cc-by-nc": "cc", "cc-by-sa": "cc"}
THRESHOLD = 0.8


def step_of(templates=TEMPLATES) -> int:
    """Words from one block to the next: as many as the longest template has.  A block is two steps long, so that every
    stretch of a template's length lies whole in one."""
    return max(len(text.split()) for _, text in templates)


#: What lies between words, and a word's pattern: letters, digits and everything beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, label, different words) of each template."""
    return [(i, label, list(dict.fromkeys(text.split()))) for i, (label, text) in enumerate(templates)]


def _places(padded, phrase: str):
    return F.regexp_count(padded, F.lit(f" {phrase}(?= )"))


def _word_at(padded, place):
    """Number of the word that begins after the space at ``place`` (from 1)."""
    before = F.substring(padded, F.lit(1), place)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "))) - 1).cast("bigint")


def words_of(text):
    """The text's words with one space before, between and after them; ' ' for none."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _phrases(rows: DataFrame, phrases) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base (labels) to rows with ``padded``."""
    padded = F.col("padded")
    counted = rows.withColumn(
        "n_words", (F.length(padded) - F.length(F.replace(padded, F.lit(" "))) - 1).cast("bigint")
    ).withColumn("found", F.array(*[_places(padded, p).cast("bigint") for p, _ in phrases]))
    first, last, labels = [], [], []
    flipped = F.reverse(padded)
    for i, (phrase, label) in enumerate(phrases):
        has = F.col("found")[i] > 0
        mark = f" {phrase} "
        first.append(F.when(has, _word_at(padded, F.instr(padded, mark))))
        back = F.length(padded) - F.instr(flipped, mark[::-1]) - len(mark) + 2
        last.append(F.when(has, _word_at(padded, back)))
        labels.append(F.when(has, F.lit(label)))
    return counted.select(
        "*", F.aggregate("found", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_base"),
        F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    ).drop("found")


def token_ranks(docs: DataFrame, text: str, templates=TEMPLATES) -> list[str]:
    """The templates' words from the rarest to the most frequent in all texts, ties by name.

    There are as many rows as template words, whatever the corpus.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, _, ws in template_words(templates) for w in ws})
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    words = docs.select(F.explode(F.split(words_of(F.col(text)), " ")).alias("word"))
    counts = words.join(F.broadcast(known), "word").groupBy("word").count()
    return [r["word"] for r in known.join(counts, "word", "left").orderBy(F.coalesce("count", F.lit(0)), "word").collect()]


def containments(rows: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, met, best): the labels of templates that a block of the row meets, and the largest containment.

    ``rows`` has rid and padded.  Rows that meet no template are not in the result.  Of a family the nearest count.
    """
    spark, step = rows.sparkSession, step_of(templates)
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for number, label, words in template_words(templates):
        need = math.ceil(round(threshold * len(words), 9))
        for i, w in enumerate(sorted(words, key=rank.__getitem__)):
            entries.append((number, label, rank[w], i, len(words), need, i <= len(words) - need))
    index = spark.createDataFrame(entries, "template int, label string, token int, i int, size int, need int, prefix boolean")
    ranks = spark.createDataFrame(sorted(rank.items()), "word string, token int")
    # The templates and their words are fixed values: what is broadcast does not grow.
    tokens = (
        rows.select("rid", F.posexplode(F.split(F.trim("padded"), " ")).alias("pos", "word"))
        .join(F.broadcast(ranks), "word")
        .select("rid", "token", F.explode(F.filter(
            F.array(F.floor(F.col("pos") / step).cast("int"), F.floor(F.col("pos") / step).cast("int") - 1), lambda b: b >= 0
        )).alias("block"))
        .distinct()
    )
    one = W.partitionBy("rid", "block")
    sets = tokens.withColumn("j", F.row_number().over(one.orderBy("token")) - 1).withColumn("have", F.count("*").over(one))
    left = F.least(F.col("size") - F.col("i"), F.col("have") - F.col("j"))
    candidates = (
        sets.join(F.broadcast(index.filter("prefix")), "token")
        .filter((F.col("have") >= F.col("need")) & (left >= F.col("need")))
        .select("rid", "block", "template").distinct()
    )
    shared = (
        candidates.join(sets.select("rid", "block", "token"), ["rid", "block"])
        .join(F.broadcast(index.select("template", "token", "label", "size", "need")), ["template", "token"])
        .groupBy("rid", "block", "template", "label", "size", "need").agg(F.count("*").alias("overlap"))
        .filter("overlap >= need")
    )
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(FAMILIES.items()) for x in pair]), F.col("label")), F.col("label"))
    share = F.col("overlap") / F.col("size")
    nearest = W.partitionBy("rid", "block", "family").orderBy(share.desc(), F.col("size").desc())
    kept = shared.withColumn("family", family).withColumn("place", F.rank().over(nearest)).filter("place = 1")
    return kept.groupBy("rid").agg(F.collect_set("label").alias("met"), F.max(share).alias("best"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Words are runs of a-z, A-Z lower-cased, digits and all beyond ASCII; a null text has none.  ``score`` is 1 where a
    phrase stands, else the largest containment that meets the threshold, else 0.  Repeated rows and null keys are rows
    of their own.
    """
    order = token_ranks(docs, text, templates)
    rank = {w: i for i, w in enumerate(order)}
    heads = set()
    for _, _, words in template_words(templates):
        need = math.ceil(round(threshold * len(words), 9))
        heads |= set(sorted(words, key=rank.__getitem__)[: len(words) - need + 1])
    has_head = F.col("padded").rlike(f" (?:{'|'.join(sorted(heads))}) ")
    rows = _phrases(docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("padded")), phrases)
    # Numbered once: the written rows keep their numbers whatever is computed again.
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("padded", F.when(has_head, F.col("padded"))))
    met = containments(rows.filter("padded is not null").select("rid", "padded"), order, templates, threshold)
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return rows.drop("padded").join(met, "rid", "left").select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of ``scan`` over documents, by plain word positions and plain set overlaps."""
    phrase_rows = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases)
    step = step_of(templates)
    kinds = " ".join(f"WHEN '{label}' THEN '{family}'" for label, family in sorted(FAMILIES.items()))
    template_rows = ", ".join(
        f"({i}, '{label}', '{w}', {len(ws)}, {math.ceil(round(threshold * len(ws), 9))})"
        for i, label, ws in template_words(templates) for w in ws
    )
    length = " ".join(f"WHEN {n} THEN {' || '.join(f'''coalesce(w[i + {k}], '')''' + (''' || ' ' ''' if k + 1 < n else '') for k in range(n))}" for n in sorted({len(p.split()) for p, _ in phrases}))
    return f"""
WITH phrases(phrase, label, n) AS (VALUES {phrase_rows}),
templates(t, label, word, size, need) AS (VALUES {template_rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT rid, i, label FROM p, phrases WHERE phrase = CASE n {length} END),
base AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM hit GROUP BY rid),
tok AS (SELECT rid, w[i] AS word, (i - 1) // {step} AS b FROM p WHERE w[i] IN (SELECT word FROM templates)),
blocks AS (SELECT rid, word, b FROM tok UNION SELECT rid, word, b - 1 FROM tok WHERE b > 0),
hits AS (SELECT rid, t, label, size, need, b, count(*) AS overlap FROM blocks JOIN templates USING (word) GROUP BY ALL HAVING count(*) >= need),
met AS (SELECT * FROM hits QUALIFY rank() OVER (PARTITION BY rid, b, CASE label {kinds} ELSE label END ORDER BY overlap / size DESC, size DESC) = 1),
best AS (SELECT rid, max(overlap / size) AS best, list(DISTINCT label) AS labels FROM met GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN best USING (rid)"""
