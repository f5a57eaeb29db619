"""License notices in texts by voting on diagonals: equal word 3-grams of a text and of a template lie on one diagonal (place
in the text less place in the template) as long as the text follows the template; words put in or left out shift it a little.

All rolling 3-grams of all texts meet those of the templates in a join. No Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word of a text in which A-Z are lowered (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that must stand word for word, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening notices of common licenses with their labels (fixed values). A span that follows most of one bears its label.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions",
        "mit",
    ),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version",
        "gpl",
    ),
    ("This work is licensed under the GNU General Public License", "gpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies",
        "isc",
    ),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of a gram; the shortest phrase has as many.
GRAM = 3
#: Least share of a notice's words in a span that bears its label, in hundredths; most words that diagonals of one span lie apart.
LEAST_SHARE, MOST_SHIFT = 60, 8


def template_words() -> list[tuple[int, bool, str, list[str]]]:
    """Number, whether it is a phrase, label and words of each template."""
    told = [(True, *p) for p in PHRASES] + [(False, *n) for n in NOTICES]
    return [(i, phrase, label, re.findall(WORD, text.lower())) for i, (phrase, text, label) in enumerate(told)]


def template_grams(spark: SparkSession) -> DataFrame:
    """template, phrase, label, size (words of the template), at (place of the gram in it), t0 to t2 and h, their hash: some two
    hundred rows, as many as the fixed templates have."""
    rows = [(i, phrase, label, len(ws), at, *ws[at : at + GRAM]) for i, phrase, label, ws in template_words() for at in range(len(ws) - GRAM + 1)]
    table = spark.createDataFrame(rows, "template int, phrase boolean, label string, size int, at int, t0 string, t1 string, t2 string")
    return table.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per span and one without a template per text that has none: place (a number of the row), doc_id, n_words, template,
    phrase, label, size, start and end (words from 0, end exclusive), covered (words of the template found in the span).

    Grams that stand on one diagonal of a text and a template are a run. A run goes on from the one before it if it lies within
    ``MOST_SHIFT`` diagonals of it and further on in both text and template; runs of phrases stay alone."""
    told = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_column}`").alias("doc_id"), words(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("ws"))
    after = lambda n: F.slice("ws", n + 1, F.greatest(F.size("ws"), F.lit(1)))
    told = told.select("place", "doc_id", F.size("ws").cast("long").alias("n_words"), F.arrays_zip(F.col("ws").alias("w0"), after(1).alias("w1"), after(2).alias("w2")).alias("grams"))
    grams = told.select("place", "doc_id", "n_words", F.posexplode_outer("grams").alias("pos", "g"))
    grams = grams.select("place", "doc_id", "n_words", "pos", "g.w0", "g.w1", "g.w2", F.when(F.col("g.w2").isNotNull(), F.xxhash64("g.w0", "g.w1", "g.w2")).alias("h"))
    met = grams.join(F.broadcast(template_grams(docs.sparkSession)), "h", "left")
    same = F.coalesce((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), F.lit(False))
    met = met.withColumn("same", same).where("same OR pos = 0 OR pos IS NULL")
    told_once = [F.when(F.col("same"), F.col(c)).alias(c) for c in ("template", "phrase", "label", "size", "at")]
    votes = met.select("place", "doc_id", "n_words", *told_once, F.when(F.col("same"), F.col("pos") - F.col("at")).alias("diagonal")).repartition("place")
    # a template's places are collected: as many as the template has
    runs = votes.groupBy("place", "doc_id", "n_words", "template", "phrase", "label", "size", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    new_words = F.aggregate("ats", F.struct(F.lit(0).alias("sum"), F.lit(-GRAM).alias("last")), lambda s, x: F.struct((s["sum"] + F.least(x - s["last"], F.lit(GRAM))).alias("sum"), x.alias("last")))
    runs = runs.select("*", new_words["sum"].alias("covered"), F.array_min("ats").alias("low"), F.array_max("ats").alias("high")).drop("ats")
    order = Window.partitionBy("place", "template").orderBy(F.col("diagonal") + F.col("low"), "diagonal")
    back = lambda c: F.lag(c).over(order)
    goes_on = ~F.col("phrase") & (F.col("low") >= back("high") + GRAM) & (F.abs(F.col("diagonal") - back("diagonal")) <= MOST_SHIFT)
    runs = runs.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("place", "doc_id", "n_words", "template", "phrase", "label", "size", "span").agg(
        F.min(F.col("diagonal") + F.col("low")).cast("long").alias("start"), F.max(F.col("diagonal") + F.col("high") + GRAM).cast("long").alias("end"), F.sum("covered").alias("covered")
    ).drop("span")


def licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``.

    n_base counts the places of whole phrases, first_word and last_word are the least and greatest of their starts. labels also
    holds those of the notices of which a span covers at least ``LEAST_SHARE`` hundredths; score is the greatest share covered by a
    labelled span, 0 without one. A null text counts as empty; repeated rows and null ids keep their own row each; other columns
    are not looked at. Work and memory of a task follow the text and the fixed templates, also where every text has every notice."""
    whole = F.coalesce(F.col("phrase") & (F.col("covered") == F.col("size")), F.lit(False))
    most = F.coalesce(~F.col("phrase") & (100 * F.col("covered") >= LEAST_SHARE * F.col("size")), F.lit(False))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(docs, id_column, text_column).groupBy("place", "doc_id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("start"))).alias("first_word"), F.max(F.when(whole, F.col("start"))).alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"), joined(F.when(whole | most, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(whole | most, F.col("covered") / F.col("size"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("place")


def oracle() -> str:
    """The same in SQL for DuckDB: words as rows, grams from windows over them."""
    grams = ", ".join(
        f"({i}, {str(phrase).lower()}, '{label}', {len(ws)}, {at}, '{' '.join(ws[at : at + GRAM])}')" for i, phrase, label, ws in template_words() for at in range(len(ws) - GRAM + 1)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
word AS (SELECT place, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
gram AS (SELECT place, pos, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY place ORDER BY pos)),
told(template, phrase, label, size, spot, g) AS (VALUES {grams}),
vote AS (SELECT DISTINCT place, template, phrase, label, size, spot, pos - spot AS diagonal FROM gram JOIN told USING (g)),
gained AS (SELECT *, least({GRAM}, spot - coalesce(lag(spot) OVER (PARTITION BY place, template, diagonal ORDER BY spot), -{GRAM})) AS gain FROM vote),
run AS (SELECT place, template, phrase, label, size, diagonal, sum(gain) AS covered, min(spot) AS low, max(spot) AS high FROM gained GROUP BY ALL),
chained AS (SELECT *, CASE WHEN NOT phrase AND low >= lag(high) OVER o + {GRAM} AND abs(diagonal - lag(diagonal) OVER o) <= {MOST_SHIFT} THEN 0 ELSE 1 END AS begins
  FROM run WINDOW o AS (PARTITION BY place, template ORDER BY diagonal + low, diagonal)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY place, template ORDER BY diagonal + low, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM chained),
span AS (SELECT place, template, phrase, label, size, span, min(diagonal + low) AS start, sum(covered) AS covered FROM numbered GROUP BY ALL),
judged AS (SELECT *, phrase AND covered = size AS whole, NOT phrase AND 100 * covered >= {LEAST_SHARE} * size AS most FROM span),
by_doc AS (
  SELECT place, count(*) FILTER (WHERE whole) AS n_base, min(start) FILTER (WHERE whole) AS first_word, max(start) FILTER (WHERE whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole OR most) AS labels,
    max(covered::DOUBLE / size) FILTER (WHERE whole OR most) AS score
  FROM judged GROUP BY place)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN by_doc USING (place)"""
