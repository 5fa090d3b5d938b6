"""Operator 1: license scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram of every text is joined by hash to the places where license templates hold it. A
hit at word p of the text and word q of a template votes for the diagonal p - q: words copied from the
template vote for one diagonal. Neighbouring diagonals of a template, which a few inserted or missing words
make, are merged, and a span counts if enough of the template's k-grams stand in it.

The templates are a fixed parameter, so the join broadcasts a few hundred rows whatever the corpus size.
The hash only finds hits: each is compared word by word. Only hits are shuffled, in fixed-size rows.

Defined results: a null or wordless text has no labels, null places and score 0; repeated rows and repeated
or null ids are scanned row by row (they are told apart by a row number); other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import documents, let, upto

#: Phrases whose every place counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of well-known license notices, and the labels they stand for.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]

K = 3
#: Diagonals this close are one match.
MERGE = 3
#: Share of a template's k-grams, in hundredths, that make a match.
COVER = 70

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one non-ASCII letter that lower() turns into an ASCII one (k); a private character takes its place.
KELVIN, INSTEAD = "\u212a", "\ue000"


def words_of(text: Column) -> Column:
    """Lower-cased words. Beyond ASCII, letters are lower-cased too; that changes neither the number of the
    words nor whether one equals an ASCII word."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(INSTEAD)))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def phrase_places(words: Column) -> Column:
    """Struct (start, bit) for each place of a base phrase; bit i stands for the i-th phrase."""
    hit = [(phrase.split(), 1 << i) for i, phrase in enumerate(PHRASES)]

    def at(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("int")
        for parts, bit in hit:
            test = F.get(w, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                test = test & (F.get(w, i + k) == part)
            out = F.when(test, F.lit(bit)).otherwise(out)
        return F.struct(i.cast("long").alias("start"), out.alias("bit"))

    def found(w: Column) -> Column:
        firsts = F.arrays_overlap(w, F.array(*[F.lit(p[0]) for p, _ in hit]))
        starts = F.filter(upto(F.size(w) - 1), lambda i: at(w, i)["bit"].isNotNull())
        none = F.array().cast("array<struct<start:bigint,bit:int>>")
        return F.when(firsts, F.transform(starts, lambda i: at(w, i))).otherwise(none)

    return let(words, found)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, tpos, w0 .. wk-1, n_grams): a fixed, small table."""
    rows = []
    for t, (_, text) in enumerate(templates):
        w = text.split()
        rows += [(t, i, len(w) - k + 1, *w[i : i + k]) for i in range(len(w) - k + 1)]
    names = ", ".join(f"w{i} string" for i in range(k))
    return spark.createDataFrame(rows, f"template int, tpos int, n_grams int, {names}")


def votes(df: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """For each row of ``df`` (doc_id, text) one row with template -1 that carries the base columns, and one
    for each (template, diagonal) with votes."""
    words = F.col("words")
    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select(
        "row", "doc_id", "words",
        phrase_places(words).alias("places"),
        F.concat(
            F.array(F.lit(None).cast("long")),
            let(words, lambda w: F.transform(upto(F.size(w) - (k - 1)), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))),
        ).alias("hashes"),
    )
    grams = template_grams(df.sparkSession, templates, k)
    grams = grams.withColumn("hash", F.xxhash64(*(f"w{j}" for j in range(k))))
    none = grams.limit(0)
    carrier = df.sparkSession.range(1).select(
        *[(F.lit(-1) if f.name == "template" else F.lit(None)).cast(f.dataType).alias(f.name) for f in none.schema.fields]
    )
    table = F.broadcast(grams.unionByName(carrier))
    hits = rows.select("row", "doc_id", "words", "places", F.posexplode_outer("hashes").alias("at", "h"))
    same = F.lit(True)
    for j in range(k):
        same = same & (F.get(F.col("words"), F.col("at") - 1 + j) == F.col(f"w{j}"))
    carrier_row = F.col("template") < 0
    hits = hits.join(table, F.col("h").eqNullSafe(F.col("hash")) & (carrier_row | same), "inner")
    starts = F.transform("places", lambda x: x["start"])
    mask = F.aggregate("places", F.lit(0), lambda acc, x: acc.bitwiseOR(x["bit"]))
    of_base = {"n_words": F.size("words").cast("long"), "n_base": F.size("places").cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts), "base_mask": mask}
    return (
        hits.select(
            "row", "doc_id", "template", "n_grams",
            F.when(carrier_row, 0).otherwise(F.col("at") - 1 - F.col("tpos")).alias("diagonal"),
            (F.col("at") - 1).alias("pos"),
            *[F.when(carrier_row, v).alias(c) for c, v in of_base.items()],
        )
        .groupBy("row", "template", "diagonal")
        .agg(
            F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
            *[F.max(c).alias(c) for c in ("doc_id", "n_grams", *of_base)],
        )
    )


def spans(voted: DataFrame, k: int = K) -> DataFrame:
    """Merged diagonals: (row, template, n_grams, votes, first_place, last_place), verified or not."""
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    lines = voted.withColumn("opens", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(w) > MERGE).cast("int"))
    lines = lines.withColumn("cluster", F.sum("opens").over(w))
    return lines.groupBy("row", "template", "cluster").agg(
        F.least(F.sum("votes"), F.max("n_grams").cast("long")).alias("votes"),
        F.min("lo").alias("first_place"),
        (F.max("hi") + (k - 1)).alias("last_place"),
        *[F.max(c).alias(c) for c in ("doc_id", "n_grams", "n_words", "n_base", "first_word", "last_word", "base_mask")],
    )


def verified(span: DataFrame, k: int = K) -> DataFrame:
    """Adds ``cover`` (0 to 1) and ``found``: enough of the template stands there, without long gaps."""
    length = F.col("last_place") - F.col("first_place") + 1
    dense = (F.col("template") >= 0) & (2 * length <= 3 * (F.col("n_grams") + k - 1))
    cover = F.col("votes") / F.col("n_grams")
    return span.withColumn("cover", F.when(dense, cover).otherwise(0.0)).withColumn(
        "found", dense & (100 * F.col("votes") >= COVER * F.col("n_grams"))
    )


def scan(df: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): base columns, all labels and the score."""
    label = F.lit(None).cast("string")
    for t, (name, _) in enumerate(templates):
        label = F.when(F.col("template") == t, F.lit(name)).otherwise(label)
    found = verified(spans(votes(df, templates)))
    per_row = found.groupBy("row").agg(
        F.max("cover").alias("cover"),
        F.collect_set(F.when(F.col("found"), label)).alias("found"),
        *[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_mask")],
    )
    base = [F.when(F.col("base_mask").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(PHRASES.values())]
    base = F.array_sort(F.array_compact(F.array(*base)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("cover"))
    return per_row.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found"))), ",").alias("labels"),
        score.alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


def _sql() -> str:
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({t}, '{label}', {text.split()!r})" for t, (label, text) in enumerate(TEMPLATES))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH phrases AS (SELECT col0 AS parts, col1 AS label FROM (VALUES {phrases})),
templates AS (SELECT col0 AS template, col1 AS label, col2 AS parts FROM (VALUES {templates})),
grams AS (SELECT template, q, len(parts) - {K - 1} AS n_grams, parts[q:q+{K - 1}] AS gram
    FROM (SELECT *, unnest(range(1, len(parts) - {K - 2})) AS q FROM templates)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{capitals}', '{small}'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
b AS (SELECT doc_id, i - 1 AS start, label FROM p JOIN phrases ON words[i] = parts[1] AND words[i:i + len(parts) - 1] = parts),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
hits AS (SELECT doc_id, template, n_grams, i AS pos, i - q AS diagonal FROM p JOIN grams ON p.words[i:i+{K - 1}] = gram),
lines AS (SELECT doc_id, template, diagonal, any_value(n_grams) AS n_grams, count(*) AS votes, min(pos) AS lo, max(pos) AS hi
    FROM hits GROUP BY ALL),
opened AS (SELECT *, (diagonal - lag(diagonal, 1, -1000000000) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {MERGE})::INT AS opens FROM lines),
clusters AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM opened),
span AS (SELECT doc_id, template, any_value(n_grams) AS n_grams, least(sum(votes), any_value(n_grams)) AS votes,
    max(hi) + {K - 1} - min(lo) + 1 AS length FROM clusters GROUP BY doc_id, template, cluster),
checked AS (SELECT *, 2 * length <= 3 * (n_grams + {K - 1}) AS dense FROM span),
found AS (SELECT doc_id, max(CASE WHEN dense THEN votes::DOUBLE / n_grams ELSE 0 END) AS cover FROM checked GROUP BY doc_id),
every AS (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM checked JOIN templates USING (template)
    WHERE dense AND 100 * votes >= {COVER} * n_grams),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    (CASE WHEN n_base > 0 THEN 1 ELSE coalesce(cover, 0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


SQL = _sql()
