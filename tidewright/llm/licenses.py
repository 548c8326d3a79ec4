"""Operator 11 (native): license scans by an exact set-similarity join.

Documents are cut into overlapping blocks of words. Blocks and templates are sets of words, in
one global order, the rarest word of the corpus first. A template whose words a block must hold
to a share cannot miss all of the template's first few words (its prefix), so templates are
indexed by those alone; blocks look up their words, pairs go by length and by how much the two
places leave to be equal, and what is left is compared word set by word set. Phrases are templates
to be held whole, and their places are then looked for in order. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Words that begin a block of their own; a block is twice as long, so any stretch of so many words lies in one.
STEP = 32
#: Index entries (template words) up to which the index is broadcast; it grows with the templates only.
INDEX = 100_000

#: Phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices, the share of their distinct words that a block must hold, and their labels.
NOTICES = (
    ("agpl", 1.0, "gnu affero general public license"),
    ("apache-2", 0.8, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", 0.8, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", 1.0, "creative commons attribution 4 0 international license"),
    ("cc-by-sa", 1.0, "creative commons attribution sharealike"),
    ("cc0", 1.0, "cc0 1 0 universal public domain dedication"),
    ("gpl", 0.8, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 1.0, "licensed under the gnu general public license"),
    ("isc", 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", 1.0, "gnu lesser general public license"),
    ("mit", 0.8, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", 0.8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 0.8, "this is free and unencumbered software released into the public domain"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII of a text in which A-Z are lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


class Template(NamedTuple):
    label: str
    words: list[str]
    #: Distinct words, rarest first, and how many of them a block must hold.
    tokens: list[str]
    least: int
    ordered: bool

    @property
    def prefix(self) -> list[str]:
        return self.tokens[: len(self.tokens) - self.least + 1]


def ranked(docs: DataFrame, known: list[str], text_col: str) -> list[str]:
    """The templates' words, those that are rarest in all documents first (ties by the word)."""
    each = docs.select(F.explode(F.filter(words(F.col(text_col)), lambda w: w.isin(known))).alias("w"))
    count = {r.w: r["count"] for r in each.groupBy("w").count().collect()}  # the templates' words at most
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def license_scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, float, str]] = NOTICES, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a phrase's words stand in a row, first_word and last_word are the smallest and largest
    of them (words from 0, null without one); base_labels are the labels of these phrases, labels those
    of the notices too that some block of 2 * step words (every step words) holds to their share; score is the largest share held, 0
    without a label. Labels are sorted and joined by commas. A null or empty text has no words; a
    null id is a value like any other; rows that repeat are each returned; texts of any length are cut into blocks.
    Other columns are not read. Phrases and notices of over `step` words are an error.
    """
    spark = docs.sparkSession
    split = {text: text.translate(str.maketrans(UPPER, LOWER)).split() for _, text in phrases} | {text: text.translate(str.maketrans(UPPER, LOWER)).split() for _, _, text in notices}
    if any(not 0 < len(w) <= step for w in split.values()):
        raise ValueError(f"phrases and notices have 1 to {step} words")
    order = ranked(docs, sorted({w for ws in split.values() for w in ws}), text_col)
    place = {w: i for i, w in enumerate(order)}
    asked = [(label, 1.0, text, True) for label, text in phrases] + [(label, share, text, False) for label, share, text in notices]
    made = []
    for label, share, text, ordered in asked:
        tokens = sorted(set(split[text]), key=place.__getitem__)
        made.append(Template(label, split[text], tokens, max(1, math.ceil(share * len(tokens) - 1e-9)), ordered))
    prefixes = sorted({w for t in made for w in t.prefix})
    entries = [(w, i, *t) for t in made for i, w in enumerate(t.prefix)]
    index = spark.createDataFrame(entries, "token string, i int, label string, phrase array<string>, tokens array<string>, least int, ordered boolean")
    if len(entries) <= INDEX:
        index = F.broadcast(index)

    def blocks(ws: Column) -> Column:
        """(k, part) of the blocks that hold a word of a prefix, after one without words that stands for the document."""
        hits = F.array_compact(F.transform(ws, lambda w, i: F.when(w.isin(prefixes), i)))
        near = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(F.floor(p / step) - 1, F.floor(p / step)))))
        cut = F.transform(F.filter(near, lambda k: k >= 0), lambda k: F.struct(k.alias("k"), F.slice(ws, (k * step + 1).cast("int"), 2 * step).alias("part")))
        return F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("k"), F.array().cast("array<string>").alias("part"))), cut)

    keys = ["doc_id", "_th", "_len"]
    text = F.col(text_col)
    told = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), blocks(ws).alias("blocks")))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_th"), F.length(text).alias("_len"), told.alias("_d")).select(*keys, F.col("_d.n").alias("n"), F.explode("_d.blocks").alias("b"))
    found = let(F.array_intersect(F.lit(order), F.col("b.part")), lambda ts: F.array_compact(F.transform(ts, lambda t, j: F.when(t.isin(prefixes), F.struct(t.alias("token"), (F.size(ts) - j).alias("left"))))))
    probes = cut.select(*keys, "n", "b.k", "b.part", F.explode_outer(found).alias("p")).select(*keys, "n", "k", "part", "p.token", "p.left")
    # length and position: what the block, and the template, still have from this word on must be enough
    fits = (F.col("left") >= F.col("least")) & (F.size("tokens") - F.col("i") >= F.col("least"))
    met = probes.join(index.withColumnRenamed("token", "_token"), (F.col("token") == F.col("_token")) & fits, "left")
    held = met.withColumn("same", F.when(F.col("_token").isNotNull(), F.size(F.array_intersect("tokens", "part"))))
    good = F.col("same") >= F.col("least")
    at = F.filter(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.slice("part", i + 1, F.size("phrase")) == F.col("phrase"))
    laid = held.select(*keys, "n", "k", "label", "ordered", F.when(good, F.col("same") / F.size("tokens")).alias("share"), F.when(good & F.col("ordered"), at).alias("at"))
    base = F.size("at") > 0
    some = F.when(base | (~F.col("ordered") & F.col("share").isNotNull()), F.col("label"))
    each = laid.groupBy(*keys).agg(
        F.sum((F.col("k") == -1).cast("long")).alias("copies"), F.max("n").alias("n_words"), F.sum(F.when(base, F.size("at")).otherwise(0)).alias("places"),
        F.min(F.when(base, F.col("k") * step + F.array_min("at"))).alias("first_word"), F.max(F.when(base, F.col("k") * step + F.array_max("at"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"), F.collect_set(some).alias("all"), F.max(F.when(some.isNotNull(), F.col("share"))).alias("score"),
    )
    # rows of one id and text are alike, so they were counted together
    one = each.select(
        "doc_id", "n_words", F.expr("places div copies").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort("all"), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    )
    return one.drop("_copy")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def _list(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p(label, ph) AS (VALUES {", ".join(f"('{label}', {_list(text.split())})" for label, text in PHRASES)}),
s(label, share, ts) AS (VALUES {", ".join(f"('{label}', {share}, list_distinct({_list(text.split())}))" for label, share, text in NOTICES)}),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
b AS (SELECT w.rid, p.label, w.i FROM w JOIN p ON w.w = p.ph[1] JOIN d ON d.rid = w.rid WHERE d.ws[w.i + 1 : w.i + len(p.ph)] = p.ph),
k AS (SELECT rid, ws[k * {STEP} + 1 : k * {STEP} + {2 * STEP}] AS part FROM (SELECT rid, ws, unnest(range((len(ws) + {STEP - 1}) // {STEP})) AS k FROM d)),
h AS (SELECT rid, label, len(list_intersect(ts, part)) / len(ts) AS share FROM k CROSS JOIN s WHERE len(list_intersect(ts, part)) >= ceil(share * len(ts) - 1e-9)),
bs AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT rid, label, 1.0 AS share FROM b UNION ALL SELECT rid, label, share FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid)
"""
