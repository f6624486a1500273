"""License scans by diagonal voting.

Every pair of neighbouring words of every text is hashed and joined with the places of that pair in the license
templates. A hit at word i of a text and word j of a template votes for the diagonal i - j: a template that stands
in a text whole puts all its votes on one diagonal. Words left out or put in move the votes to a neighbouring one,
so close diagonals are merged; the span they cover is verified by the share of the template it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import text_of
from tastegrid.sources.session import materialize

# Words per hashed gram. The shortest phrases have two words.
GRAM = 2
# Largest step between diagonals that are merged, and the share of a template's grams that a span needs.
DRIFT = 3
COVERAGE = 0.8
# Templates of up to so many grams (some 20 MB) are broadcast; longer lists are joined as the planner sees fit.
BROADCAST_GRAMS = 200_000
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``exact`` templates are phrases: all words, one after the other."""

    name: str
    label: str
    text: str
    exact: bool = False


# Fixed by the contract.
PHRASES = tuple(
    Template(text, label, text, True)
    for text, label in (
        ("gnu general public license", "gpl"),
        ("apache license", "apache"),
        ("cc by", "cc-by"),
        ("mit license", "mit"),
    )
)
# Sentences by which well-known public licenses are stated.
STATEMENTS = (
    Template(
        "mit-grant",
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    Template("apache-notice", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template(
        "gpl-notice",
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    Template("lgpl-name", "lgpl", "gnu lesser general public license"),
    Template("agpl-name", "agpl", "gnu affero general public license"),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-notice", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-nc-name", "cc-by-nc", "licensed under cc by nc"),
    Template("cc-sa-name", "cc-by-sa", "licensed under cc by sa"),
    Template("cc-notice", "cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("rights", "all-rights-reserved", "all rights reserved no part of this"),
)
DEFAULT_TEMPLATES = PHRASES + STATEMENTS


def words_of(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters, after A-Z became a-z.

    ``lower`` does that but for two letters whose lower case is ASCII; texts with one are translated instead.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    small = F.when(text.rlike("[İK]"), F.translate(text, upper, lower)).otherwise(F.lower(text))
    return F.filter(F.split(small, WORD_BREAK), lambda w: w != "")


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(template, label, exact, n_grams, place, w0, w1, gram): one row per gram, so bounded by the templates."""
    rows = []
    for t in templates:
        words = t.text.split()
        if len(words) < GRAM:
            raise ValueError(f"the template {t.name!r} has fewer than {GRAM} words")
        for place in range(len(words) - GRAM + 1):
            rows.append((t.name, t.label, t.exact, len(words) - GRAM + 1, place, *words[place : place + GRAM]))
    kind = "template string, label string, exact boolean, n_grams int, place int, w0 string, w1 string"
    grams = spark.createDataFrame(rows, kind).withColumn("gram", F.xxhash64("w0", "w1"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def votes(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, h, template, label, exact, n_grams, place, at): grams of the texts that stand in a template.

    ``rows`` has (id, h, words). The words are compared besides the hash, so a vote is never a collision.
    """
    pairs = rows.select("id", "h", F.posexplode(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("next"))).alias("at", "pair"))
    pairs = pairs.select("id", "h", "at", F.col("pair.words").alias("a"), F.col("pair.next").alias("b")).where("b is not null")
    hashed = pairs.withColumn("gram", F.xxhash64("a", "b"))
    hits = hashed.join(grams, "gram").where((F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")))
    return hits.select("id", "h", "template", "label", "exact", "n_grams", "place", "at").distinct()


def spans(votes: DataFrame) -> DataFrame:
    """(id, h, template, label, exact, start, end, coverage) of every verified span; start and end are words.

    Votes are first summed by diagonal. For exact templates a diagonal must have them all. For the others,
    diagonals at most ``DRIFT`` apart whose spans touch are merged, and the merged places must cover ``COVERAGE``.
    """
    key = ["id", "h", "template", "label", "exact", "n_grams"]
    diagonals = votes.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    diagonals = materialize(diagonals, "diagonals")
    whole = diagonals.where(F.col("exact") & (F.size("places") == F.col("n_grams")))
    whole = whole.withColumn("coverage", F.lit(1.0))
    loose = diagonals.where(~F.col("exact"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (
        F.col("first") > F.lag("last").over(order) + F.col("n_grams")
    )
    merged = (
        loose.withColumn("run", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("run").over(order))
        .groupBy(*key, "run")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_places"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .withColumn("coverage", F.col("n_places") / F.col("n_grams"))
        .where(F.col("coverage") >= COVERAGE)
    )
    columns = ["id", "h", "template", "label", "exact", "coverage", F.col("first").alias("start"), (F.col("last") + GRAM - 1).alias("end")]
    return whole.select(columns).unionByName(merged.select(columns))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), words_of(text).alias("words"))


def scan(
    docs: DataFrame, templates: Sequence[Template] = DEFAULT_TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, template, label, exact, start, end, coverage) of every license span in the whole texts."""
    grams = template_grams(docs.sparkSession, templates)
    found = spans(votes(_rows(docs, id_col, text_col), grams))
    return found.drop("h").withColumnRenamed("id", id_col)


def license_report(
    docs: DataFrame, templates: Sequence[Template] = DEFAULT_TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of exact templates (phrases), ``first_word`` and ``last_word`` are their
    smallest and largest start, null without any. ``labels`` adds those of the other templates; both are distinct,
    sorted and joined by commas, empty without any. ``score`` is the best coverage of a verified span, else 0.
    Null and empty texts have no words. Rows that repeat id and text each get the same row. A null id is an id
    like any other. Other columns are not read. Templates are a short list; their join follows their size.
    """
    rows = _rows(docs, id_col, text_col)
    sizes = rows.select("id", "h", F.size("words").cast("long").alias("n_words")).alias("d")
    found = spans(votes(rows, template_grams(docs.sparkSession, templates)))
    base = F.col("exact")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    summary = found.groupBy("id", "h").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    summary = materialize(summary, "licenses").alias("s")
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.h") == F.col("s.h"))
    return sizes.join(summary, same, "left").select(
        F.col("d.id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
