"""Licence statements in texts, by an exact set-similarity join of text blocks and templates.

A block is a sentence of a text; it may run over several lines, but not over a blank one. A template is contained in a block if at least ``tenths`` / 10 of its distinct
words stand there. The words are ordered by their frequency over all blocks, the rarest first: a block that
contains a template must hold one of the template's first n - ceil(t n) + 1 words. The join on these words finds
every pair; the lengths, the places of the common word in both ordered sets, which bound what the two can share
before and behind it, and the whole sets decide. Phrases are found beside it, as runs of words. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.arrays import let
from doclake.llm.texts import alnum_words, packed
from doclake.sources.scratch import freeze

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Common statements of licences, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TENTHS = 9     # with 8, a statement of one Creative Commons licence would contain those of its variants
_SENTENCE_END = "(?<=[.!?])\\s+|\\n\\s*\\n"
BROADCAST_ROWS = 10_000     # of the index of templates


def _phrase_starts(w: Column, phrase: list[str]) -> Column:
    """Positions in the array ``w`` where the words of ``phrase`` stand in a row."""
    def places(w):
        def stands(i):
            return reduce(lambda a, b: a & b, [F.get(w, i + k) == F.lit(x) for k, x in enumerate(phrase)])
        found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.coalesce(stands(i), F.lit(False)))
        return F.when(F.array_contains(w, phrase[0]) & F.array_contains(w, phrase[-1]), found).otherwise(
            F.array().cast("array<int>"))
    return let(w, places)


def _blocks(text: Column, vocabulary: list[str], least: int) -> Column:
    """Distinct words of the vocabulary in each block that has at least ``least`` of them."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    in_block = F.transform(F.split(text, _SENTENCE_END), lambda b: F.array_intersect(alnum_words(b), known))
    return F.filter(in_block, lambda b: F.size(b) >= least)


def scanned(docs: DataFrame, carry: list[str] | None = None, templates: dict[str, str] | None = None,
            phrases: dict[str, str] | None = None, tenths: int = TENTHS) -> DataFrame:
    """Per row of ``docs`` its licence findings: ``_row`` (the columns ``carry``), ``n_words, n_base, first_word,
    last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest start
    (null without one). ``labels`` has the labels of phrases and contained templates, ``score`` is the largest
    share of a template in a block, 1 for a phrase. Null and empty texts have no words and no labels; repeated rows
    are scanned each; templates of equal containment all count. Templates without words are in no text.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    sets = {t: sorted(set(t.split())) for t in templates if t.split()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    need = {t: -(-tenths * len(s) // 10) for t, s in sets.items()}
    # the rarest words of every template that a block must meet at least once, whatever the order: used to keep blocks
    least = min(need.values(), default=1)

    base = packed(docs, ["text"], carry).withColumn("_w", alnum_words(F.col("text")))
    starts = {p: _phrase_starts(F.col("_w"), p.split()) for p in phrases}
    rows = base.select(
        "_row", F.size("_w").cast("long").alias("n_words"),
        F.struct(F.lit(0).alias("none"), *[s.alias(f"p{i}") for i, s in enumerate(starts.values())]).alias("_starts"),
        (_blocks(F.coalesce("text", F.lit("")), vocabulary, least) if vocabulary
         else F.array().cast("array<array<string>>")).alias("_blocks"))
    rows = freeze(rows.withColumn("_id", F.monotonically_increasing_id()), "license_blocks")

    blocks = rows.select("_id", F.posexplode("_blocks").alias("block", "words"))
    # frequencies of the template words over all blocks: at most one row per word of the vocabulary
    counts = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect()) if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for t, s in sets.items():
        ranked = sorted(place[w] + 1 for w in s)
        prefixes += [(token, t, templates[t], len(s), need[t], k, ranked)
                     for k, token in enumerate(ranked[:len(s) - need[t] + 1])]
    index = docs.sparkSession.createDataFrame(
        prefixes, "token int, template string, template_label string, n int, need int, pos int, template_words array<int>")
    if prefixes:
        ranks = F.array(*[F.lit(w) for w in order])
        ordered = F.array_sort(F.transform("words", lambda w: F.array_position(ranks, w).cast("int")))
        tokens = blocks.select("_id", ordered.alias("words")).select("_id", "words", F.posexplode("words").alias("at", "token"))
        # a row per word at most that a template may begin with; the caller gives the templates
        small = len(prefixes) <= BROADCAST_ROWS
        size = F.size("words")
        before, behind = F.least("pos", "at"), F.least(F.col("n") - F.col("pos"), size - F.col("at"))
        pairs = (tokens.join(F.broadcast(index) if small else index, "token")
                 .filter(size >= F.col("need"))                   # length filter
                 .filter(before + behind >= F.col("need")))       # positional filter
        share = F.size(F.array_intersect("words", "template_words")) / F.col("n")
        hits = (pairs.withColumn("share", share).filter(F.col("share") * F.col("n") >= F.col("need"))
                .groupBy("_id").agg(F.collect_set("template_label").alias("_labels"), F.max("share").alias("_share")))
    else:
        hits = rows.limit(0).select("_id", F.array().cast("array<string>").alias("_labels"), F.lit(0.0).alias("_share"))

    names = [f"_starts.p{i}" for i in range(len(phrases))]
    all_starts = F.concat(*names) if names else F.array().cast("array<int>")
    found = F.filter(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values())])
                     if names else F.array().cast("array<string>"), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    out = rows.join(hits, "_id", "left").withColumns({"_all": all_starts, "_base": found})
    return out.select(
        "_row", "n_words", F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("_all") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))
