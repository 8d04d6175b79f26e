"""License scans: phrases in place, and an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of the whole text, across line ends; for a template of m words it is m / CONTAINED
words long, or shorter at the end of the text. It matches when it holds at least CONTAINED of the template's distinct
words. Blocks that start at a template word suffice: any other block holds no more than the next one that does.

The words that occur in any template are ordered by the number of blocks that hold them, rarest first. A match shares its
rarest common word with the template's prefix, so blocks are joined to templates by the words of both prefixes only; the
number of words of a block and the places of the shared word in both orders bound the overlap before it is counted in
full. Everything is SQL functions.

A null text counts as empty: no words, no labels, score 0. Repeated rows and null ids are judged row by row: rows are
told apart by hashes of doc_id and text. An empty table gives an empty result; other columns are never read. One text is
held whole in one task, with a list of its different blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import keep

# The phrases and labels that are counted, and the templates with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
CONTAINED = 0.8
Templates = tuple[tuple[str, str], ...]
#: A word of lower-cased text, as the complement of all other ASCII; spelled out it is found several times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Distinct words of a template."""
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def need(size: int) -> int:
    """Fewest words that a match with a template of ``size`` distinct words shares with it."""
    return ceil(CONTAINED * size - 1e-9)


def width(text: str) -> int:
    """Words of a block that is compared with a template."""
    return ceil(len(re.findall("[0-9a-z]+", text.lower())) / CONTAINED - 1e-9)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _vocabulary(templates: Templates) -> list[str]:
    return sorted({w for _, t in templates for w in words_of(t)})


def _blocks(entries: Column, templates: Templates) -> Column:
    """Different (width, least, held) of one text's template words (at, word): blocks with enough words of equally wide templates."""
    number = {w: i for i, w in enumerate(_vocabulary(templates))}
    kinds: dict[tuple[int, int], set[int]] = {}
    for _, t in templates:
        kinds.setdefault((width(t), need(len(words_of(t)))), set()).update(number[w] for w in words_of(t))

    def block(x: Column, j: Column, wide: int, least: int, own: list[int]) -> Column:
        near = F.filter(F.slice(entries, j + 1, F.lit(wide)), lambda y: (y["at"] < x["at"] + wide) & y["word"].isin(own))
        held = F.array_sort(F.array_distinct(F.transform(near, lambda y: y["word"])))
        dense = x["word"].isin(own) & (F.get(entries, j + (least - 1))["at"] < x["at"] + wide)
        return F.when(dense, F.struct(F.lit(wide).alias("width"), F.lit(least).alias("least"), held.alias("held")))

    def starting(x: Column, j: Column) -> Column:
        every = F.array(*[block(x, j, wide, least, sorted(own)) for (wide, least), own in sorted(kinds.items())])
        return F.filter(every, lambda b: b.isNotNull() & (F.size(b["held"]) >= b["least"]))

    return F.array_distinct(F.flatten(F.transform(entries, starting)))


def read_words(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """doc_id, a, b, n_words, a list of places for each phrase's label, and blocks: the text's blocks with enough template words."""
    text = F.coalesce("text", F.lit(""))
    vocabulary = _vocabulary(templates)
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)])

    def starts(words: Column, phrase: str) -> Column:
        """Places of a phrase: of the words alike to its last, those with the others in front."""
        *front, last = phrase.split()
        ends = F.filter(F.transform(words, lambda w, i: F.when(w == last, i)), lambda i: i.isNotNull() & (i >= len(front)))
        fits = lambda i: reduce(and_, [F.get(words, i - len(front) + k) == w for k, w in enumerate(front)])
        return F.transform(F.filter(ends, fits), lambda i: i - len(front))

    def counted(words: Column) -> Column:
        entry = lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), numbers[w].alias("word")))
        entries = F.filter(F.transform(words, entry), lambda e: e.isNotNull())
        hopeful = F.when(F.array_contains(words, "license"), words).otherwise(F.array().cast("array<string>"))
        places = _bound(hopeful, lambda w: F.struct(*[starts(w, p).alias(label) for p, label in PHRASES.items()]))
        blocks = _bound(entries, lambda e: _blocks(e, templates))
        return F.struct(F.size(words).cast("long").alias("n_words"), blocks.alias("blocks"), places.alias("at"))

    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64(text).alias("b"), _bound(words, counted).alias("made"))
    return keep(rows.select("doc_id", "a", "b", "made.n_words", "made.blocks", *[f"made.at.{x}" for x in PHRASES.values()]))


def template_matches(rows: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """(a, b, label, share) from ``read_words``: the greatest contained share for each row and label that any block of it matches."""
    blocks = rows.select("a", "b", F.explode("blocks").alias("block")).select("a", "b", "block.*")
    counts = blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect()  # at most one row per template word
    seen, vocabulary = {r["word"]: r["count"] for r in counts}, _vocabulary(templates)
    number = {w: i for i, w in enumerate(vocabulary)}
    order = sorted(range(len(vocabulary)), key=lambda i: (seen.get(i, 0), i))
    place = {i: k for k, i in enumerate(order)}
    sets = [sorted(place[number[w]] for w in words_of(t)) for _, t in templates]
    prefixes = rows.sparkSession.createDataFrame(
        [
            (label, width(t), s, need(len(s)), at, word)
            for (label, t), s in zip(templates, sets)
            for at, word in enumerate(s[: len(s) - need(len(s)) + 1])
        ],
        "label string, width int, words array<int>, least int, at int, word int",
    )
    places = F.array(*[F.lit(place[i]) for i in range(len(vocabulary))])
    ranked = blocks.select("a", "b", "width", "least", F.array_sort(F.transform("held", lambda i: F.get(places, i))).alias("held"))
    own = ranked.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)).alias("j", "word"))
    hopeful = own.join(F.broadcast(prefixes), ["width", "least", "word"])
    hopeful = hopeful.where(1 + F.least(F.size("held") - F.col("j") - 1, F.size("words") - F.col("at") - 1) >= F.col("least"))
    overlap = F.size(F.array_intersect("held", "words"))
    matched = hopeful.where(overlap >= F.col("least")).select("a", "b", "label", (overlap / F.size("words")).alias("share"))
    return matched.groupBy("a", "b", "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    The score is 1 where a phrase stands, else the greatest share of a template that a block holds, else 0. ``templates`` are
    (label, text) pairs, a table that the driver holds.
    """
    rows = read_words(docs, templates)
    found = template_matches(rows, templates).groupBy("a", "b").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    places = F.concat(*PHRASES.values())
    base = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in PHRASES.values()]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "a", "b", "n_words", places.alias("places"), F.array_sort(base).alias("base"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.join(found, ["a", "b"], "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

