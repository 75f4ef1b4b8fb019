"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A block is WINDOW words, every STEP words; a template's words are a set. Blocks that contain at
least SHARE of a template are found exactly:

* words are ordered by how many documents have them, rarest first (the order comes from the
  whole table, for the words of the templates);
* prefix filter: a block with enough of a template of m words, c of them needed, has one of its
  m - c + 1 rarest, so only documents with such a word are cut into blocks, and only such words
  are join keys;
* length filter: a block needs c template words at all;
* positional filter: from the joined word on, both sides must still hold enough words.

What passes is decided on the sets. Notices of Creative Commons licences hold nearly the same words;
which one a block names is read off the words after "creative commons attribution" (``variants``).
Everything is DataFrame expressions.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import written

# fixed values: what counts as a word, and the phrases of the base labels
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# fixed values: opening sentences of common notices
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
           "associated documentation files to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance "
                "with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted "
           "provided that the following conditions are met",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# fixed values: licences whose notices differ in the words after "creative commons attribution" only
VARIANTS = ("cc-by", "cc-by-nc")
SIGNS = ("noncommercial", "sharealike", "noderivatives", "noderivs")
SHARE = 80  # percent of a template that a block must contain
WINDOW, STEP = 64, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, in order; null is the empty text."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which ``phrase`` starts."""
    parts = phrase.split()

    def here(i):
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    rarest = max(parts, key=len)
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return (F.when((F.size(words) >= len(parts)) & F.array_contains(words, rarest), spots)
            .otherwise(F.array().cast("array<int>")))


def variants(words: Column) -> Column:
    """For every word the kind it tells of Creative Commons licences, null for nearly all words.

    The kind of "creative commons attribution" is cc-by, cc-by-nc, or other with further conditions;
    that of a word of SIGNS, wherever it stands, is the word.
    """
    def named(i):
        def at(k):
            return F.get(words, i + k)

        def other(k):
            return (at(k).isin(*SIGNS[1:]) | ((at(k) == "share") & (at(k + 1) == "alike"))
                    | ((at(k) == "no") & at(k + 1).startswith("deriv")))

        def noncommercial(k):
            return F.when(other(k), "other").otherwise("cc-by-nc")

        return (F.when(at(1) == "noncommercial", noncommercial(2))
                .when((at(1) == "non") & (at(2) == "commercial"), noncommercial(3))
                .when(other(1), "other").otherwise("cc-by"))

    def kind(w, i):
        full = (F.get(words, i - 2) == "creative") & (F.get(words, i - 1) == "commons")
        return F.when(w.isin(*SIGNS), w).when((w == "attribution") & full, named(i))

    return F.transform(words, kind)


def _told_apart(label: Column, kinds: Column) -> Column:
    """Whether a block with ``kinds`` can bear ``label``; without a full name, its signs decide."""
    full = F.arrays_overlap(kinds, _strings([*VARIANTS, "other"]))
    plain = ~F.arrays_overlap(kinds, _strings(SIGNS[1:]))
    return (F.when(~label.isin(*VARIANTS), True).when(full, F.array_contains(kinds, label))
            .otherwise(plain & (F.array_contains(kinds, SIGNS[0]) == (label == "cc-by-nc"))))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _order(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of every template word, rarest in the corpus first. At most len(vocabulary) rows are collected."""
    counted = rows.select(F.explode("known").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counted}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}


def _least(templates: dict[str, str], share: int) -> int:
    """Template words that any block must have."""
    return min(ceil(len(set(t.split())) * share / 100) for t in templates.values())


def blocks_of(words: Column, kinds: Column, vocabulary: list[str]) -> Column:
    """(start, words, kinds) of every block: its template words and the kinds it tells. Each block looks at its own
    words alone, so the work is linear in the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(STEP))
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.array_intersect(F.slice(words, s + 1, F.lit(WINDOW)), _strings(vocabulary)).alias("words"),
        # a name that starts in the block counts, though its third word stands behind the end
        F.array_compact(F.slice(kinds, s + 1, F.lit(WINDOW + 2))).alias("kinds")))


def matches(rows: DataFrame, templates: dict[str, str] = TEMPLATES, share: int = SHARE) -> DataFrame:
    """(doc_id, h, start, label, shared, needed, size) of every block of ``rows`` that contains enough of a
    template. ``rows``: doc_id, h, the template words ``known`` of the text, and its ``blocks``."""
    spark = rows.sparkSession
    sets = {label: set(text.split()) for label, text in templates.items()}
    rank = _order(rows, sorted(set().union(*sets.values())))
    ordered = sorted(rank, key=rank.get)
    prefixes = []
    for label, tokens in sets.items():
        sorted_ = sorted(tokens, key=rank.get)
        need = ceil(len(sorted_) * share / 100)
        prefixes += [(w, label, i, len(sorted_), need, sorted_) for i, w in enumerate(sorted_[:len(sorted_) - need + 1])]
    table = spark.createDataFrame(
        prefixes, "word string, label string, place int, size int, needed int, template array<string>")
    keys = _strings(sorted({p[0] for p in prefixes}))
    blocks = (rows.where(F.arrays_overlap("known", keys)).select("doc_id", "h", F.inline("blocks"))
              # template words of the block in the global order
              .select("doc_id", "h", "start", F.array_intersect(_strings(ordered), F.col("words")).alias("block"), "kinds"))
    joined = blocks.select("doc_id", "h", "start", "block", "kinds", F.posexplode("block").alias("at", "word")).join(
        F.broadcast(table), "word")  # as many rows as the templates have prefix words
    left = F.least(F.size("block") - F.col("at"), F.col("size") - F.col("place"))
    # words before the joined one can be shared too; they are the smaller of both counts
    earlier = F.least("at", "place")
    passed = (joined.where((F.size("block") >= F.col("needed")) & (earlier + left >= F.col("needed")))
              .withColumn("shared", F.size(F.array_intersect("block", "template")))
              .where("shared >= needed").where(_told_apart(F.col("label"), F.col("kinds"))))
    return passed.select("doc_id", "h", "start", "label", "shared", "needed", "size").distinct()


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest
    and largest start (null without any); ``labels`` adds those of templates found, of VARIANTS only
    the licences that are named. Labels are
    distinct, sorted and joined by commas; none is the empty text. ``score`` is 1 where a phrase
    stands, else the largest share of a template in a block that passed, else 0. Null and empty
    texts have no words. Equal rows get equal results. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("h"), words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    spots = {label: places(F.col("words"), phrase) for label, phrase in PHRASES.items()}
    known = F.array_intersect("words", _strings(vocabulary))
    least = _least(templates, share)
    # the one pass over the texts; the rest works on blocks with enough template words
    rows = rows.select("doc_id", "h", "words", known.alias("known"), F.when(F.size(known) >= least, variants(F.col("words"))).alias("kinds"))
    rich = F.when(F.size("known") >= least, F.filter(
        blocks_of(F.col("words"), F.col("kinds"), vocabulary), lambda b: F.size(b["words"]) >= least))
    rows = written(rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), "known", rich.alias("blocks"),
                               *[x.alias(f"at_{i}") for i, x in enumerate(spots.values())]), "words")
    hits = (matches(rows, templates, share).groupBy("doc_id", "h")
            .agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("share"))
            .select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"), "found", "share"))
    every = F.concat(*[f"at_{i}" for i in range(len(spots))])
    named = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(spots)]))
    based = rows.select("doc_id", "h", "n_words", every.alias("at"), named.alias("base"))
    joined = based.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    both = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
