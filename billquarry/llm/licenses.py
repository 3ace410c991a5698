"""License scans: a positional index of rare words, intersected by relative position, then mandatory phrases.

Every template lists its rarest words with their places in it; rarity is counted over all documents. A word of a text
that is in the index votes for (template, own place minus the word's place): votes for one such start come from words that
stand as in the template. A start with enough of the template's rare words is a candidate, and it counts if all phrases
that the license cannot do without stand inside it. Phrases are found by the same votes, all of whose words must agree.
Everything is SQL: texts are split once, and only words of templates and phrases leave their row, with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import stash

#: Words that end a word, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base rules and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as their licenses word them, each with its label and the phrases it cannot do without.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "without restriction"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["licensed under cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]
#: Rare words of a template, letters such a word has at least, share of them a candidate needs in percent, words of slack around it.
RARE, LETTERS, SHARE, SLACK = 6, 5, 60, 5


def _vocabulary() -> tuple[list[str], list[str]]:
    """All words of templates and phrases, and those of enough letters: every phrase and template has one of the latter."""
    lists = [*BASE_PHRASES, *(t for _, t, _ in TEMPLATES), *(p for _, _, ps in TEMPLATES for p in ps)]
    words = sorted({w for text in lists for w in text.split()})
    return words, [w for w in words if len(w) >= LETTERS]


def _text_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def postings() -> tuple[list[tuple], list[tuple]]:
    """(template, label, length, word, place) of every longer word, its first place; (phrase, length, word, place) of every phrase word."""
    of_templates = [
        (n, label, len(text.split()), w, text.split().index(w)) for n, (label, text, _) in enumerate(TEMPLATES) for w in sorted(set(text.split())) if len(w) >= LETTERS
    ]
    phrases = sorted({*BASE_PHRASES, *(p for _, _, ps in TEMPLATES for p in ps)})
    return of_templates, [(p, len(p.split()), w, k) for p in phrases for k, w in enumerate(p.split())]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``.

    ``doc_id``, ``n_words``; ``n_base`` places of base phrases, ``first_word`` and ``last_word`` (their smallest and largest
    start) and ``base_labels``; ``labels`` (base and method, distinct, sorted, joined by commas; empty if none); ``score``: 1
    with a base phrase, otherwise the largest share of a template's rare words that stand in place (0 if none does).
    A missing or empty text has no words; texts of any length are split whole; rows repeat as given; other columns are not used.
    """
    spark = docs.sparkSession
    every, longer = _vocabulary()
    # lower() also changes letters beyond A-Z; those are word characters before and after, and no word above holds one
    words = f"array_remove(split(lower(coalesce(text, '')), r'{SEPARATORS}'), '')"
    hits = f"filter(transform(words, (w, i) -> IF(w IN ({_text_list(every)}), struct(w AS word, CAST(i AS BIGINT) AS place), NULL)), h -> h IS NOT NULL)"
    split = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(words).alias("words"))
    read = stash(
        split.select(
            "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.expr(f"IF(arrays_overlap(words, array({_text_list(longer)})), {hits}, NULL)").alias("hits")
        ),
        "license-words",
    )
    # one set of places for all copies of a text
    places = read.where("hits IS NOT NULL").select("text_hash", F.explode("hits").alias("h")).select("text_hash", "h.word", "h.place").distinct()
    places = stash(places, "license-places")
    held_by = read.where("hits IS NOT NULL").select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("held_by"))

    # the tables of templates and phrases are constants of this module: they are broadcast, and no key of theirs is a task
    of_templates, of_phrases = postings()
    known = spark.createDataFrame(of_templates, "template int, label string, size int, word string, at int")
    ranked = known.join(held_by, "word", "left").withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY template ORDER BY coalesce(held_by, 0), at)")
    )
    rare = ranked.where(F.col("rank") <= RARE).select("template", "label", "size", "word", "at", F.expr("count(*) OVER (PARTITION BY template)").alias("of"))
    votes = places.join(F.broadcast(rare), "word").groupBy("text_hash", "template", "label", "size", "of", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))

    phrases = spark.createDataFrame(of_phrases, "phrase string, words int, word string, at int")
    found = places.join(F.broadcast(phrases), "word").groupBy("text_hash", "phrase", "words", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("n"))
    found = stash(found.where("n = words").select("text_hash", "phrase", "words", "start"), "license-phrases")

    needed = spark.createDataFrame([(n, p, len(ps)) for n, (_, _, ps) in enumerate(TEMPLATES) for p in ps], "template int, phrase string, needs int")
    shares = votes.withColumn("share", F.col("votes") / F.col("of"))
    candidates = shares.where(100 * F.col("votes") >= SHARE * F.col("of")).alias("c")
    inside = candidates.join(F.broadcast(needed.alias("n")), "template").join(found.alias("f"), ["text_hash", "phrase"]).where(
        f"f.start >= c.start - {SLACK} AND f.start + f.words <= c.start + c.size + {SLACK}"
    )
    verified = inside.groupBy("text_hash", "template", "label", "needs", F.col("c.start").alias("start")).agg(F.countDistinct("phrase").alias("have")).where("have = needs")

    base = spark.createDataFrame(list(BASE_PHRASES.items()), "phrase string, base_label string")
    of_base = found.join(F.broadcast(base), "phrase").groupBy("text_hash").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("base_label").alias("base_set")
    )
    of_method = verified.groupBy("text_hash").agg(F.collect_set("label").alias("method_set"))
    of_votes = shares.groupBy("text_hash").agg(F.max("share").alias("share"))
    # written down, so that the last join is fed by shuffles alone and a text of many documents can be split
    results = stash(of_votes.join(of_base, "text_hash", "full").join(of_method, "text_hash", "left"), "license-results")
    joined = read.select("doc_id", "text_hash", "n_words").join(results, "text_hash", "left")
    none = F.expr("CAST(array() AS array<string>)")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base_set", none), F.coalesce("method_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
