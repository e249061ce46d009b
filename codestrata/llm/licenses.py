"""Licence scans with a positional index of rare words, in built-in functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: The phrases every scan counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wordings of common licence notices: label, key phrases of which each must stand in the text, wording.
TEMPLATES = [
    ("mit", ("permission is hereby granted free of charge",),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction"),
    ("mit", ("mit license",), "this project is licensed under the mit license"),
    ("mit", ("mit license",), "released under the mit license see license file"),
    ("apache", ("apache license", "version 2 0"), "licensed under the apache license version 2 0 the license you may not use "
     "this file except in compliance with the license"),
    ("gpl", ("general public license",), "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ("general public license",), "licensed under the gnu general public license version 3"),
    ("lgpl", ("lesser general public license",), "under the terms of the gnu lesser general public license as published by"),
    ("agpl", ("affero general public license",), "under the terms of the gnu affero general public license as published by"),
    ("bsd", ("redistribution and use in source and binary forms",),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
     "was not distributed with this file"),
    ("isc", ("permission to use copy modify and or distribute this software",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("cc-by", ("creative commons attribution",), "this work is licensed under a creative commons attribution 4 0 "
     "international license"),
]
RARE = 8
LEAST = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case.

    Two letters beyond ASCII would become ASCII letters in lower case; another letter takes their place first.
    """
    kept = F.replace(F.replace(text, F.lit(chr(0x212A)), F.lit(chr(0xE9))), F.lit(chr(0x130)), F.lit(chr(0xE9)))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    """All words of phrases, key phrases and templates."""
    return sorted({w for p in [*PHRASES, *(x for _, keys, wording in TEMPLATES for x in (*keys, wording))]
                   for w in p.split()})


def anchors() -> list[str]:
    """One word of each phrase and of one key phrase of each template: a file without any of them has no label."""
    return sorted({max(p.split(), key=len) for p in [*PHRASES, *(keys[0] for _, keys, _ in TEMPLATES)]})


def licence_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, own, places``: the file's distinct words of the vocabulary, and all their places.

    Positions count all words of the text. ``places`` is null in a file without an anchor word.
    """
    known = vocabulary()
    words = docs.select(F.col(id_column).alias("doc_id"),
                        scan_words(F.coalesce(F.col(text_column), F.lit(""))).alias("_w"))
    files = words.select("doc_id", "_w", F.array_intersect("_w", F.array(*map(F.lit, known))).alias("own"))
    places = F.filter(F.transform("_w", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))),
                      lambda p: p["word"].isin(known))
    marked = F.arrays_overlap("own", F.array(*map(F.lit, anchors())))
    return files.select("doc_id", F.size("_w").cast("long").alias("n_words"), "own", F.when(marked, places).alias("places"))


def starts_of(places: Column, phrase: str) -> Column:
    """Positions at which the words of a phrase stand one after the other.

    All its words are in ``places``, so they are neighbours there as well.
    """
    words = phrase.split()
    size = len(words)
    def here(p, i):
        checks = [F.get(places, i + j)["word"].eqNullSafe(F.lit(w)) & F.get(places, i + j)["at"].eqNullSafe(p["at"] + j)
                  for j, w in enumerate(words) if j]
        found = p["word"] == words[0]
        for c in checks:
            found = found & c
        return found
    return F.transform(F.filter(places, here), lambda p: p["at"])


def has_all(keys: tuple[str, ...]) -> Column:
    """All key phrases stand in the file."""
    found = F.lit(True)
    for k in keys:
        found = found & (F.size(starts_of(F.col("places"), k)) > 0)
    return found


def aligned(wording: str, rare: int = RARE) -> Column:
    """Largest share of the looked-up words of a template that lie on one line of position differences.

    These are the ``rare`` rarest of the template's own words that the file has (``_ranked``: its words, rarest first).
    The template's postings are written out as literals: for each looked-up place of the file all
    differences to the template's places of that word.
    """
    postings: dict[str, list[int]] = {}
    for i, w in enumerate(wording.split()):
        postings.setdefault(w, []).append(i)
    index = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    looked = F.slice(F.filter("_ranked", lambda w: F.map_contains_key(index, w)), 1, rare)
    line = F.flatten(F.transform(F.filter("places", lambda p: F.array_contains(looked, p["word"])), lambda p: F.transform(
        F.coalesce(F.element_at(index, p["word"]), F.array().cast("array<int>")), lambda i: p["at"] - i)))
    wanted = F.size(looked)
    # Sorted differences: the longest run of equal ones, in one pass.
    start = F.struct(F.lit(None).cast("long").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("top"))
    def step(s, d):
        n = F.when(s["v"].eqNullSafe(d), s["n"] + 1).otherwise(F.lit(1))
        return F.struct(d.alias("v"), n.alias("n"), F.greatest(s["top"], n).alias("top"))
    top = F.aggregate(F.array_sort(line), start, step, lambda s: s["top"])
    return F.when(wanted > 0, F.least(F.lit(1.0), top / wanted)).otherwise(F.lit(0.0))


def scan(docs: DataFrame, rare: int = RARE, least: float = LEAST, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every whole text.

    Base labels are those of ``PHRASES``, at every place where the phrase's words stand one after the other.
    For each template whose key phrases all stand in the file, the scan looks up those ``rare`` words of the
    template that the file has and that have the highest inverse document frequency, lines them up by position (file
    minus template), and takes the template if its best line holds at least ``least`` of them. ``score`` is the best such share, 0 without any template.

    Texts are cut into words once; the positions of licence words are kept in the shared folder, and both
    the frequencies over all documents and the lookup read them. Frequencies are summed before the exchange and
    broadcast, at most one per word of the templates; the lookup needs no exchange.
    Null and empty texts have no words and score 0; repeated rows are scanned each; an empty table gives no
    rows; other columns are ignored.
    """
    files = stored(licence_words(docs, id_column, text_column))
    # One row, one entry per word of the vocabulary at most.
    frequency = (files.select(F.explode("own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
                 .agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("_df")))
    looked = files.filter("places is not null").join(F.broadcast(frequency)).withColumn("_ranked", F.transform(
        F.array_sort(F.transform("own", lambda w: F.struct(F.element_at("_df", w).alias("df"), w.alias("word")))),
        lambda r: r["word"]))
    found = looked
    for n, (label, keys, wording) in enumerate(TEMPLATES):
        found = found.withColumn(f"_t{n}", F.when(has_all(keys), aligned(wording, rare)).otherwise(F.lit(0.0)))
    best = [F.when(F.col(f"_t{n}") >= least, F.col(f"_t{n}")).otherwise(F.lit(0.0)) for n in range(len(TEMPLATES))]
    method = F.array(*[F.when(b > 0, F.lit(t[0])) for b, t in zip(best, TEMPLATES)])
    found = found.withColumns({f"_b{i}": starts_of(F.col("places"), p) for i, p in enumerate(PHRASES)})
    base = F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())])
    starts = F.flatten(F.array(*[F.col(f"_b{i}") for i in range(len(PHRASES))]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")
    labelled = found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, method)).alias("labels"), F.greatest(*best).alias("score"))
    none = F.lit(None).cast("long")
    return labelled.unionByName(files.filter("places is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")))
