"""License scans by a positional rare-token index, with DataFrame functions only.

Templates are word sequences with mandatory key phrases.  Their vocabulary is looked up
in every document; document frequencies over the whole corpus give each word's IDF.
A file can hold the templates all of whose mandatory words it holds.  Of each of those, the ``LOOKED_UP``
mandatory words of highest IDF are looked up at all their places in the file, and each place votes for a start (place in
the file less place in the template).  The votes are intersected: a start is kept if all words of its template agree on
it.  That loses none, as wherever the mandatory phrases stand their words do.  Each mandatory phrase is then verified at
its place.  Short phrases with no other words are looked up by their own rarest word likewise.

Defined cases: a null or empty text has no words, no labels and a score of 0; rows are scored one by one,
whatever their id; equal IDFs are ordered by word.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .line_dedup import ascii_lower, bound

#: Words of a template that are looked up in a file.
LOOKED_UP = 3
#: What stands between words; splitting there costs a sixth of the search for the words themselves.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (template, mandatory phrases as they stand in it); wording of the public licences' own notices.
TEMPLATES: dict[str, list[tuple[str, list[str]]]] = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
        ("under the apache license 2 0", ["apache license 2 0"]),
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
         " without warranties or conditions of any kind either express or implied",
         ["unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software",
         ["permission is hereby granted", "free of charge"]),
        ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
         " merchantability fitness for a particular purpose and noninfringement",
         ["the software is provided as is", "fitness for a particular purpose and noninfringement"]),
    ],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted",
         ["redistribution and use", "source and binary forms"]),
        ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not"
         " limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
         ["provided by the copyright holders and contributors as is", "are disclaimed"]),
        ("licensed under the bsd license", ["bsd license"]),
    ],
    "gpl-notice": [
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
         ["free software", "gnu general public license"]),
        ("this work is licensed under the gnu general public license", ["gnu general public license"]),
        ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
         " merchantability or fitness for a particular purpose", ["distributed in the hope that it will be useful", "without any warranty"]),
    ],
    "lgpl": [("gnu lesser general public license", ["lesser general public license"])],
    "agpl": [("gnu affero general public license", ["affero general public license"])],
    "mpl-2.0": [("subject to the terms of the mozilla public license", ["mozilla public license"])],
    "cc-by-notice": [
        ("this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
        ("licensed under cc by 4 0", ["cc by 4 0"]),
    ],
    "cc0": [("dedicated to the public domain under cc0", ["public domain"])],
    "copyright-notice": [("copyright c all rights reserved", ["all rights reserved"])],
    "unlicense": [("this is free and unencumbered software released into the public domain",
                   ["free and unencumbered software", "public domain"])],
}


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Document frequency of each word over all rows; at most one row per vocabulary word reaches the driver."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), _literal(vocabulary))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _places(words: Column, word: str) -> Column:
    """All places of a word."""
    return F.filter(F.transform(words, lambda w, k: F.when(w == word, k)), lambda k: k.isNotNull())


def _stands(words: Column, phrase: Column, at: Column) -> Column:
    """Whether the phrase stands from place ``at`` (0-based) on."""
    return F.when(at >= 0, F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase).otherwise(False)


def _postings(bodies, df: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """``(w, t, k)``: word, template and place, of each template's rarest words; mandatory ones, if it has any."""
    found = []
    for t, (_, template, keys) in enumerate(bodies):
        places = sorted({_place(template, key) + k for key in keys for k in range(len(key))}) or range(len(template))
        rarest = sorted(places, key=lambda k: (df[template[k]], template[k], k))
        found += [(template[k], t, k) for k in rarest[:LOOKED_UP if keys else 1]]
    return found


def _place(template: list[str], key: list[str]) -> int:
    return next(i for i in range(len(template)) if template[i:i + len(key)] == key)


def _templates(bodies) -> Column:
    """``(label, words, keys)`` of every template, ``keys`` with the place of each mandatory phrase."""
    return F.array(*[
        F.struct(F.lit(label).alias("label"), _literal(template).alias("words"), F.array(*[
            F.struct(F.lit(_place(template, key)).alias("at"), _literal(key).alias("words")) for key in keys]).cast("array<struct<at:int,words:array<string>>>").alias("keys"))
        for label, template, keys in bodies])


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, list[tuple[str, list[str]]]] = TEMPLATES,
) -> DataFrame:
    """``(id, n_words, places, phrase_labels, labels, score)``; ``places``: for each phrase its starts, in order.

    A start counts if the mandatory phrases stand at their places, or all words of a template that has none.  The
    score is the largest share of a labelled template's words that stand at their places, 1 for a phrase.
    """
    bodies = [(label, t.split(), [p.split() for p in keys]) for label, ts in templates.items() for t, keys in ts]
    spoken = [(p.split(), label) for p, label in phrases.items()]
    vocabulary = sorted({w for _, t, _ in bodies for w in t} | {w for p, _ in spoken for w in p})
    df = document_frequencies(docs, vocabulary, text)
    words, found = F.col("_words"), F.col("_found")

    source = docs.select(F.col(id).alias(id), words_of(F.col(text)).alias("_words"))
    source = source.withColumn("_found", F.array_intersect(words, _literal(vocabulary)))

    def spoken_places(phrase: list[str]) -> Column:
        k, anchor = min(enumerate(phrase), key=lambda x: (df[x[1]], x[0]))
        starts = F.filter(_places(words, anchor), lambda at: _stands(words, _literal(phrase), at - k))
        return F.when(
            F.size(F.array_except(_literal(phrase), found)) == 0, F.transform(starts, lambda at: at - k),
        ).otherwise(F.array().cast("array<int>"))

    anchors = _postings(bodies, df)
    agreeing = F.array(*[F.lit(sum(a == t for _, a, _ in anchors)) for t in range(len(bodies))])
    postings, table = F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(k).alias("k")) for w, t, k in anchors]), _templates(bodies)
    needed = F.array(*[_literal(sorted({w for key in keys or [template] for w in key})) for _, template, keys in bodies])
    # what the file can hold, and the words to look up for it
    usable = F.filter(postings, lambda p: F.get(F.col("_possible"), p["t"]))

    def votes(chosen: Column) -> Column:
        sought = F.array_distinct(F.transform(chosen, lambda p: p["w"]))
        hits = bound(sought, lambda s: F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(s, h["w"])))
        return F.sort_array(F.flatten(F.transform(hits, lambda h: F.transform(
            F.filter(chosen, lambda p: p["w"] == h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("at"))))))

    def agreed(sorted_: Column) -> Column:
        """Starts on which all words looked up for their template agree: equal votes stand side by side."""
        return F.filter(sorted_, lambda x, i: F.coalesce(
            F.get(sorted_, i + F.get(agreeing, x["t"]) - 1) == x, F.lit(False)))

    def judged(x: Column) -> Column:
        return bound(F.get(table, x["t"]), lambda t: bound(
            F.size(F.filter(F.transform(t["words"], lambda w, k: F.get(words, x["at"] + k) == w), lambda same: same)),
            lambda n: F.when(
                F.forall(t["keys"], lambda key: _stands(words, key["words"], x["at"] + key["at"]))
                & ((F.size(t["keys"]) > 0) | (n == F.size(t["words"]))),
                F.struct(t["label"].alias("label"), (n / F.size(t["words"])).alias("share")))))

    source = source.withColumn("_possible", F.transform(needed, lambda m: F.size(F.array_except(m, found)) == 0))
    none = F.array().cast("array<struct<label:string,share:double>>")
    matches = F.when(F.exists("_possible", lambda p: p), F.array_compact(F.transform(
        bound(bound(usable, votes), agreed), judged))).otherwise(none)

    result = source.select(
        id, F.size(words).cast("long").alias("n_words"), F.array(*[spoken_places(p) for p, _ in spoken]).alias("places"),
        matches.alias("_matches"))
    phrase_labels = F.array(*[F.when(F.size(F.col("places")[k]) > 0, label) for k, (_, label) in enumerate(spoken)])
    tidy = lambda a: F.array_join(F.sort_array(F.array_distinct(F.array_compact(a))), ",")
    return result.select(
        id, "n_words", "places", tidy(phrase_labels).alias("phrase_labels"),
        tidy(F.concat(phrase_labels, F.transform("_matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.exists("places", lambda p: F.size(p) > 0), 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("_matches", lambda m: m["share"])), F.lit(0.0))).alias("score"))
