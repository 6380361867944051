"""License scans by a positional rare-token index (operator 3).

Each licence template is posted in a small index: word -> (template, position). A corpus pass counts in how many documents
each posted word occurs, which gives its IDF. A file is looked up by the RARE words of highest IDF, among those that it has,
of each template whose key phrase it may hold. A place of such a word and its posting give an alignment (place in the
file less place in the template); alignments that two postings agree on are kept. Should those words stand elsewhere in the
file, the places of the key phrase's own rarest word give all alignments that are left. At each the template's mandatory key
phrase is verified word for word, and the share of the template's words that agree is its score: so no alignment that holds
the key phrase is missed. The base phrases are found by their word of highest IDF and verified in full. Column expressions
over one row, and one small count by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, packed, settled, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Templates: label, opening text of the licence or its usual notice, mandatory key phrase. The licences' own words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution", "eclipse public license"),
    ("eupl", "licensed under the european union public licence you may not use this work except in compliance with the licence", "european union public licence"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "semblance of artistic control"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "as long as the name is changed"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below", "open font license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means", "all rights reserved"),
)
LEAST_SCORE = 0.6
RARE = 3  # words by which a template is looked up first
PHRASE_SCORE = 0.5  # a base phrase names a licence; it is not its text


def vocabulary() -> list[str]:
    """The posted words; their number is fixed by the templates."""
    return sorted({w for text in [p for p, _ in PHRASES] + [t for _, t, _ in TEMPLATES] for w in text.split()})


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS, -1), lambda w: w != "")


def document_frequencies(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many documents each posted word occurs, over all of them; one row a posted word comes to the driver."""
    posted = literal(vocabulary())
    each = df.select(F.explode(F.array_intersect(words_of(text_of(text_col)), posted)).alias("word"))
    return {w: 0 for w in vocabulary()} | {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def stands(phrase: Column, n: Column, at: Column) -> Column:
    """True where the n words of the phrase stand in words from the place at on."""
    return F.when(at >= 0, F.slice("words", at + 1, n) == phrase).otherwise(False)


def phrase_places(hits: Column, phrase: list[str], anchor: str) -> Column:
    """Starts of the phrase: from the anchor's places, less its place in the phrase, each verified in full."""
    starts = F.transform(F.filter(hits, lambda h: h["word"] == anchor), lambda h: h["at"] - phrase.index(anchor))
    return F.filter(starts, lambda s: stands(literal(phrase), F.lit(len(phrase)), s))


def template_index(rank: dict[str, int]) -> Column:
    """Array of the templates: label, words, rare (the distinct words, highest IDF first), key phrase and its place, its word of highest IDF and that one's place."""
    rows = []
    for label, text, phrase in TEMPLATES:
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rare = sorted(set(words), key=rank.__getitem__)
        anchor = min(key, key=rank.__getitem__)
        rows.append(F.struct(F.lit(label).alias("label"), literal(words).alias("words"), literal(rare).alias("rare"), literal(key).alias("key"), F.lit(at).alias("key_at"), F.lit(anchor).alias("anchor"), F.lit(at + key.index(anchor)).alias("anchor_at")))
    return F.array(*rows)


def looked_up(t: Column) -> Column:
    """The template's words that the file is looked up by; none if the file lacks a word of the key phrase."""
    whole = F.size(F.array_intersect(t["key"], F.col("present"))) == F.size(F.array_distinct(t["key"]))
    return F.when(whole, F.slice(F.array_intersect(t["rare"], F.col("present")), 1, RARE)).otherwise(F.array().cast("array<string>"))


def template_score(t: Column, rare: Column, hits: Column) -> Column:
    """The best share of the template's words that agree with the file at one alignment that holds the key phrase, else 0."""
    posted = lambda word: F.filter(F.transform(t["words"], lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
    mine = F.filter(hits, lambda h: F.array_contains(rare, h["word"]))
    aligned = F.sort_array(F.flatten(F.transform(mine, lambda h: F.transform(posted(h["word"]), lambda p: h["at"] - p))))
    met = let(aligned, lambda a: F.array_distinct(F.filter(a, lambda d, i: F.when(i > 0, d == F.get(a, i - 1)).otherwise(False))))
    keyed = F.transform(F.filter(hits, lambda h: h["word"] == t["anchor"]), lambda h: h["at"] - t["anchor_at"])
    held = F.filter(F.array_union(met, keyed), lambda d: stands(t["key"], F.size(t["key"]), d + t["key_at"]))
    agree = lambda d: F.size(F.filter(t["words"], lambda w, i: F.when(d + i >= 0, F.get(F.col("words"), d + i) == w).otherwise(False)))
    return F.coalesce(F.array_max(F.transform(held, lambda d: agree(d) / F.size(t["words"]))), F.lit(0.0))


def scan_licenses(df: DataFrame, text_col: str = "text", frequencies: dict[str, int] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """df with n_words, places (array of (start, label) of the base phrases, in order), template_labels and score.

    frequencies: document_frequencies of the corpus, counted here if not given. score is the best template's, or PHRASE_SCORE if a base phrase stands and
    no template scores more. Null texts count as empty: no words, no places, score 0. Columns of those names are replaced, all others kept.
    """
    made = ("n_words", "places", "template_labels", "score")
    df_of = document_frequencies(df, text_col) if frequencies is None else frequencies
    order = sorted(vocabulary(), key=lambda w: (df_of[w], w))  # highest IDF first
    rank = {w: i for i, w in enumerate(order)}
    anchor = {text: min(text.split(), key=rank.__getitem__) for text, _ in PHRASES}
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    out = packed(rest, words_of(text_of(text_col)).alias("words"))
    out = out.withColumn("present", F.array_intersect("words", literal(order)))
    chosen = F.filter(F.transform(template_index(rank), lambda t: F.struct(t.alias("t"), looked_up(t).alias("rare"))), lambda c: F.size(c["rare"]) > 1)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    keyed = sorted({min(phrase.split(), key=rank.__getitem__) for _, _, phrase in TEMPLATES})  # without one of these no key phrase stands
    out = out.withColumn("chosen", F.when(F.arrays_overlap("present", literal(keyed)), chosen))
    anchors = F.array_intersect("present", literal(sorted(set(anchor.values()))))
    out = out.withColumn("sought", F.array_union(anchors, F.coalesce(F.flatten(F.transform("chosen", lambda c: F.array_append(c["rare"], c["t"]["anchor"]))), none("string"))))
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("sought", w), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    out = out.withColumn("hits", F.when(F.size("sought") > 0, hits).otherwise(none("struct<at:int,word:string>")))
    found = []
    for text, label in PHRASES:
        starts = phrase_places(F.col("hits"), text.split(), anchor[text])
        found.append(F.arrays_zip(starts.cast("array<bigint>").alias("start"), F.array_repeat(F.lit(label), F.size(starts)).alias("label")))
    scores = F.transform("chosen", lambda c: F.struct(template_score(c["t"], c["rare"], F.col("hits")).alias("score"), c["t"]["label"].alias("label")))
    out = out.withColumns({"places": F.sort_array(F.concat(*found)), "scores": F.coalesce(scores, none("struct<score:double,label:string>"))})
    best = F.coalesce(F.array_max(F.transform("scores", lambda x: x["score"])), F.lit(0.0))
    labels = F.transform(F.filter("scores", lambda x: x["score"] >= least_score), lambda x: x["label"])
    values = (F.size("words").cast("long"), F.col("places"), F.sort_array(F.array_distinct(labels)), F.greatest(best, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)))
    fenced = settled(out.select("_row", *[v.alias(k) for k, v in zip(made, values, strict=True)]), {k: F.col(k) for k in made}, [])
    return fenced.select("_row.*", *made)


def license_digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts, first and last place and labels of the base phrases, labels with the templates', and the score. A null text counts as empty."""
    found = scan_licenses(docs.select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, "template_labels")).alias("labels"), "score",
    )
