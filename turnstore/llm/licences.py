"""Licence scan by sentence rules, in DataFrame functions only.

Text is cut into sentences, each is normalised, and sentences known from licences are
mapped to identifiers. Rules are sequences of identifiers; a document carries every
licence whose sequence occurs in its own, in that order and without another known
sentence between. The first rule of the list that fits names the licence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Sentences as they are normalised below.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-no-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-notice": "licensed under cc by-nc 4.0",
    "cc-by-notice": "licensed under cc by 4.0",
    "cc-by-sa-notice": "licensed under cc by-sa 4.0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-see": "see the gnu general public license for more details",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "proprietary": "all rights reserved",
}


@dataclass(frozen=True)
class LicenceRule:
    licence: str
    sequence: tuple[str, ...]


# Fixed values, most specific first.
RULES = (
    LicenceRule("MIT", ("mit-grant", "mit-condition")),
    LicenceRule("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy")),
    LicenceRule("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement")),
    LicenceRule("GPL-3.0-or-later", ("gpl-redistribute", "gpl-see")),
    LicenceRule("GPL-3.0-or-later", ("gpl-redistribute",)),
    LicenceRule("GPL-3.0-only", ("gpl-notice",)),
    LicenceRule("Apache-2.0", ("apache-notice",)),
    LicenceRule("BSD-2-Clause", ("bsd-redistribution",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("MIT", ("mit-notice",)),
    LicenceRule("MPL-2.0", ("mpl-notice",)),
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    LicenceRule("CC-BY-4.0", ("cc-by-notice",)),
    LicenceRule("CC0-1.0", ("cc0-notice",)),
    LicenceRule("LicenseRef-proprietary", ("proprietary",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Sentences end at line ends, and at marks that white space follows.
BOUNDARY = "[.!?;:][ \t\r\f]+|[\n]+"
NOISE = "[^a-z0-9.-]+"
EDGES = "^[ .-]+|[ .-]+$"


def sentences(text: Column) -> Column:
    """Normalised sentences: lower case, words and numbers parted by single spaces."""
    lowered = F.translate(text, UPPER, LOWER)
    cut = F.split(F.regexp_replace(lowered, BOUNDARY, "\n"), "\n")
    return F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(s, NOISE, " "), EDGES, ""))


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences, in order; an array."""
    table = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (sentence, name)])
    return F.array_compact(F.transform(sentences(text), lambda s: F.element_at(table, s)))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: tuple[LicenceRule, ...] = RULES) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, sentence_ids, licences (by rule), licence (the first; null without).

    Null and empty texts, and texts without a known sentence, have empty arrays and no
    licence. Sentences that merely contain a known one are not it. Rows are independent.
    """
    ids = sentence_ids(F.coalesce(F.col("text").cast("string"), F.lit("")), known or SENTENCES)
    # Between separators, so that a sequence is a plain piece of the joined identifiers.
    joined = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    found = docs.select("doc_id", ids.alias("sentence_ids"), joined.alias("_joined"))
    fits = [F.when(F.col("_joined").contains(f" {' '.join(r.sequence)} "), F.lit(r.licence)) for r in rules]
    licences = F.array_distinct(F.array_compact(F.array(*fits)))
    return found.select("doc_id", "sentence_ids", licences.alias("licences")).withColumn(
        "licence", F.when(F.size("licences") > 0, F.col("licences")[0]))
