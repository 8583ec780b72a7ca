"""License scan by exact set-similarity join, in DataFrame operations only.

A template and every text block are sets of words. As notices wrap, and as lines have any
length, the blocks of a text are all stretches of as many words as the template has, wherever
lines end: words scattered over a longer stretch are no notice. A block matches where it holds
at least a given share of the template's words. Words are ordered by their frequency in the
corpus, rarest first. A block that holds ``need`` of a template's n words holds one of the
template's n - need + 1 rarest (prefix filter); it has at least ``need`` words (length
filter); and if the rarest template word it holds stands at position i of the ordered
template, at most n - i words can still be shared (positional filter). Only blocks that pass
all three are compared word by word, so the outcome is exact.

Frequencies are counted over all documents, for the words of the templates only: their
number is fixed by the templates, so the ordered templates travel inside the query.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.llm.common import cut, text_hash, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a run of characters that are not word characters once A-Z are lower-cased
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
CONTAINMENT = 0.8
#: words of a text that are looked at in one row
PART = 1024

# notices as their licenses word them: fixed values
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text in order."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _follows(w: Column, k: int, part: str):
    return lambda i: F.coalesce(F.get(w, i + k) == part, F.lit(False))


def places(w: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand one after another."""
    parts = phrase.split()
    first = F.filter(F.transform(w, lambda x, i: F.when(x == parts[0], i)), lambda i: i.isNotNull())
    for k, p in enumerate(parts[1:], 1):
        first = F.filter(first, _follows(w, k, p))
    return first


def template_words(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Distinct words of each template, by the same rule as the texts'."""
    out = []
    for label, text in templates:
        low = "".join(c.lower() if c in UPPER else c for c in text)
        spaced = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low)
        out.append((label, sorted(set(spaced.split()))))
    return out


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many times each word of ``vocabulary`` stands in all texts; one number per word reaches the driver."""
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    w = docs.select(F.explode(F.split(lowered(text_of()), APART)).alias("word"))
    got = w.join(F.broadcast(known), "word").groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in got}


def ordered_templates(templates: Sequence[tuple[str, str]], counts: Mapping[str, int], containment: float) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words by frequency, words needed, length in words) of each template with words."""
    out = []
    for (label, ws), (_, text) in zip(template_words(templates), templates):
        low = "".join(c.lower() if c in UPPER else c for c in text)
        if ws:
            out.append((label, sorted(ws, key=lambda w: (counts.get(w, 0), w)), ceil(containment * len(ws) - 1e-9), len(re.findall(WORD, low))))
    return out


def _prefix(ordered: Sequence[tuple[str, list[str], int, int]]) -> list[str]:
    """Words of which a matching block holds at least one."""
    return sorted({w for _, ws, need, _ in ordered for w in ws[: len(ws) - need + 1]})


def _probe(ordered: Sequence[tuple[str, list[str], int, int]]) -> str:
    """The prefix index as one scan: a prefix word at a word's place of a lower-cased text."""
    edge = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return f"(?:^|{edge})(?:{'|'.join(_prefix(ordered))})(?:{edge}|$)"


def match_windows(texts: DataFrame, templates: Sequence[tuple[str, str]], counts: Mapping[str, int], containment: float = CONTAINMENT) -> DataFrame:
    """``texts`` (any columns, and ``text``) with a stretch of words that holds a template: adds ``label`` and ``held``.

    A stretch has as many words as the template, wherever lines end; every such stretch of a
    text counts. Only places of prefix words are looked at, as every match holds one. Texts
    are cut into overlapping parts of PART words, so a row is bounded whatever a text's length.
    One row per part and label.
    """
    ordered, keys = ordered_templates(templates, counts, containment), [c for c in texts.columns if c != "text"]
    if not ordered:
        return texts.select(*keys, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("held")).where("false")
    reach = max(length for *_, length in ordered) - 1
    t = texts.select(*keys, lowered("text").alias("__ll_low")).where(F.col("__ll_low").rlike(_probe(ordered)))
    t = t.select(*keys, F.array_remove(F.split("__ll_low", APART), "").alias("__ll_w"))
    w = F.col("__ll_w")
    # a part's own words, and the words within reach on either side
    begins = F.sequence(F.lit(0), F.size(w), F.lit(PART))
    parts = F.transform(begins, lambda s: F.slice(w, F.greatest(s - reach, F.lit(0)) + 1, F.least(s, F.lit(reach)) + PART + reach))
    t = t.select(*keys, F.explode(parts).alias("__ll_w"))
    near = F.transform(w, lambda x, i: F.when(x.isin(*_prefix(ordered)), F.struct(x.alias("word"), i.alias("at"))))
    near = F.transform(F.filter(near, lambda h: h.isNotNull()), lambda h: F.struct(h["word"].alias("word"), *[
        F.slice(w, F.greatest(h["at"] - k, F.lit(0)) + 1, F.least(h["at"], F.lit(k)) + 1 + k).alias(f"s{k + 1}") for k in sorted({length - 1 for *_, length in ordered})
    ]))
    t = t.select(*keys, F.explode(near).alias("__ll_h")).select(*keys, "__ll_h.*")
    tests = []
    for label, ws, need, length in ordered:
        n, mine, around = len(ws), F.array(*map(F.lit, ws)), F.col(f"s{length}")
        may = F.col("word").isin(*ws[: n - need + 1]) & (F.size(F.array_intersect(mine, around)) >= need)
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(length)), _held(mine, around, length)))
        tests.append(F.when(may, F.struct(F.lit(label).alias("label"), best.alias("n"), F.lit(need).alias("need"), F.lit(n).alias("of"))))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    t = t.select(*keys, F.explode(found).alias("__ll_t")).where("__ll_t.n >= __ll_t.need")
    return t.select(*keys, "__ll_t.label", (F.col("__ll_t.n") / F.col("__ll_t.of").cast("double")).alias("held"))


def _held(mine: Column, around: Column, length: int):
    """Template words in the ``length`` words from a place on."""
    return lambda j: F.size(F.array_intersect(mine, F.slice(around, j, length)))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """License findings of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base findings are phrases; template matches add labels, and ``score`` is the best share
    of a template held by a block of the text, 1 where a phrase stands, 0 without a finding.
    Null and empty texts have no words and no finding; repeated rows and null doc_ids are
    kept; other columns are not read.
    """
    counts = frequencies(docs, sorted({w for _, ws in template_words(templates) for w in ws}))
    t = docs.select("doc_id", text_hash().alias("text_hash"), text_of().alias("t"))
    text = F.col("t")
    last = "|".join(sorted({p.split()[-1] for p, _ in phrases}))
    w = F.when(text.rlike(f"(?i)(?:{last})"), words(text)).otherwise(F.array().cast("array<string>"))
    hits = match_windows(t.select("doc_id", "text_hash", text.alias("text")), templates, counts, containment)
    best = hits.groupBy(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3")).agg(
        F.collect_set("label").alias("more"), F.max("held").alias("held")
    )
    rows = t.select("doc_id", "text_hash", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), w.alias("w"))
    found = F.array(*[places(F.col("w"), p) for p, _ in phrases])
    rows = rows.select("doc_id", "text_hash", "n_words", found.alias("found"))
    flat = F.flatten("found")
    own = F.filter(F.array(*[F.when(F.size(F.col("found")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    rows = rows.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3"), "n_words",
        F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(own)).alias("own"),
    )
    rows = rows.join(best, ["k1", "k2", "k3"], "left")
    both = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), score.alias("score"),
    )
