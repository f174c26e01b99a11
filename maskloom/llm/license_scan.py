"""License scans by an exact set-similarity join of text blocks with licence templates. DataFrame functions only.

Templates are few and fixed, blocks are many. All templates' words are ordered by their frequency in the corpus, rarest
first. A block can reach `threshold` of a template's words only if the prefixes of both, in that order, share a word
(prefix filter), if the block has enough template words at all (length filter), and if enough words are left on both
sides from the shared one on (positional filter). What passes is verified by the sets themselves, so the filters cost
no pair. A match has to stand together: a run of words no longer than the template by the same threshold holds all that
is matched, among it the words that tell the template from others. Texts are read once: what the phrases need, which template words there are, and the texts that hold enough words
of some template are written; the word order comes from the first, and only those texts are cut into blocks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_of

# Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Templates by label, as words, and those of their words that no match may lack, since they tell the licence from
# others and from plain text. Notices first, then characteristic sentences of the licences themselves.
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("mit", "released under mit license", "mit license"),
    ("mit", "licensed under mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted associated files"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license 2"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public 3"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", "gnu lesser 2"),
    ("lgpl", "licensed under the gnu library general public license version 2", "gnu library"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero 3"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary"),
    ("bsd", "released under the bsd 3 clause license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission or with fee"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "creative commons noncommercial sharealike"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons noncommercial noderivatives"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blocks are lines; longer ones are read through overlapping windows, so that any run of STEP words lies within one.
WINDOW, STEP = 64, 32


def spaced(text: Column) -> Column:
    """' w1 w2 ... wn ', and ' ' where there are no words."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), SEPARATORS, " "), "^ +$", " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scanned(docs: DataFrame, keep: list[str], text_col: str = "text", threshold: float = 0.8, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base (labels), held (template words), text: one pass over the texts, written.

    held: in no order, from the whole text; text: only where enough words of some template are held (length filter), with
    those it can't lack, as nothing else can match. Linear in the text.
    """
    at = r" (?=(?:" + "|".join(phrases) + ") )"
    sets = [sorted(set(t.split())) for _, t, _ in templates]
    df = docs.select(*keep, text_of(text_col).alias("_t")).withColumn("_s", spaced(F.col("_t")))
    df = df.withColumn("_n", F.greatest(_spaces(F.col("_s")) - 1, F.lit(0)))
    # Split just before each place: the words ahead of the first and from the last on give their starts.
    df = df.withColumn("_cut", F.when(F.col("_s").rlike(at), F.split("_s", at, -1)))
    df = df.withColumn("held", F.array_intersect(F.split("_s", " "), F.array(*map(F.lit, sorted({w for t in sets for w in t})))))
    n = F.coalesce(F.size("_cut"), F.lit(1)) - 1
    labels = [F.when(F.contains("_s", F.lit(f" {p} ")), F.lit(label)) for p, label in phrases.items()]
    holds = lambda words, n: F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= n
    enough = [holds(t, _need(t, threshold)) & holds(key.split(), len(key.split())) for t, (_, _, key) in zip(sets, templates, strict=True)]
    return stored(
        df.select(
            *keep,
            F.col("_n").cast("long").alias("n_words"),
            F.when(F.col("_cut").isNull(), 0).otherwise(n).cast("long").alias("n_base"),
            _spaces(F.col("_cut")[0]).cast("long").alias("first_word"),
            (F.col("_n") - _spaces(F.element_at("_cut", -1))).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
            "held",
            F.when((F.size("held") >= min(_need(t, threshold) for t in sets)) & reduce(Column.__or__, enough), F.col("_t")).alias("text"),
        ),
        "scanned",
    )


def _need(template: list[str], threshold: float) -> int:
    """How many of a template's words a block must have."""
    return math.ceil(threshold * len(template) - 1e-9)


def _span(template: str, threshold: float) -> int:
    """How many words a match may stretch over; every such run lies within one window."""
    return min(math.ceil(len(template.split()) / threshold - 1e-9), STEP + 1)


def word_order(found: DataFrame, words: list[str]) -> list[str]:
    """The words by the number of documents that have them, rarest first, from scanned(). At most len(words) rows reach the driver."""
    n = {r["w"]: r["n"] for r in found.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (n.get(w, 0), w))


def _lines(text: Column) -> Column:
    """The whole text where it has several lines, else nothing; then the lines."""
    lines = F.split(text, "\n")
    return F.concat(F.array(F.when(F.size(lines) > 1, text).otherwise("")), lines)


def blocks(found: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, block (number), words (array) of each text: lines, long ones in windows, and windows over the whole text (line -1), as
    notices are wrapped over lines."""
    lines = found.select(*keep, F.posexplode(_lines(F.col(text_col))).alias("line", "_line")).withColumn("line", F.col("line") - 1)
    words = lines.select(*keep, "line", F.array_compact(F.transform(F.split(F.trim(spaced(F.col("_line"))), " "), lambda w: F.when(w != "", w))).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1 - STEP, F.lit(0)), F.lit(STEP))
    return words.select(*keep, "line", "_w", F.explode(starts).alias("start")).select(*keep, F.struct("line", "start").alias("block"), F.slice("_w", F.col("start") + 1, WINDOW).alias("words"))


def template_join(found: DataFrame, keep: list[str], threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """keep, block, template, label, containment, matched, held, exact: every pair of a block of scanned() and a template that reaches
    the threshold in some run of words. held: the words matched in the best run; exact: whether the block has the template word for word."""
    sets = [(i, label, sorted(set(t.split()))) for i, (label, t, _) in enumerate(templates)]
    order = word_order(found, sorted({w for _, _, t in sets for w in t}))
    rank = {w: i for i, w in enumerate(order)}
    need = {i: _need(t, threshold) for i, _, t in sets}
    ordered = {i: sorted(t, key=rank.__getitem__) for i, _, t in sets}
    prefix = [(w, p, i) for i, t in ordered.items() for p, w in enumerate(t[: len(t) - need[i] + 1])]
    spark = found.sparkSession
    probe = spark.createDataFrame(prefix, "word string, t_pos int, template int")
    whole = spark.createDataFrame(
        [(i, label, ordered[i], len(t), need[i], f" {templates[i][1]} ", sorted(templates[i][2].split()), _span(templates[i][1], threshold)) for i, label, t in sets],
        "template int, label string, t_words array<string>, t_n int, need int, t_text string, t_keys array<string>, t_span int",
    )
    # array_intersect keeps the order of its first argument: the block's template words, rarest first.
    cut = blocks(found.filter("text is not null"), keep)
    held = cut.select(*keep, "block", "words", F.array_intersect(F.array(*map(F.lit, order)), "words").alias("_b"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("_text"))
    least = min(need.values())
    first = F.slice("_b", 1, F.greatest(F.size("_b") - least + 1, F.lit(0)))
    met = held.filter(F.size("_b") >= least).select(*keep, "block", "words", "_b", "_text", F.posexplode(first).alias("b_pos", "word"))
    # Both sides are fixed by TEMPLATES, not by the data: some hundred rows.
    met = met.join(F.broadcast(probe), "word").join(F.broadcast(whole), "template")
    met = met.filter((F.size("_b") >= F.col("need")) & (F.least(F.col("t_n") - F.col("t_pos"), F.size("_b") - F.col("b_pos")) >= F.col("need")))
    met = met.filter(F.size(F.array_intersect("_b", "t_words")) >= F.col("need")).dropDuplicates([*keep, "block", "template"])
    runs = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_sort(F.array_intersect(F.slice("words", i, F.col("t_span")), "t_words")))
    whole_runs = F.filter(runs, lambda x: (F.size(x) >= F.col("need")) & (F.size(F.array_intersect("t_keys", x)) == F.size("t_keys")))
    met = met.withColumn("_run", F.array_max(F.transform(whole_runs, lambda x: F.struct(F.size(x).alias("matched"), x.alias("held"))))).filter("_run is not null").select("*", "_run.*")
    return met.groupBy(*keep, "block", "template", "label").agg(F.max(F.col("matched") / F.col("t_n")).alias("containment"), F.max("matched").alias("matched"), F.first("held").alias("held"), F.max(F.contains("_text", "t_text")).alias("exact"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    A block gets the label of each template that reaches the threshold, but for those whose matched words another one's
    contain, unless they stand there word for word. n_blocks: blocks with a label, those over several lines only for labels
    that no line has. score: the largest share any template reached; 1 where a phrase stands; else 0. Null and empty texts have no
    words, no labels and score 0. A null id is kept; rows that repeat both id and text get equal rows. Columns other than
    the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    found = scanned(rows, ["_id", "_h"], "_t", threshold)
    pairs = template_join(found, ["_id", "_h"], threshold)
    of = F.struct("containment", "matched", "label", "template", "held", "exact")
    best = pairs.groupBy("_id", "_h", "block").agg(F.collect_list(of).alias("all"), F.max("containment").alias("containment"))
    rank = lambda x: F.struct(x["matched"], x["containment"], x["label"], x["template"])
    within = lambda x, y: (F.size(F.array_except(x["held"], y["held"])) == 0) & (rank(y) > rank(x))
    kept = F.filter("all", lambda x: x["exact"] | ~F.exists("all", lambda y: within(x, y)))
    best = best.select("_id", "_h", "block", "containment", (F.col("block.line") < 0).alias("_over"), F.transform(kept, lambda x: x["label"]).alias("labels"))
    by_doc = best.groupBy("_id", "_h").agg(
        F.array_distinct(F.flatten(F.collect_set("labels"))).alias("more"), F.max("containment").alias("best"), F.count_if(~F.col("_over")).alias("n_lines"),
        F.flatten(F.collect_set(F.when(~F.col("_over"), F.col("labels")))).alias("by_line"), F.collect_list(F.when(F.col("_over"), F.col("labels"))).alias("over"),
    )
    more_blocks = F.size(F.filter("over", lambda x: F.size(F.array_except(x, "by_line")) > 0))
    by_doc = by_doc.select("_id", "_h", "more", "best", (F.col("n_lines") + more_blocks).alias("n_blocks"))
    base = found.drop("held", "text")
    by_doc = by_doc.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    out = base.join(by_doc, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
