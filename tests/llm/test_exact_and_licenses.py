import hashlib
import math
import random
import re
from collections import defaultdict

from maskloom.llm import exact_dedup as E
from maskloom.llm import license_scan as L
from maskloom.llm.exact_dedup import build_index, exact_dedup, one_of_each
from maskloom.llm.queries import oracle_sql, queries
from pyspark.sql import functions as F

from ..compare import assert_same

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def test_exact_dedup_equals_sql(spark):
    assert_same(queries()["op9_exact_dedup"](spark, SF), SF, oracle_sql()["op9_exact_dedup"])


def test_exact_dedup_odd_rows(odd, nothing):
    rows = exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[(r.text or "").translate(LOW)].append(r.doc_id)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(nothing).count() == 0 and one_of_each(nothing).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_directory_doubles_until_buckets_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    index, slots, deep, _ = build_index(docs, E._probes(docs, "doc_id", "text"), bucket_rows=100)
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("local_depth").alias("d")).collect()
    assert max(s.n for s in sizes) <= 100 and all(s.d == 1 for s in sizes) and len(sizes) > 30
    depth = {r.slot: (r.bucket, r.local_depth) for r in slots.collect()}
    assert len(depth) <= 2**deep and max(d for _, d in depth.values()) == deep
    for slot, (bucket, d) in depth.items():
        assert slot >> (deep - d) == bucket >> (deep - d)


def test_buckets_split_on_the_given_tables(spark):
    rows = exact_dedup(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")).select("bucket").distinct().count()
    assert rows > 16 and E.bucket_size(5 * 10**10) == 1 << 18


def test_rows_are_looked_up_by_the_directory(spark, monkeypatch):
    """Copies in different letter case are found by way of their bucket alone: a directory that sends one astray loses it."""
    docs = spark.createDataFrame([(i, f"text {i % 700}" if i < 700 else f"TEXT {i % 700}") for i in range(1400)], "doc_id long, text string")
    right = exact_dedup(docs, bucket_rows=50)
    assert right.filter("group_size = 2").count() == 1400
    true = E.directory

    def wrong(keys, n, bucket_rows):
        slots, deep = true(keys, n, bucket_rows)
        return slots.filter("slot % 2 = 0"), deep

    monkeypatch.setattr(E, "directory", wrong)
    assert 0 < exact_dedup(docs, bucket_rows=50).count() < 1400


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in E.exact_dedup(docs).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text, threshold=0.8):
    """Every line and, in texts of several, the whole text, in windows: all templates against each, by the sets themselves."""
    text = text or ""
    words = WORD.findall(text.translate(LOW))
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = set(), [1.0 if places else 0.0]
    for line in text.split("\n") + [text] * ("\n" in text):
        own = WORD.findall(line.translate(LOW))
        for start in range(0, max(len(own) - 1 - L.STEP, 0) + 1, L.STEP):
            block = own[start : start + L.WINDOW]
            hits = []
            for k, (label, t, key) in enumerate(L.TEMPLATES):
                t = t.split()
                span = min(math.ceil(len(t) / threshold - 1e-9), L.STEP + 1)
                runs = [set(block[i : i + span]) & set(t) for i in range(len(block))]
                runs = [x for x in runs if len(x) / len(set(t)) >= threshold - 1e-9 and set(key.split()) <= x]
                if runs:
                    both = set(max((len(x), sorted(x)) for x in runs)[1])
                    exact = any(block[i : i + len(t)] == t for i in range(len(block)))
                    hits.append(((len(both), len(both) / len(set(t)), label, k), both, exact))
            labels |= {h[0][2] for h in hits if h[2] or not any(h[1] <= g[1] and g[0] > h[0] for g in hits)}
            best += [h[0][1] for h in hits]
    base = {label for _, label in places}
    return len(words), places, sorted(base), sorted(base | labels), max(best)


def check_licenses(docs):
    rows = L.license_scan(docs).collect()
    by = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        by[r.doc_id].append(brute_licenses(r.text))
    assert len(rows) == docs.count()
    for r in rows:
        found = [b for b in by[r.doc_id] if (b[0], len(b[1]), ",".join(b[3])) == (r.n_words, r.n_base, r.labels)]
        assert found, r
        n, places, base, _, score = found[0]
        assert r.base_labels == ",".join(base) and abs(r.score - score) < 1e-9
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_licenses_equal_brute_force(spark, odd, nothing):
    check_licenses(spark.read.parquet(f"{SF}/documents.parquet"))
    check_licenses(odd)
    assert L.license_scan(nothing).count() == 0


def test_templates_and_blocks(spark):
    texts = [
        "cc by nc cc by nc", "Under the MIT License under the mit license!", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "licensed%%% under gnu### affero general public license version 3",
        "x " * 500 + "this is free and unencumbered software released into the public domain " + "y " * 500, "Apache License,\nVersion 2.0", "apache", "the GNU General Public License", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_licenses(docs)
    got = {r.doc_id: r for r in L.license_scan(docs).collect()}
    assert got[0].n_base == 2 and got[0].first_word == 0 and got[0].last_word == 3
    assert got[2].labels == "cc-by" and got[3].labels == "cc-by-nc" and got[4].labels == "agpl-3" and got[5].labels == "unlicense"


def test_wrapped_and_several_notices(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files",
        "This program is free software: you can redistribute\nit and/or modify it under the terms of\nthe GNU General Public License",
        "This work is licensed under the GNU General Public License version 2, or licensed under the GNU Lesser General Public License",
        "Licensed under CC BY 4.0, parts licensed under CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
    ]
    got = {r.doc_id: (r.labels, r.n_blocks) for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1), 1: ("gpl", 1), 2: ("gpl-2,lgpl", 1), 3: ("cc-by,cc-by-nc", 1), 4: ("cc-by-nc", 1)}
    check_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_wrapped_notices_equal_brute_force(spark):
    """Templates with words changed, left out and wrapped at random places, between other lines."""
    r = random.Random(12)
    texts = []
    for k in range(300):
        words = [w for w in r.choice(L.TEMPLATES)[1].split() if r.random() > 0.1]
        out = []
        for w in ["x"] * r.randint(0, 70) + words + ["y"] * r.randint(0, 70) + r.choice(L.TEMPLATES)[1].split() * (k % 2):
            out.append((w.upper() if r.random() < 0.2 else w) + r.choice([" ", " ", " ", ", ", "\n"]))
        texts.append("".join(out))
    check_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


# Made by hand: notices and the labels that they have.
TRUTH = [
    ("Licensed under the Eclipse Public License version 2.0", ""), ("Licensed under the Eclipse Public License", ""), ("The album was released under license; the band went on tour", ""),
    ("licensed under the GNU General Public License version 3", "gpl-3"), ("GNU General Public License version 3", ""), ("licensed under the GNU Lesser General Public License version 3", "lgpl"),
    ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl"), ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"), ("licensed under the GNU Library General Public License version 2", "lgpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl"),
    ("Released under the MIT license.", "mit"), ("Licensed under MIT license", "mit"), ("Licensed under the Apache License, Version 2.0", "apache-2"), ("licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("licensed under CC BY-NC-ND 4.0", "cc-by-nc,cc-by-nc-nd"),  # cc by nc is a base phrase
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"), ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under the European Union Public Licence version 1.2", ""), ("licensed under the Common Public License version 1.0", ""), ("Licensed under the Microsoft Public License", ""),
    ("licensed under the Mozilla Public License version 1.1", ""), ("Licensed under the Academic Free License version 3.0", ""), ("Licensed under the Open Software License version 3.0", ""),
    ("Licensed under the Apple Public Source License version 2.0", ""), ("Licensed under the Artistic License version 2.0", ""), ("licensed under the SIL Open Font License, Version 1.1", ""),
    ("licensed under the GNU Free Documentation License, version 1.3", ""), ("licensed under the GNU Free Documentation License, version 3", ""), ("Licensed under the Boost Software License, Version 1.0", ""),
    ("Licensed under the Apache Software License, Version 1.1", ""), ("released under the zlib license", ""), ("released under the Python Software Foundation License version 2", ""),
    ("Licensed under the Educational Community License, Version 2.0", ""), ("Licensed under the Mulan PSL v2", ""), ("licensed under the CeCILL license version 2.1", ""), ("Licensed under the PostgreSQL License", ""),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ""),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ""),
    ("You may not use this file except in compliance with the License. You can obtain a copy of the license at http://www.opensource.org/licenses/cddl1.php", ""),
    ("released under the license of the label", ""), ("The film was released in 2 0 0 3; the public was licensed under the version of the license", ""), ("the work is under the law of the author, to whom all rights of this are due", ""),
    ("Released under the WTFPL license", ""), ("the mit press released a book under the title of the license", ""), ("mit der Lizenz, released under license", ""), ("licensed under the Oracle Public License version 4", ""),
    ("Licensed under the University of Illinois/NCSA Open Source License", ""), ("licensed under the Q Public License version 1.0", ""), ("licensed under the Sun Public License version 1.0", ""), ("licensed under the IBM Public License version 1.0", ""),
    ("licensed under the Nokia Open Source License version 1.0", ""), ("licensed under the Reciprocal Public License version 1.5", ""), ("licensed under the Sleepycat License", ""), ("under the Vim license", ""),
    ("Licensed under the Lucent Public License version 1.02", ""), ("licensed under the RealNetworks Public Source License version 1.0", ""), ("licensed under the W3C Software Notice and License", ""),
]


def test_labels_are_those_made_by_hand(spark):
    around = [("{}", 0), ("Some text ahead, and more.\n{}\nAnd after it, the public of the version.", 1), ("w " * 70 + "{} " + "x " * 70, 2)]
    rows = [(3 * i + k, a.format(t)) for i, (t, _) in enumerate(TRUTH) for a, k in around]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.license_scan(docs).collect()}
    wrong = [(dict(rows)[i], labels, TRUTH[i // 3][1]) for i, labels in sorted(got.items()) if labels != TRUTH[i // 3][1]]
    assert not wrong, wrong
    check_licenses(docs)


def test_labels_of_the_documents(spark):
    """The notices that the given documents hold, found by plain search, and no others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    notices = {"gnu general public license version 3": "gpl-3", "under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    plain = {r.doc_id: " ".join(WORD.findall((r.text or "").translate(LOW))) for r in docs.collect()}
    for r in L.license_scan(docs).collect():
        assert r.labels == ",".join(sorted(v for k, v in notices.items() if f" {k} " in f" {plain[r.doc_id]} ")), r
