"""License scans of notices that split, and of real, hard-wrapped texts."""

from tracewright.llm import licenses


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licenses.licences(docs).orderBy("doc_id").collect()


def test_a_number_alone_is_no_licence(spark):
    notice = licenses.SENTENCES["mpl-notice"]
    found = scan(spark, ["2.0", "# 2.0\ntext", "Under the GPL v. 2.0. More.", f"{notice}.", notice.replace("v. 2.0", "v. 1.1")])
    assert [r["licence"] for r in found] == [None, None, None, "MPL-2.0", None]


MIT = """MIT License

Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
 * Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
is distributed on an "AS IS" BASIS.
"""


def test_wrapped_texts(spark):
    commented = "".join(f"# {x}\r\n" for x in APACHE.split("\n"))
    texts = [MIT, BSD, APACHE, commented, "Code\nReleased under the\nMIT License\nmore", "Not released under the\nMIT License\n"]
    assert [r["rules"] for r in scan(spark, texts)] == [["mit-text"], ["bsd3-text"], ["apache-header-2"], ["apache-header-2"], ["mit-notice"], []]


def paragraphs(*ids, wrap=72, lead=""):
    """Sentences of the table as a text wrapped at `wrap` characters, each line after `lead`."""
    import textwrap

    out = ["Copyright 2019 Somebody"]
    for i in ids:
        out += ["", *textwrap.wrap(licenses.SENTENCES[i] + ".", wrap)]
    return "\n".join((lead + line).rstrip() for line in out) + "\n"


def test_every_rule_is_found_wrapped_and_in_comments(spark):
    """Each rule's own text gives the rule itself and nothing else, in plain lines, behind comment signs, and between other prose."""
    shapes = (lambda ids: paragraphs(*ids), lambda ids: paragraphs(*ids, wrap=50, lead=" * "), lambda ids: "Some prose.\n\n" + paragraphs(*ids, lead="// ") + "\nint main() { return 0; }\n")
    texts = [shape(rule[3]) for rule in licenses.RULES for shape in shapes]
    rows = scan(spark, texts)
    names = [rule[0] for rule in licenses.RULES for _ in shapes]
    assert [r["rules"] for r in rows] == [[n] for n in names]
    assert len({rule[1] for rule in licenses.RULES}) >= 40


GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""
ISC = """Copyright (c) 2004, 2005 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""


def test_whole_texts_of_other_licences(spark):
    versions = [GPL, GPL.replace("Version 3, 29 June 2007", "Version 2, June 1991"), GPL.replace("GENERAL", "LESSER GENERAL"), GPL.replace("GENERAL", "AFFERO GENERAL").replace("29 June", "19 November"), ISC]
    assert [r["licence"] for r in scan(spark, versions)] == ["GPL-3.0-only", "GPL-2.0-only", "LGPL-3.0-only", "AGPL-3.0-only", "ISC"]


def test_sentences_of_any_length_are_read(spark):
    """White space within a sentence, however much, cuts nothing."""
    texts = ["Released under" + " " * 2000 + "the MIT License.", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n" + "word " * 50_000]
    assert [r["licence"] for r in scan(spark, texts)] == ["MIT", "CC-BY-NC-4.0"]


def brute(text):
    """Rules of a text by looking at every run of lines in every paragraph."""
    import re

    table, ids = licenses.known(), []
    ended = re.sub(r"[.!?;]+(?=[\x20\x09-\x0D]|$)", "\n\n", text.lower())
    for block in re.split(r"\n[^a-z0-9]*\n", ended):
        lines = [p for p in (licenses.plain(x) for x in block.split("\n")) if p]
        at = 0
        while at < len(lines):
            ends = [e for e in range(len(lines), at, -1) if " ".join(lines[at:e]) in table]
            if ends:
                ids.append(table[" ".join(lines[at : ends[0]])])
            at = ends[0] if ends else at + 1

    def there(seq):
        rest = iter(ids)
        return all(i in rest for i in seq)

    seqs = [licenses.sequence(rule[3]) for rule in licenses.RULES]
    met = [k for k, seq in enumerate(seqs) if there(seq)]
    return ids, [licenses.RULES[k][0] for k in met if not any(licenses.contains(seqs[j], seqs[k]) for j in met)]


def test_mixtures_against_brute_force(spark):
    import random

    rng, ids = random.Random(6), list(licenses.SENTENCES)
    texts = []
    for _ in range(60):
        some = [rng.choice(ids) for _ in range(rng.randrange(1, 7))] + list(rng.choice(licenses.RULES)[3])
        texts.append(paragraphs(*some, wrap=rng.choice((30, 60, 2000)), lead=rng.choice(("", "# ", "-- "))))
    assert [(r["sentence_ids"], r["rules"]) for r in scan(spark, texts)] == [brute(t) for t in texts]


def test_wrapped_sentences_are_the_same_rows_in_sql(spark):
    """Known sentences with line ends put in anywhere, in comments, one after another or cut short: query and SQL agree."""
    import random

    import duckdb
    import pandas as pd

    from tracewright.llm import queries

    pick = random.Random(6)
    known = [*licenses.IN_SHORT.values(), *licenses.SENTENCES.values()]
    texts = ["", "x\n\n\ny", None, "Licensed", *known]
    for _ in range(260):
        words = " ".join(pick.sample(known, pick.randint(1, 4))).split(" ")
        for _ in range(pick.randint(0, 4)):
            words.insert(pick.randrange(len(words) + 1), pick.choice(["\n", "\n", "\n# ", "\n\n", " * ", "extra", "\n  ", ". ", ";"]))
        text = " ".join(words)
        texts.append(pick.choice(["// ", "", "\n", "See: "]) + (text if pick.random() < 0.8 else text[: pick.randint(1, len(text))]) + pick.choice(["", "\n", ".", "!\n\nEnd"]))
    rows = list(enumerate(texts))
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    answer = c.execute(queries.op8_sql())
    columns = [d[0] for d in answer.description]
    expected = sorted(map(repr, answer.fetchall()))
    found = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string"))
    from pyspark.sql import functions as F

    got = found.select("doc_id", "n_sentences", *[F.array_join(x, ",").alias(x) for x in ("sentence_ids", "rules", "licences")], "licence", "commercial").select(*columns)
    got = sorted(repr(tuple(r)) for r in got.collect())
    assert got == expected
    assert sum("''" not in x for x in expected) > 60 and sum(x.count("''") < 3 for x in expected) > 150
