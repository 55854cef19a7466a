"""Licence scans against the notices planted in the documents, and edge cases."""

import time

import numpy as np
from pyspark.sql import functions as F

from spanline.llm import licenses, queries

DATA = "/root/testdata/sf0.01"
PLANTED = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit"}


def test_finds_the_notices_and_nothing_else(spark):
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        lines = r.text.split("\n")
        want = sorted({f for n, f in PLANTED.items() if any(n in x for x in lines)})
        assert got[r.doc_id].families == ",".join(want), (r.doc_id, got[r.doc_id])


def test_wrapped_and_several_notices(spark):
    """Notices over several lines, two in one line, and wordings that no template has."""
    scanner = licenses.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = [
        (1, "This file is licensed under the GNU General\nPublic License, version 3\nor later."),
        (2, "Dual licensed: licensed under the MIT License or licensed under the Apache License, Version 2.0."),
        (3, "licensed under the GNU General\n\nPublic License, version 3"),
        (4, "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License"),
        (5, "The library was released by its authors under the MIT License in May."),
        (6, "filler " * 500 + "\nThis Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0." + " more" * 500),
        (7, "The public may copy a notice of the library under the terms and conditions of the museum."),
    ]
    got = {r.doc_id: sorted(h.family for h in r.hits) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert got == {1: ["gpl-3.0"], 2: ["apache-2.0", "mit"], 3: [], 4: ["gpl-2.0"], 5: ["mit"], 6: ["mpl-2.0"], 7: []}


def test_held_out_families_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scanner = licenses.train(docs)
    rows = [(1, None), (2, ""), (3, "the license of the public\nall rights to the software"), (4, "Foo bar. SPDX-License-Identifier: BSD-3-Clause"), (5, "x " * 50_000 + "released under the mit license"), (None, "MIT is a school"), (6, "Code licensed under the Mozilla Public License, version 2.0, as is."), (6, "Code licensed under the Mozilla Public License, version 2.0, as is.")]
    got = {r.doc_id: [h.family for h in r.hits] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)), scanner).collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["bsd"], 5: ["mit"], None: [], 6: ["mpl-2.0"]}
    assert licenses.scan(docs.limit(0), scanner).count() == 0
    assert licenses.scan(docs, licenses.train(docs.limit(0))).count() == 1000


def test_near_families_and_other_wordings(spark):
    """Standard notices of licences that share most words, and wordings of their own."""
    scanner = licenses.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    notices = [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "gpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
        ("distributed under the terms of the MIT licence", "mit"),
        ("The code is available under Apache-2.0.", "apache-2.0"),
        ("Text is available under the Creative Commons Attribution-ShareAlike License 4.0; additional terms may apply.", "cc-by-sa"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ]
    rows = [(i, f"Some words before. {n}\nAnd some after it.") for i, (n, _) in enumerate(notices)]
    got = {r.doc_id: [h.family for h in r.hits] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert got == {i: [f] for i, (_, f) in enumerate(notices)}


def test_best_template_by_brute_force():
    """Every template, alone in other words, is found as its family's; what is found is what comparing all templates finds."""
    scanner = licenses.Scanner([f"plain words number {i} of the corpus" for i in range(300)])
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            w = licenses.hashed([f"see here {text} and so on"])[0]
            own = set(licenses.grams(w, 2).tolist())
            both = [(f, len(own & set(t.tolist())), len(t)) for f, t in scanner.templates]
            best = max((n - 2 * (m - n), n / m, f) for f, n, m in both if n >= licenses.FOUND * m)
            assert best == scanner.found_in(np.array(sorted(own), np.uint64))[0][:3]
            hits = [scanner.families[f] for f, _, _ in scanner.families_in(w)]
            assert hits[:1] == [family], (text, hits)


def test_fit_is_quick():
    since = time.perf_counter()
    licenses.Scanner([f"plain words number {i} of the corpus, and {i * 7} more" for i in range(2500)])
    assert time.perf_counter() - since < 15  # 5 on a quiet machine
