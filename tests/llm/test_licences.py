import random
import re
import time

import pytest

from opinara.llm import licences


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_equals_brute_force(spark):
    rng = random.Random(9)
    parts = ["under the MIT License. ", "Apache License, Version 2.0", "CC-BY-NC ", "cc by ", "nc ", "é", "the ", "\n", "_", "\x00", "Ünder the mit license", "mit"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(1000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan_licences(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "expression, value",
    [
        ("MIT", (1.0, {"mit"})),
        ("MIT OR GPL-3.0-only", (1.0, {"mit"})),
        ("GPL-3.0-only OR MIT AND CC-BY-NC-4.0", (0.5, {"gpl-3"})),
        ("(GPL-3.0-only OR MIT) AND Apache-2.0 */", (1.0, {"mit", "apache-2"})),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT", (0.7, {"gpl-2", "mit"})),
        ("((MIT))", (1.0, {"mit"})),
        ("MIT Apache-2.0", (1.0, {"mit"})),
        ("MIT */ and other words", (1.0, {"mit"})),
        ("MIT # or GPL-3.0-only", (1.0, {"mit"})),
        ("MIT OR", None), ("(MIT", None), ("AND MIT", None), ("", None), (")", None), ("MIT)", (1.0, {"mit"})),
    ],
)
def test_expressions(expression, value):
    found = licences.evaluate(expression)
    assert (found and (found[0], set(found[1]))) == value


def test_labels_and_edges(edge_docs):
    assert licences.scan("All rights reserved. SPDX-License-Identifier: MIT OR X")[5:] == ("all-rights-reserved,mit", 0.0)
    assert licences.scan("# spdx-license-identifier: (broken")[5:] == ("", 0.0)
    rows = licences.scan_licences(edge_docs).collect()
    assert len(rows) == 8 and {tuple(r[-7:]) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 0, None, None, "", "", 0.0)}
    assert licences.scan_licences(edge_docs.limit(0)).count() == 0


def test_the_callers_tables(spark):
    df = spark.createDataFrame([(1, "Ünder house rules, v1; MIT. Under the MIT license")], "doc_id long, text string")
    row = licences.scan_licences(df, notices={"Ünder house rules": "house"}, freedom={"house": 0.8, "mit": 0.9}).first()
    assert (row.n_base, row.first_word, row.labels, row.score) == (1, 5, "house,mit", 0.8)


def test_time_in_proportion_to_the_phrases():
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert licences.scan("cc by nc " * n)[1:4] == (n, 0, 3 * (n - 1))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * seconds[0]
