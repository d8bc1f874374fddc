import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from opinara.llm import filter_audit


def brute(docs, labels):
    """docs: doc_id, lang, text; labels: doc_id, quality, toxic."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, lang, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and least[t] < i,
        }
        own = [x for x in labels if i is not None and x[0] == i]
        facts.append((lang or "", {x for x, y in fails.items() if y}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {x[0] for x in facts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                here = [x for x in facts if x[0] == part and not x[1] & set(order[: step - 1])]
                lost = [x for x in here if letter in x[1]]
                failing = [x for x in facts if x[0] == part and letter in x[1]]
                counts = (len(here) - len(lost), len(lost), len(failing) - len(lost), sum(x[1] == {letter} for x in failing), sum(x[2] for x in lost), sum(x[3] for x in lost))
                out[part, order, step] = counts
                shapley[part, letter] = shapley.get((part, letter), 0) + len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit_documents(df, given, together=3000).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pool = ["ÄÖ", "é", "Word", "UPPER", "#", "a|b", "x y", "　", "\x00"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "\x0b".join(f"v{i}" for i in range(150))]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice(pool[: rng.choice([5, 40, 309])]) for _ in range(rng.randint(0, 250))) for _ in range(150)]
    docs = [(i, rng.choice(["en", "de", "", None]), rng.choice(texts)) for i in range(300)]
    docs += [(5, "en", "same"), (5, "en", "same"), (4, "en", "same"), (None, "en", "same"), (None, None, "only here")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 310, 2)] + [(4, 1, 1), (5, 0, 0), (5, 1, None), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_matrix(spark):
    texts = ["b a b", None, "", "a c", "c c c c c c c c c c c c", "z"]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").coalesce(1)
    shards, dictionary = filter_audit.document_term_shards(df, together=20)
    terms = {r.term: r.word.decode() for r in dictionary.collect()}
    assert sorted(terms.values()) == list("abcz")
    found = {}
    rows = shards.collect()
    assert len(rows) > 1
    for r in rows:
        starts, ids, counts = np.frombuffer(r.starts, "<i4"), np.frombuffer(r.terms, "<i8"), np.frombuffer(r.counts, "<i4")
        for doc, a, b in zip(r.rows, starts, starts[1:]):
            assert list(ids[a:b]) == sorted(ids[a:b])
            found[doc.key] = {terms[t]: int(n) for t, n in zip(ids[a:b], counts[a:b])}
    assert found == {0: {"a": 1, "b": 2}, 1: {}, 2: {}, 3: {"a": 1, "c": 1}, 4: {"c": 12}, 5: {"z": 1}}


def test_edges(spark, edge_docs):
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit_documents(docs, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
