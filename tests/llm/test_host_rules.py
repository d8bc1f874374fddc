import random
import re

from opinara.llm import host_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a b c d e a b c d e", "a " * 40, "x\nx\n\n y\nx", "😀 é#%\x0b&\x85z"]
    texts += ["".join(rng.choice(["a ", "b ", "c", "d\n", "\t", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[1:6]) for r in host_rules.measured(df).drop("text").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_hosts_with_mostly_failures_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, f"s{i % 5}") for i in range(500)] + [(1000 + i, "short" if i % 20 else good, "bad") for i in range(200)]
    rows += [(2000, good, None), (2001, "short", None), (2002, good, "one"), (2003, "short", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_rules.judge_documents(df).where("kept").collect()}
    assert kept == set(range(500)) | {2000, 2002}
    assert {r.doc_id for r in host_rules.keep_documents(df).collect()} == kept


def test_edges(spark, edge_docs):
    rows = host_rules.judge_documents(edge_docs).collect()
    assert len(rows) == 8
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in rows) == [
        (0, 14, False), (1, 11, False), (1, 11, False), (2, 0, True), (3, 0, True), (4, 0, True), (5, 60_000, False), (6, 11, False),
    ]
    assert {r.kept for r in rows if not r.base_failed} == {True}
    assert sorted(r.doc_id or 0 for r in host_rules.keep_documents(edge_docs).collect()) == [0, 1, 1, 5, 6]
    assert host_rules.keep_documents(edge_docs).columns == edge_docs.columns
    assert host_rules.judge_documents(edge_docs.limit(0)).count() == 0
    assert host_rules.keep_documents(edge_docs.limit(0)).count() == 0
