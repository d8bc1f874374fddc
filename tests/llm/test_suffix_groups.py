import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinara.llm import suffix_groups


def brute(texts, length):
    """Per text: bytes, removed, spans, kept."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def found(spark, texts, **given):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_groups.dedup_bytes(df, **given).collect()}
    return [rows[i] for i in range(len(texts))]


def copies(rng, n, length, letters):
    """Texts made of copies of passages, cut and changed anywhere."""
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.randint(length // 2, 4 * length)) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            part = p[a : a + rng.randint(0, len(p))] if rng.random() < 0.5 else p
            if part and rng.random() < 0.3:
                k = rng.randrange(len(part))
                part = part[:k] + rng.choice(letters) + part[k + 1 :]
            parts += [part, word(rng.randint(0, 30))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed, length, anchor, letters", [(1, 200, 32, "abcdefgh é"), (2, 24, 8, "ab"), (3, 40, 16, "abcé")])
def test_equals_brute_force(spark, seed, length, anchor, letters):
    rng = random.Random(seed)
    texts = copies(rng, 150, length, letters) + [None, "", "short", "x" * 5 * length, "ab" * 3 * length, "x" * length, "y" * (length + 1)]
    assert found(spark, texts, length=length, anchor=anchor) == brute(texts, length)


def test_a_bucket_that_is_split(spark):
    rng = random.Random(4)
    noise = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(100, 400)))
    passage = "".join(rng.choice("klmnopqrst ") for _ in range(450))
    texts = [noise() + passage + noise() for _ in range(suffix_groups.MOST + 100)]
    assert found(spark, texts) == brute(texts, 200)


def test_long_text_in_pieces(spark):
    rng = random.Random(5)
    letters = [chr(97 + i) for i in range(26)]
    text = "".join(rng.choices(letters, k=suffix_groups.TOGETHER + 50_000))
    cut = suffix_groups.TOGETHER
    texts = [text, text[cut - 300 : cut + 300], "other"]
    assert [x[:3] for x in found(spark, texts)] == [(len(text), 600, 1), (600, 600, 1), (5, 0, 0)]


def test_edges(spark, edge_docs):
    whole = "".join(f"word{i} " for i in range(60))
    same = spark.createDataFrame([(1, whole), (1, whole), (None, whole[:250] + "!"), (1, "other")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_groups.dedup_bytes(same).collect())
    assert rows == [(0, 251, 250, 1), (1, 5, 0, 0), (1, len(whole), len(whole), 1), (1, len(whole), len(whole), 1)]
    docs = edge_docs.withColumn("kept", F.lit("clash")).withColumn("begin", F.lit("clash"))
    got = suffix_groups.dedup_bytes(docs)
    assert got.columns == [c for c in docs.columns if c not in ("text", "kept")] + ["n_bytes", "n_removed", "n_spans", "kept"]
    assert {(r.n_bytes, r.n_removed) for r in got.collect() if r.doc_id in (2, 3)} == {(0, 0)}
    assert got.count() == 8
    assert suffix_groups.dedup_bytes(edge_docs.limit(0)).count() == 0


def test_intervals_and_groups():
    assert list(suffix_groups.intervals([1, 3, 0, 2])) == [(3, 1, 2), (1, 0, 2), (2, 3, 4)]
    after, before = [b"xyz1", b"xyz2", b"xy", b"q"], [b"ba", b"bc", b"ba", b"ba"]
    found = [(back, ahead, set(members)) for back, ahead, members in suffix_groups.maximal_repeats(after, before, 4)]
    assert found == [(1, 3, {0, 1}), (2, 2, {0, 2})]
