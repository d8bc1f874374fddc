import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from opinara.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_identifiers_equal_the_library(monkeypatch):
    rng = random.Random(1)
    parts = list("abc  theéñ\n\t\r▁,.'<s>日本😀ﬁ 012ΣΆ \x1c") + ["'ll", "'s", "<|endoftext|>", "<|startoftext|>", "the ", "IN", "İ", "ς"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "\n", "x" * 5000, "a " * 5000]
    texts += ["Word word, WORD. it's, I'll. a.b, .,", "ΟΔΟΣ, Σ. ﬁ, É, é."]
    expected = ids(texts)
    assert [np.frombuffer(packing.encoded(t, PATH), "<u4").tolist() for t in texts] == expected
    packing._memory.cache_clear()
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    assert [np.frombuffer(packing.encoded(t, PATH), "<u4").tolist() for t in texts] == expected
    packing._memory.cache_clear()


def test_fullest_equals_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 30), 4)}
        room = rng.randint(1, 60)
        used = packing.fullest(counts, room)
        assert all(used[x] <= counts[x] for x in used)
        best = max(sum(x * n for x, n in zip(counts, some)) for some in product(*[range(n + 1) for n in counts.values()]) if sum(x * n for x, n in zip(counts, some)) <= room)
        assert sum(x * n for x, n in used.items()) == best


def whole(rows, capacity):
    """Sequences, after a check that they are gapless and not too long."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packs_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    expected = {}
    for r, found in zip(kept := docs.collect(), ids([r.text for r in kept])):
        found = found + [1]
        for start in range(0, len(found), 4096):
            part = np.array(found[start : start + 4096], dtype="<u4")
            expected[r.doc_id, start // 4096] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    total = sum(r.length for r in rows)
    assert whole(rows, 4096) <= -(-total // 4096) + 1


def test_many_pieces_of_one_length(spark):
    rng = random.Random(6)
    lengths = [7] * 20_000 + [rng.randint(1, 40) for _ in range(10_000)] + [100] * 500
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(40)
    rows = packing.pack(df, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    assert whole(rows, 100) <= 1.01 * sum(lengths) / 100


def test_edges(spark, edge_docs):
    rows = packing.pack_documents(edge_docs, PATH, capacity=10).collect()
    assert whole(rows, 10) > 0
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.length))
    assert by_doc[2] == by_doc[3] == by_doc[4] == [(0, 1)]
    assert sorted(by_doc[1]) == [(0, 10), (0, 10), (1, 2), (1, 2)]
    assert sum(n for _, n in by_doc[5]) == len(ids([edge_docs.where("doc_id = 5").first().text])[0]) + 1
    assert None in by_doc
    assert packing.pack_documents(edge_docs.limit(0), PATH).count() == 0
