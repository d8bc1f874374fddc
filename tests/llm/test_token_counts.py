import random

import public_tokenizers
import sentencepiece

from opinara.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library(spark, sf_dir):
    rng = random.Random(1)
    parts = list("abc  theéñ\n\t\r▁,.'<s>日本😀ﬁ 012") + ["the ", "in", "▁▁", "<0x0A>", "</s>", " \n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", " ", "\n", " \n", "a ", "  ", "▁", " a", "a  \nb", "\n\n", "a \n", "a\x00b", "x" * 50_000, "ab" * 20_000 + " " * 100]
    counter, library = token_counts.PieceCounter(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text))
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 4096)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter, library = token_counts.PieceCounter(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "one two three four five one two three, four. five\nsix"
    assert [counter.count(text) for _ in range(2)] == [len(library.encode(text))] * 2
    assert len(counter.words) <= 3 and len(counter.runs) <= 3


def test_edges(edge_docs):
    rows = token_counts.token_counts(edge_docs, PATH, limit=5).collect()
    assert len(rows) == 8 and {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (2, 3)} == {(0, 0, False)}
    assert token_counts.token_counts(edge_docs.limit(0), PATH).count() == 0
