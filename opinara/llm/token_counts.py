"""Token counts by byte-pair merging with a heap and a linked list, with no identifiers made.

A text becomes one symbol per character. The adjacent pair whose union has the lowest rank is
merged, again and again; the count is the number of symbols less the merges, and a character without a piece of
its own counts as its bytes. No piece of the vocabulary goes on after a word, so merges stay within
a word, and a word that was counted once need not be counted again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import without

SPACE = "▁"
#: Words, and runs within them, that a worker remembers, and the longest of them; others are counted anew each time.
REMEMBERED, LONGEST = 500_000, 40


class PieceCounter:
    """Counts tokens as the vocabulary's own library does, for a model without text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] << 64 for piece, score in scores.items()}
        #: Characters that stand side by side in some piece; no merge goes over any other pair.
        self.touching = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        if any(not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) or (len(p) > 1 and "\n" in p) for p in self.ranks):
            raise ValueError("a piece of this vocabulary goes beyond a word")
        self.words: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def merge(self, symbols: str) -> int:
        """Tokens of one run of characters.

        A heap entry is one number: the pair's rank, then its place, then its length.
        """
        rank, n = self.ranks.get, len(symbols)
        parts: list[str] = list(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r | i << 32 | 2 for i in range(n - 1) if (r := rank(symbols[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry >> 32 & 0xFFFFFFFF
            j = following[i]
            # A pair whose left or right side has grown or gone since is out of date.
            if j >= n or not parts[i] or len(parts[i]) + len(parts[j]) != entry & 0xFFFFFFFF:
                continue
            whole = parts[i] = parts[i] + parts[j]
            parts[j] = ""
            merges += 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                wider = whole + parts[k]
                if (r := rank(wider)) is not None:
                    heappush(heap, r | i << 32 | len(wider))
            h = before[i]
            if h >= 0:
                wider = parts[h] + whole
                if (r := rank(wider)) is not None:
                    heappush(heap, r | h << 32 | len(wider))
        return n - merges + sum(len(p.encode()) - 1 for p in parts if len(p) == 1 and p not in self.ranks)

    def joined(self, symbols: str) -> int:
        """Tokens of a word: the sum over the runs that no merge can join."""
        cuts = [i for i in range(1, len(symbols)) if symbols[i - 1 : i + 1] not in self.touching]
        return sum(map(self.run, (symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)]))))

    def run(self, symbols: str) -> int:
        found = self.runs.get(symbols)
        if found is None:
            found = self.merge(symbols)
            if len(symbols) <= LONGEST and len(self.runs) < REMEMBERED:
                self.runs[symbols] = found
        return found

    def word(self, word: str) -> int:
        """Tokens of a word after a space, or of a word that begins with its line break."""
        if word[:1] == "\n":
            found = 1 + (self.joined(word[1:]) if len(word) > 1 else 0)
        else:
            found = self.joined(SPACE + word)
        if len(word) <= LONGEST and len(self.words) < REMEMBERED:
            self.words[word] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of a text; a space comes before it and every space is a symbol, as the model has it."""
        if not text:
            return 0
        if text[0] == " " or "  " in text or SPACE in text:
            return sum(map(self.joined, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))))
        # No piece goes over a line break, and what follows one has no space before it.
        words = text.replace("\n", " \n").split(" ")
        found = list(map(self.words.get, words))
        return sum([self.word(w) if n is None else n for w, n in zip(words, found)] if None in found else found)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of each text under the vocabulary at ``path``, a file on every worker; null counts as empty."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([counter(path).count(t) for t in texts], dtype="int64")

    return counted(text)


def token_counts(df: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to the columns of ``df`` less its text.

    Columns of these names are replaced. A null or empty text has no bytes and no tokens; repeated
    rows each get their count. One pass per text, no shuffle; each worker remembers at most
    ``REMEMBERED`` words.
    """
    rest = without(df, text, "n_bytes", "n_tokens", "over_limit").columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = df.select(
        *[F.col(f"`{c}`") for c in rest], F.octet_length(body).cast("long").alias("n_bytes"), count_tokens(body, path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
