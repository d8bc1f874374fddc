"""Packing of tokenised documents into sequences by minimum bin slack.

Documents are cut into pieces of at most a sequence's length. Only the number of pieces of each
length matters for packing, at most one number per length up to a sequence's. From those counts the fullest
combination is found for one bin after another by subset sums over a bitset, and used as often
as its lengths last. Each piece takes its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.shared import WordMemory
from opinara.workspace import stored

#: Stems whose identifiers a worker remembers; it remembers half as many words as they are written.
REMEMBERED = 600_000
_FIRST = (1 << 33) - 1


#: Latin letters that change neither in normalising nor, but for their case, in folding; marks after them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_STEM = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")


@lru_cache(maxsize=2)
def _memory(path: str) -> WordMemory:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, cut = tokenizer.model, tokenizer.pre_tokenizer
    stems: dict[str, bytes] = {}
    # How each letter's bytes are written for the merges.
    letters: dict[str, str] = {}

    def of_stem(stem: str) -> bytes:
        """Identifiers of letters in lower case, which cutting leaves in one piece, so that the merges can take them as they are."""
        if stem in stems:
            return stems[stem]
        for c in stem:
            if c not in letters:
                letters[c] = "".join(piece for piece, _ in cut.pre_tokenize_str(c))
        made = np.array([t.id for t in model.tokenize("".join(map(letters.__getitem__, stem)))], dtype="<u4").tobytes()
        if len(stems) < REMEMBERED and len(stem) <= 40:
            stems[stem] = made
        return made

    def made(word: str) -> bytes:
        """Identifiers as unsigned little-endian 32-bit numbers.

        The vocabulary cuts marks off letters and has no capitals, so letters with marks after them are made of the two.
        """
        parts = _STEM.fullmatch(word)
        if parts:
            return of_stem(parts[1].lower()) + (memory[parts[2]] if parts[2] else b"")
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    memory = WordMemory(made, REMEMBERED // 2)
    return memory


def encoded(text: str, path: str) -> bytes:
    """Identifiers of a text: those of its words in a row, since the vocabulary drops white space and joins nothing over it."""
    return _memory(path).of(text)


def pieces_of(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: key, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its text's identifiers and then ``end_id``; a null text counts as empty and is the
    end alone. Repeated rows are documents of their own. Columns besides key and text are left out.
    ``path`` is the vocabulary's file on every worker.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32"):
        schema = schema.add(name, T.LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [
                (i, at // capacity, at, min(capacity, len(ids) // 4 - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
                for i, ids in enumerate(encoded(t, path) + end for t in texts)
                for at in range(0, len(ids) // 4, capacity)
            ]
            if not rows:
                continue
            row, *columns = map(pa.array, zip(*rows), [pa.int64(), pa.int32(), *[pa.int64()] * 3])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *columns], schema.names)

    pair = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return pair.mapInArrow(cut, schema).withColumnRenamed("key", key)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best; of equals the one that uses the longest."""
    reached, steps = 1, []
    most = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reached))
            reached |= (reached << length * take) & most
            left, copies = left - take, copies * 2
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many of them, how many pieces of each length are in one).

    Each bin begins with the longest length left and is filled up as far as can be.
    """
    counts = {x: n for x, n in counts.items() if n}
    bins = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        inside = fullest({x: n for x, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in inside.items())
        for x, n in inside.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
        bins.append((times, inside))
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of: first rank, first sequence, pieces per sequence, offset of the first piece."""
    places: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, inside in bins:
        offset = 0
        for length, n in sorted(inside.items(), reverse=True):
            places.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in places.items()}


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; columns of these names are replaced.

    Every piece has a length from 1 to ``capacity``. Pieces of equal length may change places; which
    of them goes where follows from the hash of their columns. Sequences have no gaps. An empty table
    gives no rows. Rows are dealt out by ranges of length and hash, so a length that very many
    pieces have is in many partitions. To the driver come one row per partition and length in it, at
    most ``capacity`` more rows than partitions, and the bins made from them go to the tasks.
    """
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    mixed = pieces.select(*columns, F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("__mix"))
    ordered = mixed.repartitionByRange(f"`{length}`", "__mix").sortWithinPartitions(f"`{length}`", "__mix").drop("__mix")
    # The numbers are those of the written table, so that a task that runs again finds the same ones.
    numbered = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered-pieces")
    part, row = F.shiftright("__at", 33).cast("long"), F.col("__at").bitwiseAND(F.lit(_FIRST))
    runs = numbered.groupBy(part.alias("part"), F.col(f"`{length}`").cast("long").alias("length")).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n"))
    counts: dict[int, int] = {}
    bases: dict[tuple[int, int], int] = {}
    for r in sorted(runs.collect(), key=lambda r: (r.part, r.length)):
        bases[r.part, r.length] = counts.get(r.length, 0) - r.first
        counts[r.length] = counts.get(r.length, 0) + r.n
    places = _places(minimum_slack(counts, capacity))
    shared = numbered.sparkSession.sparkContext.broadcast((bases, places))

    def placed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        bases, places = shared.value
        for lengths, parts, rows in batches:
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for (part, size), at in pd.Series(np.arange(len(lengths))).groupby([parts.to_numpy(), lengths.to_numpy()]):
                i, table = at.to_numpy(), places[size]
                rank = rows.to_numpy()[i] + bases[part, size]
                first, begin, each, start = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T
                sequence[i] = begin + (rank - first) // each
                offset[i] = start + (rank - first) % each * size
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = F.pandas_udf(placed, "sequence_id long, offset long")(F.col(f"`{length}`").cast("long"), part, row)
    return numbered.select(*[F.col(f"`{c}`") for c in columns], found.alias("__place")).select(*[F.col(f"`{c}`") for c in columns], "__place.*")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises, cuts and packs documents: one row per piece with its sequence and place; texts are read once."""
    return pack(stored(pieces_of(df, path, capacity, key=key, text=text), "pieces"), capacity)
