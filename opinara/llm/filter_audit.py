"""Audit of how quality filters interact, from a sparse document-term matrix.

Documents are cut into shards of bounded size, each with its own words and a matrix of counts in compressed sparse rows. The
shards' words, not those of the documents, meet to get one number over all shards, and each matrix is rewritten by those
numbers. Its row sums are the documents' words, its nonzero counts their different words, which decide two
of the filters. From every document's failures follow, for each order of the filters, what each
step removes, what it finds removed already, and what it costs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from opinara.workspace import stored

#: Bytes of text in a shard; a longer document is a shard of its own.
TOGETHER = 12_000_000
#: Places of words that a task holds before it hands them on.
HELD = 1_000_000
#: The filters' limits, and the characters that one of them looks for.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
#: Bytes that continue a character of UTF-8.
_FOLLOWING = bytes(range(128, 192))
_MATRIX = "shard bigint, rows array<struct<key: {key}, part: string, chars: bigint, capitals: bigint, symbols: boolean, digest: binary>>, starts binary, terms binary, counts binary"
#: Bits for a word's number among those of its task.
_OWN = 33


def _shard_of(bodies: list[bytes]) -> tuple[list[bytes], array, np.ndarray, array]:
    """The words of some texts in the order they come, and the matrix as row starts, word places and counts."""
    words: dict[bytes, int] = {}
    starts, terms, counts = array("i", [0]), array("i"), array("i")
    for body in bodies:
        row = Counter(body.split())
        terms.extend([words.setdefault(w, len(words)) for w in row])
        counts.extend(row.values())
        starts.append(len(terms))
    return list(words), starts, _narrow(terms, len(words)), counts


def _narrow(terms: array, n: int) -> np.ndarray:
    """Numbers below ``n`` as little-endian ones of three bytes, or of four where there are too many."""
    four = np.asarray(terms, "<u4")
    return four if n > 1 << 24 else four.view(np.uint8).reshape(-1, 4)[:, :3]


def _wide(given: bytes, count: int) -> np.ndarray:
    """``count`` numbers that ``_narrow`` made narrow."""
    if len(given) == 4 * count:
        return np.frombuffer(given, "<u4")
    four = np.zeros((count, 4), np.uint8)
    four[:, :3] = np.frombuffer(given, np.uint8).reshape(-1, 3)
    return four.view("<u4").ravel()


def _facts(body: bytes) -> tuple[int, int, bool, bytes]:
    """Code points, capitals, whether a symbol is there, and the text's digest."""
    return (
        len(body.translate(None, _FOLLOWING)),
        len(body) - len(body.translate(None, _CAPITALS)),
        len(body.translate(None, SYMBOLS)) < len(body),
        hashlib.sha256(body).digest(),
    )


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, together: int) -> Iterator[pa.RecordBatch]:
    made = 0

    def shard(held: list[tuple]) -> pa.RecordBatch:
        nonlocal made
        bodies = [x[2] for x in held]
        words, *matrix = _shard_of(bodies)
        rows = [dict(zip(("key", "part", "chars", "capitals", "symbols", "digest"), (key, part, *_facts(body)))) for key, part, body in held]
        name = (TaskContext.get().partitionId() << 33) + made
        made += 1
        values = (name, rows, *[x.tobytes() for x in matrix])
        columns = [pa.array([v], field.type) for v, field in zip(values, schema)]
        every = pa.array(words, pa.binary())
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and size + len(row[2]) > together:
                yield shard(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield shard(held)


def _by_word(shards: DataFrame) -> DataFrame:
    """The places of words in shards, equal words side by side; a word is in a shard once, so in no more rows than there are shards."""
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = shards.select("shard", F.posexplode("words").alias("place", "word"))
    return places.repartition(tasks, "word").sortWithinPartitions("word")


def _numbers(words: pa.Array, last: bytes | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For words in order, of which ``last`` came before as the ``n``-th: which are new, and the number of each in its task."""
    new = np.ones(len(words), bool)
    new[0] = words[0].as_py() != last
    if len(words) > 1:
        new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
    return new, n - 1 + np.cumsum(new)


def _numbered(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    """The words' terms: a row for each word, or with ``ids`` for each shard the places of words and their numbers, in bounded parts."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    held: list[tuple[np.ndarray, ...]] = []

    def by_shard() -> pa.RecordBatch:
        shards, places, own = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(shards, kind="stable")
        cuts = np.flatnonzero(np.diff(shards[order], prepend=-1))
        parts = [[x.tobytes() for x in np.split(a[order].astype("<i4"), cuts[1:])] for a in (places, own)]
        columns = [pa.array(shards[order][cuts], pa.int64()), pa.array([task] * len(cuts), pa.int64()), *[pa.array(p, pa.binary()) for p in parts]]
        return pa.RecordBatch.from_arrays(columns, ["shard", "task", "places", "own"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        new, own = _numbers(words, last, n)
        last, n = words[-1].as_py(), int(own[-1]) + 1
        if not ids:
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(new)), pa.array((task << _OWN) + own[new], pa.int64())], ["word", "term"])
            continue
        held.append((batch.column("shard").to_numpy(), batch.column("place").to_numpy(), own))
        if sum(len(x[0]) for x in held) >= HELD:
            yield by_shard()
            held = []
    if held:
        yield by_shard()


def document_term_shards(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``df`` as shards, and its dictionary: each ``word`` of all shards with its ``term``.

    A shard has ``rows`` (key, part and facts of each document), and its matrix as little-endian numbers: ``starts`` (32 bits) of the rows,
    ``terms`` (64 bits, ascending in each row) by the dictionary, ``counts`` (32 bits), and each row's ``sums``. Terms follow from the words and the session's
    number of shuffle partitions, so that a task that runs again gives the same; they have gaps. Words are runs of
    characters that are not ASCII white space, case kept; a null text is empty. Repeated rows are rows of their own. Other columns are not read.
    """
    kind = _MATRIX.format(key=df.schema[key].dataType.simpleString())
    schema = T.StructType.fromDDL(f"{kind}, words array<binary>")
    arrow = to_arrow_schema(schema)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    given = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("body"))
    local = stored(given.mapInArrow(lambda batches: _cut(batches, arrow, together), schema), "local-shards")
    dictionary = _by_word(local).mapInArrow(lambda batches: _numbered(batches, ids=False), "word binary, term bigint")
    numbers = _by_word(local).mapInArrow(lambda batches: _numbered(batches, ids=True), "shard bigint, task bigint, places binary, own binary")
    numbers = numbers.groupBy("shard").agg(F.collect_list(F.struct("task", "places", "own")).alias("numbers"))
    met = local.drop("words").join(numbers, "shard", "left")

    def renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                starts, counts = (np.frombuffer(batch.column(c)[i].as_buffer() or b"", np.int32) for c in ("starts", "counts"))
                parts = [(x["task"], np.frombuffer(x["places"], "<i4"), np.frombuffer(x["own"], "<i4")) for x in batch.column("numbers")[i].as_py() or []]
                terms = np.zeros(sum(len(p) for _, p, _ in parts), np.int64)
                for task, places, own in parts:
                    terms[places] = (task << _OWN) + own.astype(np.int64)
                each = terms[_wide(batch.column("terms")[i].as_py(), len(counts))]
                order = np.lexsort((each, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                counts = counts[order]
                out.append((each[order].tobytes(), counts.tobytes(), _sums(starts, counts)))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.list_(_SUMS)))] if out else []
            if made:
                yield pa.RecordBatch.from_arrays([*batch.select(["shard", "rows", "starts"]).columns, *made], names=["shard", "rows", "starts", "terms", "counts", "sums"])

    return met.mapInArrow(renumbered, f"{kind}, sums array<struct<n_words: bigint, n_distinct: bigint>>"), dictionary


_SUMS = pa.struct([("n_words", pa.int64()), ("n_distinct", pa.int64())])


def _sums(starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The sum of each row of a matrix, and its nonzero counts."""
    totals = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts]
    return pa.StructArray.from_arrays([pa.array(np.diff(totals)), pa.array(np.diff(starts).astype(np.int64))], ["n_words", "n_distinct"])


def row_statistics(shards: DataFrame) -> DataFrame:
    """Per document its facts, ``n_words`` (the sum of its row) and ``n_distinct`` (the nonzero counts in it)."""
    each = shards.select(F.explode(F.arrays_zip("rows", "sums")).alias("x"))
    return each.select("x.rows.*", "x.sums.*")


def failures(statistics: DataFrame) -> DataFrame:
    """Per document ``key``, ``part`` and ``fails``: the letters of the filters it fails, of A to E.

    Too few words (A), too few different ones (B), too many capitals (C), a symbol (D), a text that a smaller key
    has (E). A null key is not compared: it never fails E, nor makes others fail it.
    """
    rows = stored(statistics, "row-statistics")
    # One row has a text's smallest key, so that joining by both doesn't bring a text of many copies to one task.
    first = rows.groupBy(F.col("digest").alias("of")).agg(F.min("key").alias("least"))
    met = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("key") == F.col("least")), "left")
    letters = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("chars"),
        "D": F.col("symbols"),
        "E": F.col("key").isNotNull() & F.col("least").isNull(),
    }
    return met.select("key", "part", F.concat(*[F.when(test, x).otherwise("") for x, test in letters.items()]).alias("fails"))


def audit(fails: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """For each part, order of the filters and step of it, the counts of documents.

    ``fails`` has per document its ``part``, the letters it ``fails``, and whether it is ``good`` and ``toxic``. Documents
    that are alike in all of these are counted together first, so that what orders multiply is small.
    """
    kinds = stored(fails.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n")), "failure-kinds")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = kinds.withColumn("filter_order", F.explode(orders))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("i", "letter"))
    now = F.contains("fails", F.col("letter"))
    gone = F.expr("translate(fails, substring(filter_order, 1, i), '') <> fails")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    summed = steps.groupBy("part", "filter_order", (F.col("i") + 1).cast("int").alias("step"), "letter").agg(
        count(~now & ~gone).alias("kept"),
        count(now & ~gone).alias("removed"),
        count(now & gone).alias("redundant"),
        count(F.col("fails") == F.col("letter")).alias("unique_fails"),
        count(now & ~gone & F.col("good")).alias("good_lost"),
        count(now & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def _labelled(labels: DataFrame, key: str) -> DataFrame:
    """One row per key: whether any of its labels says good, and whether any says toxic."""
    either = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    return labels.groupBy(F.col(key).alias("of_label")).agg(either("quality"), either("toxic"))


def audit_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", together: int = TOGETHER) -> DataFrame:
    """The audit of the filters A to E over whole texts, per value of ``part`` (null: empty).

    A null text is empty. Repeated rows each count; a key with several labels is good or toxic if one of them
    says so; one without labels is neither. Every part has a row for each order and step, zeros included; an empty table has no
    parts. Columns other than these three are not read.
    """
    shards, _ = document_term_shards(df, key, text, part, together)
    found = failures(row_statistics(shards))
    met = found.join(_labelled(labels, key), F.col("key") == F.col("of_label"), "left")
    none = F.lit(False)
    return audit(met.select("part", "fails", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")))
