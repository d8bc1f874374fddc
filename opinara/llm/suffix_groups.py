"""Removes long byte strings that stand in more than one place, by enhanced suffix arrays over content-defined places.

Every string of ``length`` bytes holds an anchor: of the short strings in it the one with the smallest hash, the first of
equals. Equal strings have their anchors at equal offsets, so only suffixes that begin at anchors are sorted, not all.
Neighbouring strings share an anchor; with what they cover it is the anchor's chunk. A chunk found twice repeats as
a whole. Chunks found once, whose anchor stands in another chunk as well, repeat in parts. They meet in buckets by
anchor. There the suffixes from the anchor on are sorted with their common prefixes; a stack scan over these gives the tree of
prefix intervals. In each interval the texts before the anchor are scanned in the same way, from the anchor to the left: a
group whose extensions to the left differ, and whose members reach over more than one child of the interval,
is a maximal repeat, with all its places. A bucket too large for one task is split by the offsets of the anchor in
the strings sought, and by the text that all strings at these offsets share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import without
from opinara.workspace import stored

#: Bytes of a string that counts as a repeat, and of an anchor.
LENGTH, ANCHOR = 200, 32
#: Bytes whose anchors are looked for together; a longer text is cut where a chunk may be cut.
TOGETHER = 1 << 20
#: Chunks in a bucket that one task scans, and offsets in the parts of a larger one, from round to round.
MOST, SPANS = 400, (43, 11, 3, 1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def anchor_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """A hash of the ``anchor`` bytes from each byte on; ``data`` ends with as many zeros."""
    n = len(data) - anchor
    eights = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    mixed = np.zeros(n, np.uint64)
    for k in range(0, anchor, 8):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[4] + eights[k : k + n] * _FACTORS[k // 8 % 4]
    mixed ^= mixed >> np.uint64(32)
    return mixed * _FACTORS[0]


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by the least from both ends of blocks of that width."""
    blocks = -(-len(values) // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max)
    table[: len(values)] = values
    table = table.reshape(blocks, width)
    up = np.minimum.accumulate(table, axis=1).ravel()
    down = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(down[:count], up[width - 1 : width - 1 + count])


def anchors_of(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Per anchor: its text, its place, the least and most offset it has in strings it is the anchor of, its hash and its chunk's."""
    together = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    hashes = anchor_hashes(np.frombuffer(together + bytes(anchor), np.uint8), anchor)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = length - anchor + 1
    if len(keys) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    whose = np.searchsorted(ends, np.arange(len(keys) - width + 1), side="right")
    starts = np.flatnonzero(np.arange(len(whose)) + length <= ends[np.minimum(whose, len(ends) - 1)])
    chosen = (_least_in_windows(keys, width)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1 if len(first) else first
    at, low, high = chosen[first], starts[first], starts[last]
    view = memoryview(together)
    chunks = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(low.tolist(), high.tolist())), np.uint64, len(at))
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], at - high, at - low, hashes[at].view(np.int64), chunks.view(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, where the piece begins, piece); the strings of a long text are dealt out to pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), TOGETHER):
            piece = text[begin : begin + TOGETHER + length - 1]
            held.append((i, begin, piece))
            size += len(piece)
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(body: Column, length: int, anchor: int) -> Column:
    """The anchors of each text, as places with the hashes of anchor and chunk."""

    def found(bodies: pa.Array) -> pa.Array:
        texts = bodies.to_pylist()
        columns = [[] for _ in range(6)]
        for group in _pieces(texts, length):
            piece, at, *rest = anchors_of([x[2] for x in group], length, anchor)
            whose, begins = np.array([x[0] for x in group]), np.array([x[1] for x in group])
            for column, values in zip(columns, (whose[piece], at + begins[piece], *rest)):
                column.append(values)
        whose, at, least, most, anchors, chunks = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(whose.astype(np.int64), minlength=len(texts)))])
        places = [pa.array(x, pa.int32()) for x in (at, least, most)]
        each = pa.StructArray.from_arrays([*places, pa.array(anchors, pa.int64()), pa.array(chunks, pa.int64())], ["at", "least", "most", "anchor", "chunk"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)

    return F.arrow_udf(found, "array<struct<at: int, least: int, most: int, anchor: bigint, chunk: bigint>>")(body)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """The intervals of a sorted list whose neighbours share prefixes of these lengths: length, first and last place.

    A stack holds the open ones, shorter prefixes below longer ones; each is given when it closes, those inside before it.
    """
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*shared, 0]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield length, first, i
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, first))


def maximal_repeats(after: list[bytes], before: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """Groups of places that share a string of ``length`` or more around them: bytes before, bytes after, and all members.

    ``after`` has what follows each place, ``before`` what precedes it, read backwards. No group can be longer with the same members.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    shared = [_common(after[a], after[b]) for a, b in zip(order, order[1:])]
    rank = {member: i for i, member in enumerate(order)}
    back = {member: i for i, member in enumerate(sorted(order, key=before.__getitem__))}
    found = []
    for ahead, first, last in intervals(shared):
        members = sorted(order[first : last + 1], key=back.__getitem__)
        left = [_common(before[a], before[b]) for a, b in zip(members, members[1:])]
        # Texts that share too little before the place are cut apart; a string may begin at the place itself.
        wanted = max(length - ahead, 0)
        for extent, a, b in intervals([x + 1 if x >= wanted else 0 for x in left]):
            group = members[a : b + 1]
            ranks = [rank[m] for m in group]
            if min(shared[min(ranks) : max(ranks)]) == ahead:
                found.append((extent - 1, ahead, group))
    return found


def covered(after: list[bytes], before: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each place the spans, as bytes before and after it, of the maximal repeats it is in."""
    spans: list[set[tuple[int, int]]] = [set() for _ in after]
    for back, ahead, members in maximal_repeats(after, before, length):
        for m in members:
            spans[m].add((back, ahead))
    return [sorted(s) for s in spans]


_UNIT = "bucket binary, chunk bigint, single boolean, key {key}, hash bigint, at int, least int, most int, before binary, after binary"


def _around(df: DataFrame, wanted: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """The wanted chunks with the bytes before and after their anchors, each in the bucket of its anchor."""
    kind = _UNIT.format(key=df.schema[key].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["bucket", "chunk", "single", "key", "hash", "at", "least", "most", "before", "after"]
            rows = {n: [] for n in names}
            for i, (body, places) in enumerate(zip(batch.column("body").to_pylist(), batch.column("places").to_pylist())):
                for p in places:
                    at, least, most = p["at"], p["least"], p["most"]
                    values = (p["anchor"].to_bytes(8, "little", signed=True), p["chunk"], p["single"], i, p["hash"], at, least, most)
                    for n, v in zip(names, (*values, body[at - most : at][::-1], body[at : at - least + length])):
                        rows[n].append(v)
            types = [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary()]
            columns = {n: pa.array(rows[n], t) for n, t in zip(names, types)}
            columns["key"] = batch.column("key").take(columns["key"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    place = F.struct("at", "least", "most", "anchor", "chunk", "single", "hash")
    places = stored(wanted.groupBy(F.col("key").alias("__key"), F.col("hash").alias("__hash")).agg(F.collect_list(place).alias("places")), "wanted-chunks")
    docs = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("hash"), F.col(f"`{text}`").cast("binary").alias("body"))
    same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("hash") == F.col("__hash"))
    return docs.join(places.hint("merge"), same).select("key", "body", "places").mapInArrow(cut, kind)


def _split(units: DataFrame, span: int, length: int) -> DataFrame:
    """Units of large buckets by ranges of ``span`` offsets, in buckets by the bytes that all strings at these offsets hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                before, after, low, high = r["before"], r["after"], r["least"], r["most"]
                for x in range(low - low % span, high + 1, span):
                    # What strings at the offsets x to x + span - 1 share; a single offset's string as a whole.
                    core = before[:x][::-1] + after[: length - (x + span - 1)]
                    a, b = max(x, low), min(x + span - 1, high)
                    back, ahead = before[:b], after[: length - a]
                    name = r["bucket"][:8] + x.to_bytes(4, "little") + span.to_bytes(2, "little") + xxhash.xxh3_128_digest(core)
                    part = xxhash.xxh3_64_intdigest(back[::-1] + ahead, seed=b) - (1 << 63)
                    rows.append(r | {"bucket": name, "chunk": part, "least": a, "most": b, "before": back, "after": ahead})
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return units.mapInArrow(cut, units.schema)


def _scan(units: DataFrame, length: int) -> DataFrame:
    """The spans of repeats in chunks found once, from units in buckets that fit a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans_of(bucket: list[dict]) -> Iterator[tuple]:
            bucket = list({r["chunk"]: r for r in bucket}.values())
            if len(bucket) < 2:
                return
            spans = covered([r["after"] for r in bucket], [r["before"] for r in bucket], length)
            for r, found in zip(bucket, spans):
                if r["single"]:
                    for back, ahead in found:
                        yield r["key"], r["hash"], r["at"] - back, r["at"] + ahead

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.int32(), pa.int32()))], ["key", "hash", "begin", "end"])

        kind, held, out = None, [], []
        for batch in batches:
            kind = batch.schema.field("key").type
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    out += spans_of(held)
                    held = []
                held.append(r)
            if out:
                yield table(out)
                out = []
        out += spans_of(held)
        if out:
            yield table(out)

    ordered = units.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(scan, f"key {units.schema['key'].dataType.simpleString()}, hash bigint, begin int, end int")


def _in_parts(df: DataFrame, open_chunks: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """The spans of repeats in chunks found once that share their anchor with others."""
    units, found = stored(_around(df, open_chunks, key, text, length), "suffixes"), []
    for span in SPANS:
        # Buckets by size: alone there is nothing to compare, too many are split.
        sizes = units.groupBy(F.col("bucket").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("a"), F.max("chunk").alias("b"), F.max("single").alias("any"))
        sizes = stored(sizes.where("a <> b AND any").select("of", "n"), "bucket-sizes")
        met = units.join(sizes, F.col("bucket") == F.col("of"))
        found.append(_scan(met.where(F.col("n") <= MOST).drop("of", "n"), length))
        if sizes.where(F.col("n") > MOST).isEmpty():
            break
        parts = stored(_split(met.where(F.col("n") > MOST).drop("of", "n"), span, length), "split-suffixes")
        # Equal parts repeat as a whole, as equal chunks do; each of the others goes on, with one of the equal ones to meet.
        one = F.any_value(F.struct(*[c for c in parts.columns if c not in ("bucket", "chunk")])).alias("one")
        kinds = stored(parts.groupBy("bucket", "chunk").agg(one, F.count(F.lit(1)).alias("n")), "kinds-of-parts")
        twice = kinds.where("n > 1").select(F.col("bucket").alias("of"), F.col("chunk").alias("in"))
        equal = parts.where("single").join(twice, (F.col("bucket") == F.col("of")) & (F.col("chunk") == F.col("in")))
        found.append(equal.select("key", "hash", (F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + length).alias("end")))
        units = kinds.select("bucket", "chunk", "n", "one.*").withColumn("single", F.col("single") & (F.col("n") == 1)).select(*parts.columns)
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Spans of bytes that repeats of ``length`` bytes or more cover: ``key``, the text's ``hash``, ``begin`` and ``end``.

    Spans of one text overlap and repeat; together they cover each byte of every string of ``length`` bytes that stands
    in two places, in one text or in several.
    """
    given = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("hash"), _anchors(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), length, anchor).alias("found"))
    rows = stored(given, "anchors")
    each = rows.select("key", "hash", F.explode("found").alias("x")).select("key", "hash", "x.*")
    anchors = each.groupBy(F.col("anchor").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    # Written out, so that an anchor in very many texts can be split in the join with its places.
    anchors = stored(anchors.where("n > 1").select("of", (F.col("a") != F.col("b")).alias("mixed")), "repeated-anchors")
    met = stored(each.join(anchors, F.col("anchor") == F.col("of")).drop("of"), "repeated-places")
    span = [(F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + length).alias("end")]
    whole = met.where(~F.col("mixed")).select("key", "hash", *span)

    mixed = met.where("mixed").drop("mixed")
    first = F.min(F.struct("key", "hash", "at", "least", "most")).alias("first")
    chunks = stored(mixed.groupBy("anchor", "chunk").agg(first, (F.count(F.lit(1)) == 1).alias("single")), "chunks")
    twice = chunks.where(~F.col("single")).select(F.col("anchor").alias("of"), F.col("chunk").alias("in"))
    whole = whole.union(mixed.join(twice, (F.col("anchor") == F.col("of")) & (F.col("chunk") == F.col("in"))).select("key", "hash", *span))
    undecided = stored(chunks.groupBy(F.col("anchor").alias("of")).agg(F.max("single").alias("any")).where("any").select("of"), "undecided-anchors")
    open_chunks = chunks.join(undecided, F.col("anchor") == F.col("of")).select("anchor", "chunk", "single", "first.*")
    return whole.union(_in_parts(df, open_chunks, key, text, length))


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans put together where they overlap or touch."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    cuts = np.flatnonzero(begins[1:] > reach[:-1]) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(begins) - 1]])
    return list(zip(begins[first].tolist(), reach[last].tolist()))


def dedup_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``df`` less its text, with ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    Each byte goes that a string of ``length`` bytes covers which stands in any other place, the same text included;
    strings are judged on the input. ``kept`` is binary, since a cut may part a character. A null text is empty; a text shorter than ``length``
    stays whole. Repeated rows are texts of their own, repeat each other and get the same result. Columns named like
    the new ones are replaced. Texts move twice, to meet the places asked for and the spans; else hashes move. Two hashes
    of 64 bits, of an anchor and its chunk, stand for a chunk's bytes; other comparisons are exact.
    """
    spans = repeated_spans(df, key, text, length, anchor)
    packed = F.shiftleft(F.col("begin").cast("long"), 32) + F.col("end")
    spans = spans.groupBy(F.col("key").alias("__key"), F.col("hash").alias("__hash")).agg(F.collect_set(packed).alias("__spans"))
    # Merged at any size: these rows grow with the texts.
    spans = stored(spans, "repeated-spans").hint("merge")
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    rest = without(df, *new, text).columns
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    docs = df.select(*[F.col(f"`{c}`") for c in rest], body.alias("__body"), F.xxhash64(f"`{text}`").alias("__of"))

    def cut(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for body, found in zip(bodies, spans):
            body, runs = body.as_py(), []
            if found.is_valid and len(found.values):
                both = found.values.to_numpy(zero_copy_only=False)
                runs = merged(both >> 32, both & 0xFFFFFFFF)
            edges = [0, *[x for run in runs for x in run], len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(body), len(body) - len(kept), len(runs), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], new)

    made = F.arrow_udf(cut, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")("__body", "__spans")
    met = docs.join(spans, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__of") == F.col("__hash")), "left")
    return met.select(*[F.col(f"`{c}`") for c in rest], made.alias("__made")).select(*[F.col(f"`{c}`") for c in rest], "__made.*")
