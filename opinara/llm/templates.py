"""Benchmark decontamination by templates.

A text's words become a template: numbers, names and units are replaced by typed placeholders. A second
template keeps capitalised words, folded like all others, so that copies in capitals or without any are found. Windows
of both are joined by hash with the windows of the benchmark's items. Where windows of a
document line up with an item, each value of the item must have one value in the document, whatever their case, as in a copy
and in a question asked again with other numbers and names, but not in texts that are alike by chance. With ``odd`` a few
slots may hold another value than most with the same item value do: what lies around them counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import WordMemory, count_once
from opinara.workspace import stored

#: Words in a window, and the share of an item's words that must be found.
WINDOW, COVERED = 8, 0.5
#: Words outside slots an alignment needs, unless its slots hold the item's own values.
LITERALS = 5
#: More windows or keys than this are not broadcast but joined as Spark plans it.
MOST_BROADCAST = 500_000
NUMBER, NAME, UNIT = "0", "N", "U"
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs d w kw mw hz khz mhz ghz v a c f k pa bar j kj cal kcal "
    "kb mb gb tb kmh mph usd eur gbp dollars euros pounds cents percent degrees meters metres grams liters litres seconds minutes hours "
    "days weeks months years miles inches feet".split()
)
_WORD = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000
#: Characters whose windows are made together.
TOGETHER = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Numbers and words as written."""
    return _WORD.findall(text or "")


def placeholder(word: str) -> str:
    """The template of a word that stands alone: ``NUMBER``, ``NAME`` or the folded word."""
    return NAME if word[0].isupper() else folded(word)


def folded(word: str) -> str:
    """The second template of a word that stands alone: ``NUMBER`` or the word without its case."""
    return NUMBER if word[0].isdigit() else word.casefold()


def template_of(words: list[str]) -> list[str]:
    """Placeholders for numbers, capitalised words and units after numbers; other words folded."""
    kinds = list(map(placeholder, words))
    if NUMBER in kinds:
        for i in range(1, len(words)):
            if kinds[i - 1] == NUMBER and words[i].lower() in UNITS:
                kinds[i] = UNIT
    return kinds


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _hashes(words: list[str]) -> bytes:
    return np.array(list(map(_hash, words)), dtype=np.int64).tobytes()


@lru_cache(maxsize=1)
def _memory() -> WordMemory:
    """Per word of what stands between two spaces its hashes in both templates; units are left to those who see the word before."""
    return WordMemory(lambda part: _hashes([kind(w) for w in words_of(part) for kind in (placeholder, folded)]), REMEMBERED)


_FACTORS = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(WINDOW)], dtype=np.uint64)
_NUMBER, _UNIT = _hash(NUMBER), _hash(UNIT)
_SLOTS = np.array([_hash(x) for x in (NUMBER, NAME, UNIT)], dtype=np.int64).view(np.uint64)
#: What a unit's hash can be before the word in front of it is known.
_MAY_BE_UNIT = np.array([_hash(folded(u)) for u in sorted(UNITS)], dtype=np.int64)


def template_hashes(text: str | None) -> np.ndarray:
    """A row for each word: its hash in the template, and in the second one."""
    found = np.frombuffer(_memory().of(text or ""), dtype=np.int64).reshape(-1, 2)
    after = np.flatnonzero(found[:-1, 0] == _NUMBER) + 1
    if len(after) and len(after := after[np.isin(found[after, 1], _MAY_BE_UNIT)]):
        words, found = words_of(text), found.copy()
        for i in after:
            if words[i].lower() in UNITS:
                found[i] = _UNIT
    return found.view(np.uint64)


class Sought:
    """Which hashes may be among ``hashes``: all of those and few others."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(16, int(len(hashes)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(hashes.astype(np.int64).view(np.uint64))] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[self._slot(hashes)]


def _values(texts: list[str | None], ends: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the words as they are, for the texts that have windows at ``at``; zero for others."""
    found = np.zeros(n, np.uint64)
    for i in np.unique(np.searchsorted(ends, at, side="right")):
        own = np.frombuffer(_hashes([w.casefold() for w in words_of(texts[i])]), np.uint64)
        found[ends[i] - len(own) : ends[i]] = own
    return found


def window_hashes(texts: list[str | None], widths: list[int], sought: Sought | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each width and template: the texts, the places (from 0) and the hashes of windows, and the width.

    A window without capitals is the same in both templates and is given once. One of placeholders alone is no sign of an item, since any
    names in a row would be: it is given in the second template only, and one of numbers and units alone with
    its numbers as they are. With ``sought`` only windows that may be in it are given.
    """
    each = list(map(template_hashes, texts))
    sizes = [len(x) for x in each]
    words = np.concatenate([*each, np.zeros((WINDOW, 2), np.uint64)])
    ends, n = np.cumsum(sizes), len(words) - WINDOW
    left = np.repeat(ends, sizes) - np.arange(n)
    starts, typed, kept = ends - sizes, np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    slots = np.concatenate([[0], np.cumsum(np.isin(typed, _SLOTS))])
    found = []

    def rolled(kind: np.ndarray, width: int) -> np.ndarray:
        row = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            row += kind[k : k + n] * _FACTORS[k]
        return row

    for width in widths:
        rows = [rolled(kind, width) for kind in (typed, kept)]
        whole, bare, differ = left >= width, slots[width : width + n] - slots[:n] == width, rows[0] != rows[1]
        given = [(rows[0], whole & ~bare), (rows[1], whole & differ)]
        numbers = whole & bare & ~differ
        if numbers.any():
            values = np.concatenate([_values(texts, ends, np.flatnonzero(numbers), n), np.zeros(WINDOW, np.uint64)])
            given.append((rolled(values, width) * _FACTORS[0], numbers))
        for row, here in given:
            at = np.flatnonzero(here if sought is None else here & sought.among(row))
            text = np.searchsorted(ends, at, side="right")
            found.append((text, at - starts[text], row[at].view(np.int64), width))
    return found


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in groups of bounded length, so that the arrays made from one stay small."""
    some, length = [], 0
    for text in texts:
        some.append(text.as_py())
        length += len(some[-1] or "")
        if length > TOGETHER:
            yield some
            some, length = [], 0
    if some:
        yield some


def _windows(text: Column, widths: list[int], sought: Sought | None = None) -> Column:
    """Hash, place (from 0) and width of each window of both templates."""

    def hashed(texts: pa.Array) -> pa.Array:
        sizes, parts = [np.zeros(1, np.int64)], []
        for some in _groups(texts):
            rows = window_hashes(some, widths, sought)
            order = np.argsort(text := np.concatenate([r[0] for r in rows]), kind="stable")
            sizes.append(np.bincount(text, minlength=len(some)))
            window = np.concatenate([np.full(len(r[0]), r[3]) for r in rows])
            parts.append((np.concatenate([r[2] for r in rows])[order], np.concatenate([r[1] for r in rows])[order], window[order]))
        columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64)] * 3
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["hash", "at", "window"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), values)

    return F.arrow_udf(hashed, "array<struct<hash: bigint, at: int, window: int>>")(text)


def _words(text: Column) -> Column:
    """Words, folded words and template as arrays."""

    def cut(texts: pa.Array) -> pa.Array:
        words = [words_of(t) for t in texts.to_pylist()]
        columns = [words, [[w.casefold() for w in x] for x in words], list(map(template_of, words))]
        return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in columns], ["words", "folded", "template"])

    return F.arrow_udf(cut, "struct<words: array<string>, folded: array<string>, template: array<string>>")(text)


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _places(df: DataFrame, text: str, widths: list[int], *columns: str, sought: Sought | None = None) -> DataFrame:
    """One row per window of a template: ``columns``, ``hash``, the place (from 0) of its first word and its ``window`` width."""
    arrays = df.select(*columns, _windows(F.col(text), widths, sought).alias("windows"))
    # An outer one: for a plain one the optimizer adds a filter that can't call the Python function, or calls it again.
    rows = arrays.select(*columns, F.explode_outer("windows").alias("w")).where("w is not null")
    return rows.select(*columns, "w.hash", "w.at", "w.window")


def item_words(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Items with their text, words, folded words, template and the width of their windows: ``WINDOW``, or less for a shorter item."""
    body = F.col(f"`{text}`").alias("item_text")
    items = benchmark.select(F.struct(F.col(f"`{item}`").alias("item_id"), F.xxhash64(body).alias("hash")).alias("item"), body).distinct()
    cut = items.select("item", "item_text", _words(F.col("item_text")).alias("w"))
    words = cut.select("item", "item_text", *[F.col(f"w.{c}").alias(f"item_{c}") for c in ("words", "folded", "template")])
    return words.where(F.size("item_words") > 0).withColumn("width", F.least(F.size("item_words"), F.lit(WINDOW)))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if a count shows that it is small."""
    return F.broadcast(df) if count_once(df, MOST_BROADCAST) <= MOST_BROADCAST else df


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", odd: bool = False) -> DataFrame:
    """One row per document and benchmark item found in it: key, text hash, ``item_id``, ``n_words``, ``coverage``, ``exact``.

    ``coverage`` is the share of the item's words that lie in matching windows with agreeing slots, at
    least ``COVERED``; ``exact`` says that these words are the item's as written, case included.
    Without ``odd`` one disagreeing slot refuses an alignment; with it only the windows around such a slot are left out, and
    words that are the item's own count by themselves where they make up ``COVERED``. Null and empty texts and items
    match nothing, an item with a null id does; items that repeat in full count once, rows that repeat key and text give one row. Columns of ``df`` other than key and
    text are not looked at. Windows of documents are never shuffled while those of the benchmark are
    few; a larger benchmark is joined by hash. Only documents with a matching window are read again.
    """
    items = stored(item_words(benchmark, item), "benchmark-words")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    sought = _places(items, "item_text", widths or [WINDOW], "item", "width").where("window = width").select("item", "width", "hash", F.col("at").alias("item_at"))
    sought = stored(sought, "benchmark-windows")
    # Few hashes go to the workers, which then give only windows that may be among them.
    few = count_once(sought, MOST_BROADCAST) <= MOST_BROADCAST
    known = Sought(sought.select("hash").distinct().toArrow()["hash"].to_numpy()) if few else None
    sought = F.broadcast(sought) if few else sought
    docs = df.select(F.col(f"`{key}`").alias("doc_key"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("body"))
    found = _places(docs, "body", widths or [WINDOW], "doc_key", "text_hash", sought=known).drop("window").join(sought, "hash")
    shift = F.col("at") - F.col("item_at")
    lined = found.groupBy("doc_key", "text_hash", "item", "width", shift.alias("shift")).agg(F.collect_set("item_at").alias("places"))
    lined = stored(lined, "template-matches")
    keys = lined.select(F.col("doc_key").alias("k"), F.col("text_hash").alias("h")).distinct()
    same = F.col("doc_key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    again = docs.join(_small(stored(keys, "template-documents")), same)
    words = again.select("k", "h", _words(F.col("body")).alias("w")).dropDuplicates(["k", "h"])
    words = words.select("k", "h", F.col("w.words").alias("doc_words"), F.col("w.folded").alias("doc_folded"))
    return _agreeing(lined.join(items.drop("width", "item_text"), "item").join(words, same), odd)


def odd_places(slots: list[dict]) -> list[int]:
    """Places of the slots with another value than most have of those with the same item value; of equally many the item's own wins."""
    counts: dict[str, Counter] = {}
    for x in slots:
        counts.setdefault(x["ours"], Counter())[x["theirs"]] += 1
    most = {ours: max(c, key=lambda t: (c[t], t == ours, t)) for ours, c in counts.items()}
    return [x["i"] for x in slots if x["theirs"] != most[x["ours"]]]


def _odd_places(slots: Column) -> Column:
    return F.arrow_udf(lambda rows: pa.array([odd_places(x) for x in rows.to_pylist()], pa.list_(pa.int32())), "array<int>")(slots)


def _agreeing(met: DataFrame, odd: bool) -> DataFrame:
    """Alignments whose slots agree, summed up by document and item."""
    spread = lambda places: F.sort_array(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("width") - 1)))))
    ours, theirs = (lambda c, i: F.get(F.col(f"item_{c}"), i)), (lambda c, i: F.get(F.col(f"doc_{c}"), i + F.col("shift")))
    pairs = F.transform(
        "covered",
        lambda i: F.struct(
            i.alias("i"), ours("template", i).alias("kind"), ours("folded", i).alias("ours"), theirs("folded", i).alias("theirs"), (ours("words", i) == theirs("words", i)).alias("written")
        ),
    )
    met = met.withColumn("covered", spread(F.col("places"))).withColumn("pairs", pairs)
    slots = F.filter("pairs", lambda x: _is_slot(x["kind"]))
    values = F.array_distinct(F.transform(slots, lambda x: F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs"))))
    met = met.withColumn("values", values)
    met = met.withColumn("agree", F.size(F.array_distinct(F.col("values.ours"))) == F.size("values"))
    own = lambda x: ~_is_slot(x["kind"]) | (x["ours"] == x["theirs"])
    if odd:
        # Of disagreeing alignments the windows without an odd slot stay, or the item's own words if they suffice.
        met = met.withColumn("odd", _odd_places(F.when(~F.col("agree"), slots).otherwise(F.array().cast("array<struct<i:int,kind:string,ours:string,theirs:string,written:boolean>>"))))
        clean = F.filter("places", lambda p: ~F.arrays_overlap(F.sequence(p, p + F.col("width") - 1), F.col("odd")))
        met = met.withColumn("rest", spread(clean)).withColumn("own", F.transform(F.filter("pairs", own), lambda x: x["i"]))
        enough = F.size("own") / F.size("item_words") >= COVERED
        rest = F.when(enough, F.sort_array(F.array_union("rest", "own"))).otherwise(F.col("rest"))
        met = met.withColumn("covered", F.when(F.col("agree"), F.col("covered")).otherwise(rest)).withColumn("pairs", pairs)
    else:
        met = met.where("agree")
    same = F.forall("pairs", lambda x: x["ours"] == x["theirs"])
    literals = F.size(F.filter("pairs", lambda x: ~_is_slot(x["kind"]) | ((x["kind"] == NAME) & (x["ours"] == x["theirs"]))))
    exact = F.forall("pairs", lambda x: x["written"])
    good = met.where((F.size("covered") > 0) & ((F.col("agree") & same) | (literals >= LITERALS))).withColumn("exact", exact)
    summed = good.groupBy("doc_key", "text_hash", "item").agg(
        F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"),
        F.max(F.size("item_words")).alias("length"),
        F.min("exact").alias("exact"),
    )
    share = F.size("covered") / F.col("length")
    return summed.select("doc_key", "text_hash", "item.item_id", F.size("covered").cast("long").alias("n_words"), share.alias("coverage"), "exact").where(share >= COVERED)


def clean_documents(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", odd: bool = False) -> DataFrame:
    """The rows of ``df`` that hold no item of the benchmark, with all their columns; null texts stay. ``odd`` as in ``leaks``."""
    leaking = _small(stored(leaks(df, benchmark, key, text, odd=odd).select(F.col("doc_key").alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "leaking-documents"))
    return df.join(leaking, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.xxhash64(f"`{text}`") == F.col("__hash")), "left_anti")
