"""Removes passages of lines that another document, or the same one, holds earlier.

Every three consecutive lines are one window. Windows are hashed and counted over all documents; of a
window found twice or more the first occurrence stays. The lines that later occurrences cover, merged
over overlapping windows, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import let, without
from opinara.workspace import stored

WINDOW = 3
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _EDGES, ""))


def windows_of(text: Column, width: int = WINDOW) -> Column:
    """Hash pair and place of every window; a text with fewer lines than a window is one window.

    Lines count without the blanks at their ends, and lines of blanks don't count. Two hashes of 64 bits stand for a
    window's text.
    """

    def hashed(lines: Column) -> Column:
        n = F.size(lines)
        places = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
        window = lambda i: F.slice(lines, i, F.lit(width))
        return F.when(n > 0, F.transform(places, lambda i: F.struct(F.xxhash64(window(i)).alias("a"), F.xxhash64(F.lit(width), window(i)).alias("b"), i.alias("at"))))

    return let(F.filter(_trimmed_lines(text), lambda x: x != ""), hashed)


def without_windows(text: Column, gone: Column, width: int = WINDOW) -> tuple[Column, Column]:
    """The text without the lines that windows at the places ``gone`` cover, and how many lines that are."""

    def joined(rest: Column) -> Column:
        return F.when(F.exists(rest, lambda x: F.regexp_replace(x, _EDGES, "") != ""), F.array_join(rest, "\n")).otherwise("")

    def kept(lines: Column, removed: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return let(F.transform(places, lambda i: F.get(lines, i)), joined)

    counted = F.filter(
        F.transform(_trimmed_lines(text), lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()
    )
    removed = let(counted, lambda c: F.array_distinct(F.flatten(F.transform(gone, lambda w: F.slice(c, w, F.lit(width))))))
    return let(removed, lambda r: let(F.split(text, "\n"), lambda lines: kept(lines, r))), F.size(removed)


def later_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with later occurrences: its key, its text's hash and the places of those windows, as ``gone``.

    The first occurrence is the one with the smallest key (null first), then text hash, then place.
    """
    identity = F.struct(F.col(f"`{key}`").alias("__key"), F.xxhash64(f"`{text}`").alias("__text"))
    windows = stored(
        df.select(identity.alias("doc"), F.explode(windows_of(F.col(f"`{text}`"))).alias("w")).select("doc", "w.*"), "line-windows"
    )
    repeated = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Written out, so that a window in very many documents can be split in the join with its occurrences.
    repeated = stored(repeated.where("n > 1").drop("n"), "repeated-windows")
    later = windows.join(repeated, ["a", "b"]).where(F.struct("doc", "at") > F.col("first"))
    return later.groupBy("doc").agg(F.collect_set("at").alias("gone")).select("doc.*", "gone")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeated passages taken out of its texts, and ``n_removed``, the lines removed.

    A line goes if any later occurrence covers it; its first copy always stays. Lines of blanks stay,
    but a text of which nothing else is left is empty. A null text stays null. Rows that repeat both key and
    text are the same document: they are no repeats of each other and get the same result. A column
    named ``n_removed`` is replaced. Texts move once, to meet their places; counting moves hashes only.
    """
    # Merged at any size: these rows grow with the documents.
    later = stored(later_windows(df, key, text), "later-windows").hint("merge")
    columns = without(df, "n_removed").columns
    body, gone = F.col(f"`{text}`"), F.col("gone")
    met = without(df, "n_removed", "__key", "__text", "gone").withColumn("__hash", F.xxhash64(f"`{text}`")).join(
        later, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__text")), "left"
    )
    rest, n = without_windows(body, gone)
    return met.select(
        *[F.when(gone.isNull(), body).otherwise(rest).alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        F.when(gone.isNull(), 0).otherwise(n).cast("long").alias("n_removed"),
    )
