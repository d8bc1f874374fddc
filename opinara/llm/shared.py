"""Column idioms several operators use."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.workspace import stored

#: The white space that separates words.
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not blank, in order."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, whatever their case."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def count_once(df: DataFrame, most: int) -> int:
    """Rows of ``df``, counted up to ``most`` + 1."""
    return df.limit(most + 1).count()


class WordMemory(dict):
    """What ``make`` gives for a word, as bytes, remembered for the first ``most`` words of up to ``longest`` characters.

    Texts repeat words, and looking one up is much cheaper than making its bytes. What isn't remembered is made anew.
    """

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 40):
        super().__init__({"": b""})
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word: str) -> bytes:
        made = self.make(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = made
        return made

    def of(self, text: str) -> bytes:
        """The bytes of a text's words, which end at spaces and line breaks, in a row."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def numbered(df: DataFrame, within: list[str], order: list[str], purpose: str) -> DataFrame:
    """Adds ``at``, a row's place (from 0) among those with equal ``within``, by ``order``, and ``n``, how many these are.

    Rows are dealt out by ranges of all these columns, so that a hot value of ``within`` is in many tasks, and numbered
    from one row per task and value. Rows that are equal in all of them share their places in any order.
    """
    by = [*within, *order]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    # The numbers are those of the written table, so that a task that runs again finds the same ones.
    rows = stored(ordered, purpose).withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    runs = rows.groupBy("__part", *within).agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy(*within)
    before = F.sum("rows").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("__part", *within, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("rows").over(same).alias("n"))
    met = rows.join(stored(runs, f"{purpose}-runs"), ["__part", *within])
    return met.select(*df.columns, (F.col("__row") + F.col("base")).alias("at"), "n")
