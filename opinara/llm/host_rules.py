"""Quality rules per document and per host.

Each text is measured and tested by itself. Failures are counted per host, each host's failure rate
is drawn towards the rate of all hosts by a beta prior fitted to them, and a host whose rate is
surely above the limit is rejected with everything it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import BLANK, let, without, words_of
from opinara.workspace import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A text fails with fewer words, or with more than this percentage of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A host is rejected when its failure rate, less two standard deviations, is above this.
MOST_FAILED, DEVIATIONS = 0.5, 2.0
#: Bytes of documents a task holds back while it measures others.
ROW_GROUP = 16 << 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in a window of ``width`` words that the text holds twice or more.

    Hashes tell most texts at once that nothing repeats. In the others the windows are sorted with
    their places, so that equal ones are neighbours; their places, sorted again, give the words covered.
    """

    def places(windows: Column) -> Column:
        n = F.size(windows)
        twins = F.zip_with(
            F.slice(windows, F.lit(1), n - 1),
            F.slice(windows, F.lit(2), n - 1),
            lambda a, b: F.when(a["window"] == b["window"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(twins)))

    def covered(at: Column) -> Column:
        following = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.get(at, F.size(at) - 1) + width))
        return F.aggregate(F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(width))), F.lit(0), lambda s, x: s + x)

    def exact() -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(words) - width + 1),
            lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(width)), " ").alias("window"), i.alias("at")),
        )
        return let(F.array_sort(windows), lambda w: let(places(w), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0)))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
    return F.when(F.size(words) <= width, 0).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact()))
    )


def measures(text: Column) -> Column:
    """A struct of the five measures; a null text counts as empty."""
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    body = lambda t: let(
        words_of(t),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, BLANK + "+", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        ),
    )
    return body(F.coalesce(text, F.lit("")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures and ``base_failed``; columns of these names in ``df`` are replaced."""
    rest = without(df, *MEASURES, "base_failed")
    wide = df.select(*[F.col(f"`{c}`") for c in rest.columns], measures(F.col(f"`{text}`")).alias("__m"))
    return wide.select(
        *[F.col(f"`{c}`") for c in rest.columns],
        *[F.col("__m")[m].alias(m) for m in MEASURES],
        base_failed(F.col("__m")["n_words"], F.col("__m")["n_repeat_words"]).alias("base_failed"),
    )


def host_rates(df: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures, the shrunk failure rate and whether the host is rejected.

    The prior is a beta distribution with the mean and variance of the hosts' own rates; where that
    variance is no beta distribution's, the prior has their mean and the weight of one document. A null host is a
    host of its own.
    """
    hosts = stored(
        df.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")),
        "host-counts",
    )
    rate = F.col("failed") / F.col("n")
    mean, variance = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = mean or 0.0
    spread = mean * (1 - mean)
    weight = spread / variance - 1 if variance and variance < spread else 1.0
    total = F.col("n") + F.lit(weight)
    shrunk = (F.col("failed") + F.lit(mean * weight)) / total
    rated = hosts.withColumn("rate", shrunk)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return rated.withColumn("rejected", F.col("rate") - DEVIATIONS * deviation > MOST_FAILED)


def _verdicts(df: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    rejected = stored(hosts.where("rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__rejected")), "rejected-hosts")
    return df.join(rejected, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left").drop("__host")


def judge_documents(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept`` to the columns of ``df``, less its text.

    A null or empty text has no words and fails. Repeated rows each count and get the same verdict;
    an empty table gives an empty result. The measures are written once, as a narrow table, and
    counted by host from there. Only the prior's two numbers come to the driver.
    """
    narrow = stored(measured(df, text).drop(text), "text-measures")
    judged = _verdicts(narrow, host_rates(narrow, host), host)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("__rejected").isNull()).drop("__rejected")


def keep_documents(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns.

    The texts are measured once: the rows are written with their verdict, those that fail without their text, and
    both the counts by host and the rows that pass come from that table. No text is shuffled.
    """
    failed = "__failed"
    m = measures(F.col(f"`{text}`"))
    flagged = df.select(*[F.col(f"`{c}`") for c in df.columns], let(m, lambda x: base_failed(x["n_words"], x["n_repeat_words"])).alias(failed))
    body = F.when(~F.col(failed), F.col(f"`{text}`")).alias(text)
    flagged = stored(flagged.select(*[body if c == text else F.col(f"`{c}`") for c in flagged.columns]), "flagged-documents", row_group=ROW_GROUP)
    counts = flagged.select(F.col(f"`{host}`").alias("host"), F.col(failed).alias("base_failed"))
    judged = _verdicts(flagged.where(~F.col(failed)), host_rates(counts, "host"), host)
    return judged.where(F.col("__rejected").isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
